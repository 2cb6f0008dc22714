"""Paths in evidence and data-flow graphs: simple paths with a call stack, ranked paths, slices, summaries.

All searches are frontier loops over edge tables; a state carries its path as an array, whose length the depth bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, materialise_counted, maybe_broadcast
from .fixpoint import frontier


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, barriers: DataFrame | None = None, most_depth: int = 32, most_paths: int = 256, most_states: int = 100_000) -> DataFrame:
    """Paths from sources to sinks that match calls with returns: source, sink, path (nodes), depth, status.

    edges (src, dst, kind, site): a ``call`` edge pushes its site, a ``return`` edge must find its site on top and pops
    it (with an empty stack it passes, as the search may begin inside a callee), others keep the stack. Paths are simple
    in states (node and stack). Nodes of ``barriers`` end a path; a sink ends it too. Edges that cannot lead to a sink are
    left out before, by reach from the sinks backwards.

    A source has at most ``most_paths`` paths, in order of depth and path, none longer than ``most_depth``, and no more
    than ``most_states`` open states at a depth. Where one of these bounds leaves anything out, the last row of the source
    has the status budget_exceeded, and a source of which no path is left has one such row with a null sink and path.
    """
    whole = edges.where("src is not null and dst is not null").select("src", "dst", "kind", F.col("site").cast("string").alias("site")).distinct()
    ends = materialise(sinks.select("node").distinct(), "taint")
    if barriers is not None:
        whole = whole.join(maybe_broadcast(barriers.select(F.col("node").alias("dst")).distinct()), "dst", "left_anti")
    whole = materialise(whole, "taint")
    back = maybe_broadcast(whole.select("src", "dst").distinct())
    useful, _ = frontier(ends, lambda new: new.join(back, F.col("node") == F.col("dst")).select(F.col("src").alias("node")), ["node"])
    e = maybe_broadcast(materialise(whole.join(useful.select(F.col("node").alias("dst")), "dst", "left_semi"), "taint"))
    ends = maybe_broadcast(ends)
    empty = F.array().cast("array<string>")
    now = sources.select(F.col("node").alias("source"), "node").distinct().withColumn("stack", empty).withColumn("path", F.array("node")).withColumn("states", F.array(F.concat_ws("|", F.col("node").cast("string"))))
    found: DataFrame | None = None
    over: DataFrame | None = None
    top = F.element_at("stack", -1)
    pushed = F.when(F.col("kind") == "call", F.concat("stack", F.array("site"))).when((F.col("kind") == "return") & (F.size("stack") > 0), F.slice("stack", 1, F.size("stack") - 1)).otherwise(F.col("stack"))

    def walked(now: DataFrame) -> DataFrame:
        x = now.join(e, F.col("node") == F.col("src")).where((F.col("kind") != "return") | (F.size("stack") == 0) | (F.when(F.size("stack") > 0, top) == F.col("site")))
        x = x.withColumn("new_stack", pushed).withColumn("state", F.concat_ws("|", F.col("dst").cast("string"), "new_stack")).where(~F.array_contains("states", F.col("state")))
        return x.select("source", F.col("dst").alias("node"), F.col("new_stack").alias("stack"), F.concat("path", F.array("dst")).alias("path"), F.concat("states", F.array("state")).alias("states")).distinct()

    for depth in range(1, most_depth + 1):
        x, about = materialise_counted(walked(now), "taint")
        if not about["n"]:
            break
        hits = x.join(ends, "node", "left_semi").select("source", F.col("node").alias("sink"), "path", F.lit(depth).alias("depth"))
        found = hits if found is None else found.unionByName(hits)
        now = x.join(ends, "node", "left_anti")
        crowded = materialise(now.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_states).select("source"), "taint") if about["n"] > most_states else None
        if crowded is not None and not crowded.isEmpty():
            over = crowded if over is None else over.unionByName(crowded)
            w = Window.partitionBy("source").orderBy("path", F.col("stack"))
            cut = now.join(crowded, "source", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_states).drop("k")
            now = materialise(now.join(crowded, "source", "left_anti").unionByName(cut), "taint")
    else:
        deeper = walked(now).select("source").distinct()
        over = deeper if over is None else over.unionByName(deeper)
    none = now.select("source", F.col("node").alias("sink"), "path", F.lit(0).alias("depth")).limit(0)
    found = (none if found is None else found).distinct()
    over = (none.select("source") if over is None else over).distinct().withColumn("cut", F.lit(True))
    w = Window.partitionBy("source").orderBy("depth", "path")
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    ranked = found.withColumn("k", F.row_number().over(w)).withColumn("n", n).where(F.col("k") <= most_paths).join(over, "source", "left")
    last = F.col("k") == F.least("n", F.lit(most_paths))
    status = F.when(last & (F.coalesce("cut", F.lit(False)) | (F.col("n") > most_paths)), "budget_exceeded").otherwise("present")
    rows = ranked.select("source", "sink", "path", "depth", status.alias("status"))
    kinds = dict(rows.dtypes)
    bare = over.join(found.select("source").distinct(), "source", "left_anti")
    return rows.unionByName(bare.select("source", F.lit(None).cast(kinds["sink"]).alias("sink"), F.lit(None).cast(kinds["path"]).alias("path"), F.lit(None).cast("int").alias("depth"), F.lit("budget_exceeded").alias("status")))


def ranked_paths(edges: DataFrame, pairs: DataFrame, penalty: str, most_paths: int = 5, most_depth: int = 32) -> DataFrame:
    """The ``most_paths`` best simple paths of at most ``most_depth`` edges of each pair (start, end): start, end, path,
    cost, rank. Cost is the sum of ``penalty`` (not negative) over the edges, then the length, then the path itself decide.

    Only prefixes that can still become one of the best are kept. The least cost to the end is found backwards first; a
    prefix goes on only if its cost plus that is not above the cost of the path that is ``most_paths``-th so far. Nodes
    from which the end is not reached are never entered. The result is exact: what is cut is dearer than what is kept.
    """
    e = maybe_broadcast(edges.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min(penalty).cast("long").alias("p")))
    asked = pairs.select("start", "end").where("start is not null and end is not null and start <> end").distinct()
    # Bellman-Ford from the ends backwards: the least cost from each node to the end.
    rest = materialise(asked.select("end", F.col("end").alias("node"), F.lit(0).cast("long").alias("to_go")).distinct(), "ranked")
    new = rest
    for _ in range(most_depth):
        nearer = new.join(e, F.col("node") == F.col("dst")).groupBy("end", F.col("src").alias("node")).agg(F.min(F.col("to_go") + F.col("p")).alias("to_go"))
        better = nearer.join(rest.select("end", "node", F.col("to_go").alias("old")), ["end", "node"], "left").where("old is null or to_go < old").drop("old")
        new, about = materialise_counted(better, "ranked")
        if not about["n"]:
            break
        rest = materialise(rest.unionByName(new).groupBy("end", "node").agg(F.min("to_go").alias("to_go")), "ranked")
    rest = maybe_broadcast(rest)
    now = asked.withColumn("node", F.col("start")).withColumn("path", F.array("start")).withColumn("cost", F.lit(0).cast("long"))
    done = now.select("start", "end", "path", "cost").limit(0)
    w = Window.partitionBy("start", "end").orderBy("cost", F.size("path"), "path")
    for _ in range(most_depth):
        x = now.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", "end", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("p")).alias("cost"))
        x = x.join(rest, ["end", "node"])
        worst = done.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("worst")).where(F.col("n") >= most_paths)
        x = x.join(maybe_broadcast(worst), ["start", "end"], "left").where(F.col("worst").isNull() | (F.col("cost") + F.col("to_go") <= F.col("worst")))
        x, about = materialise_counted(x.select("start", "end", "node", "path", "cost"), "ranked")
        if not about["n"]:
            break
        hits = x.where("node = end").select("start", "end", "path", "cost")
        done = materialise(done.unionByName(hits).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_paths).drop("k"), "ranked")
        now = x.where("node <> end")
    return done.withColumn("rank", F.row_number().over(w)).select("start", "end", "path", "cost", "rank")


def slice_graph(edges: DataFrame, seeds: DataFrame, kinds: list[str], backward: bool = True, most_nodes: int = 10_000, most_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """A slice (node, depth) over edges of ``kinds``, and one row of its status.

    Status: partial if the depth or node bound left something out, unknown if an edge on the way is uncertain
    (column ``certain`` false), else present.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = maybe_broadcast(edges.where(F.col("kind").isin(*kinds)).select(F.col(a).alias("at"), F.col(b).alias("to"), "certain").distinct())
    start = seeds.select("node", F.lit(0).alias("depth")).distinct()
    reached, ended = frontier(start, lambda new: new.join(e, F.col("node") == F.col("at")).select(F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")), ["node"], most_depth, [F.col("depth")])
    n = reached.count()
    kept = reached if n <= most_nodes else reached.orderBy("depth", "node").limit(most_nodes)  # the slice's own bound
    uncertain = reached.join(e.where("not certain"), F.col("node") == F.col("at"), "left_semi").limit(1).count() > 0
    status = "partial" if not ended or n > most_nodes else "unknown" if uncertain else "present"
    return kept, edges.sparkSession.createDataFrame([(status, n)], "status string, nodes long")


def bottom_up_summaries(calls: DataFrame, own: DataFrame, components: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """For each function the union of its own effects and those of all it calls: function, effect.

    calls (caller, callee); own (function, effect); components (node, component) of the call graph. Functions of one
    component share their effects, so the work is done on components, which have no cycles; a callee that is in no
    component counts as the effect unresolved.
    """
    c = components.select(F.col("node").alias("function"), "component")
    at = calls.join(c.withColumnRenamed("function", "caller").withColumnRenamed("component", "a"), "caller")
    linked = at.join(c.withColumnRenamed("function", "callee").withColumnRenamed("component", "b"), "callee", "left")
    edges = maybe_broadcast(linked.where("b is not null and a <> b").select("a", "b").distinct())
    facts = own.join(c, "function").select("component", "effect").unionByName(linked.where("b is null").select(F.col("a").alias("component"), F.lit("unresolved").alias("effect")))
    closed, ended = frontier(facts.distinct(), lambda new: new.join(edges, F.col("component") == F.col("b")).select(F.col("a").alias("component"), "effect"), ["component", "effect"], most_rounds)
    if not ended:
        raise RuntimeError(f"not finished after {most_rounds} rounds")
    return c.join(closed, "component").select("function", "effect")


def weakest_on_path(path_labels: Column, table: dict[str, int]) -> Column:
    """The least rank of the labels on a path; null for an empty path."""
    from ..functions.predicates import weakest

    return weakest(path_labels, table)
