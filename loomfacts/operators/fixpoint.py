"""Recursive operators: one semi-naive loop, and reachability, closures, paths, components and points-to built on it.

Each round joins only the rows that are new with the edges, so the work follows the new rows, not all pairs. A round ends
as a table in the shared folder: lineage stays short and a lost executor loses nothing. The edge table is broadcast only if
its size allows. Loops stop when nothing new comes. A bound holds only where the caller asks for one; a loop
that reaches it says so or raises. Null ends of edges are left out,
repeated edges count once, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, materialise_counted, maybe_broadcast, release
from .components import strong_groups

#: Rounds after which a loop gives up, where none is asked for: none, it goes on until nothing is new.
MOST_ROUNDS = None
#: Most edges of an undirected component whose strong components are found in one task.
MOST_EDGES = 500_000
#: Rounds after which the rows seen are written as one table and the tables of the rounds are removed.
JOINED_ROUNDS = 12


def rounds(most: int | None) -> Iterator[int]:
    """Numbers of rounds; raises if the loop is not left before the bound."""
    yield from count() if most is None else range(most)
    raise RuntimeError(f"not finished after {most} rounds")


def frontier(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: Sequence[str], most_rounds: int | None = MOST_ROUNDS, order: Sequence[Column] = ()) -> tuple[DataFrame, bool]:
    """All rows that ``step`` reaches from ``seed``, one for each ``key``, and whether the loop ended by itself.

    Of several new rows of a key the first in ``order`` is kept (any, if there is no order); a key that is known already
    is never replaced.
    """
    def once(d: DataFrame) -> DataFrame:
        if not order:
            return d.dropDuplicates(list(key))
        return d.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")

    new = materialise(once(seed), "round")
    seen, parts = new, [new]
    for i in count() if most_rounds is None else range(most_rounds):
        new, about = materialise_counted(once(step(new)).join(seen.select(*key), list(key), "left_anti"), "round")
        if not about["n"]:
            release(new)
            return seen, True
        seen = seen.unionByName(new)
        parts.append(new)
        if i % JOINED_ROUNDS == JOINED_ROUNDS - 1:
            seen = materialise(seen, "round")
            release(*parts[:-1])  # the last one is what the next step goes on from
            parts = [new, seen]
    return seen, step(new).join(seen.select(*key), list(key), "left_anti").isEmpty()


def _edges(edges: DataFrame) -> DataFrame:
    return maybe_broadcast(edges.where("src is not null and dst is not null").select("src", "dst").distinct())


def reachable(edges: DataFrame, starts: DataFrame, include_start_on_cycle: bool = False, most_depth: int | None = MOST_ROUNDS) -> DataFrame:
    """start, node and least depth of each node that a walk of at least one edge reaches from ``starts`` (column node).

    The start itself is left out, or with ``include_start_on_cycle`` comes out if it lies on a cycle. No depth: no rows.
    """
    e = _edges(edges)
    if most_depth is not None and most_depth < 1:
        return starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).limit(0)
    first = starts.select(F.col("node").alias("start")).distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth"))
    skip = F.lit(True) if include_start_on_cycle else F.col("node") != F.col("start")

    def step(new: DataFrame) -> DataFrame:
        return new.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).where(skip)

    return frontier(first.where(skip), step, ["start", "node"], None if most_depth is None else most_depth - 1)[0]


def closure_with_worst(edges: DataFrame, trust: str, most_rounds: int | None = MOST_ROUNDS) -> DataFrame:
    """src, dst and the trust of each pair joined by a walk: the best over walks of the worst rank on the walk.

    ``trust`` is a numeric column of the edges, greater being worse. Label-correcting: a pair goes into the next round
    whenever a better rank for it was found; pairs of a node with itself are left out.
    """
    e = maybe_broadcast(edges.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min(trust).alias("w")))
    best = materialise(e.select("src", "dst", "w"), "closure")
    new = best
    for _ in rounds(most_rounds):
        longer = new.alias("n").join(e.alias("e"), F.col("n.dst") == F.col("e.src")).where("n.src <> e.dst").groupBy(F.col("n.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.min(F.greatest("n.w", "e.w")).alias("w"))
        better = longer.join(best.select("src", "dst", F.col("w").alias("old")), ["src", "dst"], "left").where("old is null or w < old").drop("old")
        last, (new, about) = new, materialise_counted(better, "closure")
        if not about["n"]:
            break
        old, best = best, materialise(best.unionByName(new).groupBy("src", "dst").agg(F.min("w").alias("w")), "closure")
        release(old, last)
    return best.withColumnRenamed("w", trust)


def bounded_paths(edges: DataFrame, roots: DataFrame, target: Column, most_depth: int = 20, most_paths: int | None = 20, traverse: Column | None = None) -> DataFrame:
    """Walks from each root (column node) to edges that fit ``target``: root, depth, path (nodes) and status.

    Breadth first; each root visits a node once (the first arrival by path order stays). An edge that fits is a hit where
    it is met, traversed or not; only edges that fit ``traverse`` go on. At most ``most_paths`` hits in all, in order of
    root, depth and path; if more exist the last one kept has the status budget_exceeded. Depth or paths of 0: no rows.
    Columns of the edges are at hand in both conditions.
    """
    if most_depth < 1 or most_paths == 0:
        return roots.select(F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit("").alias("status")).limit(0)
    e = maybe_broadcast(edges.where("src is not null and dst is not null").distinct())
    start = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path")).distinct()

    def walked(new: DataFrame) -> DataFrame:
        return new.join(e, F.col("node") == F.col("src")).withColumn("depth", F.col("depth") + 1).withColumn("path", F.concat("path", F.array("dst")))

    def step(new: DataFrame) -> DataFrame:
        x = walked(new)
        x = x if traverse is None else x.where(traverse)
        return x.select("root", F.col("dst").alias("node"), "depth", "path")

    visited, _ = frontier(start, step, ["root", "node"], most_depth - 1, [F.col("depth"), F.col("path")])
    hits = walked(visited).where(target).where(F.col("depth") <= most_depth).select("root", "depth", "path").distinct()
    if most_paths is None:
        return hits.withColumn("status", F.lit("present"))
    top = materialise(hits.orderBy("root", "depth", "path").limit(most_paths + 1), "paths")  # a bounded report
    ranked = top.withColumn("__k", F.row_number().over(Window.orderBy("root", "depth", "path")))
    cut = F.max("__k").over(Window.partitionBy(F.lit(0))) > most_paths
    return ranked.withColumn("status", F.when(cut & (F.col("__k") == most_paths), "budget_exceeded").otherwise("present")).where(F.col("__k") <= most_paths).drop("__k")


def chop(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes (column node) on some walk from a source to a sink, both included: forward reach and backward reach."""
    def side(e: DataFrame, ends: DataFrame) -> DataFrame:
        ends = ends.select("node").distinct()
        return frontier(ends, lambda new: new.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")), ["node"])[0]

    e = _edges(edges)
    back = _edges(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return side(e, sources).join(side(back, sinks), "node", "left_semi")


def components(edges: DataFrame, most_rounds: int | None = MOST_ROUNDS) -> DataFrame:
    """node and component (its least node) of an undirected graph, by hashing to the least neighbour in alternating stars.

    Each round links every node to the least node around it, first the greater neighbours, then all, so that the number
    of rounds follows the logarithm of the size; a star's centre may have very many rows, but is only a grouping value
    of a ``min`` with partial aggregation, never a list.
    """
    digest = F.bit_xor(F.xxhash64("u", "v"))
    pairs, before = materialise_counted(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars", digest=digest)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    for _ in rounds(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.withColumnRenamed("m", "v")).distinct()
        new, after = materialise_counted(small.where("u <> v"), "stars", digest=digest)
        release(pairs)
        pairs = new
        if before == after:  # as many pairs and the same digest: nothing has moved
            break
        before = after
    return nodes.join(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(edges: DataFrame, most_rounds: int | None = MOST_ROUNDS, most_edges: int = MOST_EDGES) -> DataFrame:
    """node and component (its least node) of a directed graph.

    A strong component lies inside one component of the undirected graph. Undirected components of at most
    ``most_edges`` edges are solved in a task each (``components.strong_groups``). Larger ones are cut down first: nodes without an
    edge in or out are components of their own and are peeled off, then the rest is coloured (the least node that reaches
    a node is its colour, and what can reach the colour's node inside the colour is its component), and so on.
    """
    e, about = materialise_counted(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "scc")
    weak = materialise(components(e), "scc")
    at = e.join(weak.select(F.col("node").alias("src"), F.col("component").alias("part")), "src")
    sizes = at.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    # Many small components share a task: on average a quarter of the edges that a single one may have.
    share = F.pmod(F.xxhash64("part"), F.lit(max(8, 4 * about["n"] // most_edges))).cast("int")
    small = at.join(sizes.where(F.col("m") <= most_edges), "part", "left_semi").withColumn("share", share)
    found = strong_groups(small, "share").select("node", "component")
    large, about = materialise_counted(at.join(sizes.where(F.col("m") > most_edges), "part", "left_semi").select("src", "dst"), "scc")
    return found if not about["n"] else found.unionByName(_coloured(large, most_rounds))


def _coloured(e: DataFrame, most_rounds: int | None) -> DataFrame:
    left = materialise(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "scc")
    found: DataFrame | None = None
    for _ in rounds(most_rounds):
        proper = e.where("src <> dst")
        inner, about = materialise_counted(left.join(proper.select(F.col("src").alias("node")), "node", "left_semi").join(proper.select(F.col("dst").alias("node")), "node", "left_semi"), "scc")
        done = left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        if about["n"] == left.count():  # nothing to peel: colour
            release(inner)
            colour = materialise(left.select("node", F.col("node").alias("colour")), "scc")
            changed, about = colour, {"n": 1}
            while about["n"]:
                told = changed.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
                changed, about = materialise_counted(colour.join(told, "node").where("c < colour").select("node", F.col("c").alias("colour")), "scc")
                old, colour = colour, materialise(colour.join(changed.select("node", F.col("colour").alias("c")), "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour")), "scc")
                release(old)
            inside = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", "a")
            back = materialise(inside, "scc")
            members, _ = frontier(colour.where("node = colour").select("node", "colour"), lambda new, back=back: new.join(back, (F.col("node") == F.col("dst")) & (F.col("colour") == F.col("a"))).select(F.col("src").alias("node"), "colour"), ["node"])
            done = members.select("node", F.col("colour").alias("component"))
        done = materialise(done, "scc")
        found = done if found is None else found.unionByName(done)
        left, about = materialise_counted(left.join(done, "node", "left_anti"), "scc")
        if not about["n"]:
            return found
        e = materialise(e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"), "scc")
    raise AssertionError


def call_schedule(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """node, component (its least node) and level: 0 for components without an edge to another one, else one more than the
    greatest level of those it has an edge to. Work in order of the level sees callees before their callers.
    """
    scc = materialise(strong_components(edges, most_edges=most_edges), "schedule")
    a, b = scc.select(F.col("node").alias("src"), F.col("component").alias("a")), scc.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    dag = materialise(edges.where("src is not null and dst is not null").join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct(), "schedule")
    best = materialise(scc.select("component").distinct().withColumn("level", F.lit(0)), "schedule")
    new = best
    for _ in rounds(None):
        up = new.join(dag, F.col("component") == F.col("b")).groupBy(F.col("a").alias("component")).agg((F.max("level") + 1).alias("up"))
        new, about = materialise_counted(best.join(up, "component").where("up > level").select("component", F.col("up").alias("level")), "schedule")
        if not about["n"]:
            break
        best = materialise(best.unionByName(new).groupBy("component").agg(F.max("level").alias("level")), "schedule")
    return scc.join(best, "component").select("node", "component", "level")


def points_to(allocations: DataFrame, copies: DataFrame, stores: DataFrame | None = None, loads: DataFrame | None = None, most_rounds: int | None = MOST_ROUNDS) -> DataFrame:
    """variable and object of an inclusion-based analysis.

    allocations (variable, object); copies (src, dst): dst holds what src holds; stores (base, src): what src holds goes
    into the contents of each object of base; loads (base, dst): dst holds the contents of each object of base. Contents
    of an object are a variable of their own, named ``object.$contents``. Only new facts are joined in each round.
    """
    e = maybe_broadcast(copies.where("src is not null and dst is not null").select("src", "dst").distinct())
    contents = F.concat(F.col("object").cast("string"), F.lit(".$contents"))
    facts = materialise(allocations.where("variable is not null and object is not null").select(F.col("variable").cast("string").alias("variable"), F.col("object").cast("string").alias("object")).distinct(), "pts")
    new, derived = facts, e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    for i in rounds(most_rounds):
        fresh_edges = None
        for table, left, right in ((stores, "src", None), (loads, None, "dst")):
            if table is None:
                continue
            x = new.join(table, F.col("variable") == F.col("base"))
            x = x.select(F.col("src").cast("string").alias("src"), contents.alias("dst")) if left else x.select(contents.alias("src"), F.col("dst").cast("string").alias("dst"))
            fresh_edges = x if fresh_edges is None else fresh_edges.unionByName(x)
        out = new.join(derived, F.col("variable") == F.col("src")).select(F.col("dst").alias("variable"), "object")
        if fresh_edges is not None:
            fresh_edges = materialise(fresh_edges.distinct().join(derived, ["src", "dst"], "left_anti"), "pts")
            out = out.unionByName(facts.join(fresh_edges, F.col("variable") == F.col("src")).select(F.col("dst").alias("variable"), "object"))
            derived = derived.unionByName(fresh_edges)
        new, about = materialise_counted(out.distinct().join(facts, ["variable", "object"], "left_anti"), "pts")
        if not about["n"]:
            break
        facts = facts.unionByName(new)
        if i % JOINED_ROUNDS == JOINED_ROUNDS - 1:
            facts, derived = materialise(facts, "pts"), materialise(derived, "pts")
    return facts


def alias_classes(sets: DataFrame, variable: str, element: str) -> DataFrame:
    """variable, class (the least variable with the same set), size of the set."""
    each = sets.select(F.col(variable).alias("v"), F.col(element).alias("o")).where("v is not null and o is not null").groupBy("v").agg(F.array_sort(F.collect_set("o")).alias("set"))
    least = each.groupBy("set").agg(F.min("v").alias("class"))
    return each.join(least, "set").select(F.col("v").alias("variable"), "class", F.size("set").alias("size"))


def alias_links(sets: DataFrame, variable: str, element: str) -> DataFrame:
    """element, class, members (variables of the class) and size (of its set): what each element joins.

    One row for each element of each distinct set: two variables may be aliases if their classes have an element in
    common, and must be if both are of one class whose size is 1. Linear in the sets, where pairs would not be.
    """
    each = alias_classes(sets, variable, element)
    classes = each.groupBy("class", "size").agg(F.count(F.lit(1)).alias("members"))
    held = sets.select(F.col(variable).alias("class"), F.col(element).alias("element")).where("element is not null").distinct()
    return held.join(classes, "class").select("element", "class", "members", "size")


def alias_pairs(sets: DataFrame, variable: str, element: str, of: DataFrame) -> DataFrame:
    """Aliases of the classes of stated variables (``of``, column variable): left (their class), right, shared, relation.

    Variables with equal sets are one class: a class of several has a row with itself, must if its set is a singleton,
    else may. Another class has a row if it shares an element (may). Classes that are not asked for are never paired.
    """
    classes = alias_classes(sets, variable, element)
    asked = classes.join(of.select("variable").distinct(), "variable", "left_semi").select("class").distinct()
    links = alias_links(sets, variable, element)
    own = links.join(asked, "class", "left_semi").where("members > 1").select("class", "size").distinct()
    own = own.select(F.col("class").alias("left"), F.col("class").alias("right"), F.col("size").cast("long").alias("shared"), F.when(F.col("size") == 1, "must").otherwise("may").alias("relation"))
    left = links.join(asked, "class", "left_semi").select("element", F.col("class").alias("left"))
    pairs = left.join(links.select("element", F.col("class").alias("right")), "element").where(F.col("left") != F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    return own.unionByName(pairs.withColumn("relation", F.lit("may")))


def rapid_types(roots: DataFrame, static_calls: DataFrame, dynamic_calls: DataFrame, instantiations: DataFrame, methods: DataFrame, most_rounds: int | None = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Reached functions and resolved dynamic edges of a rapid type analysis.

    roots (function); static_calls (caller, callee); dynamic_calls (caller, site, method); instantiations (function,
    type): the types a reached function makes; methods (type, method, function). A dynamic call reaches the method of
    each type that some reached function makes. The loop ends when neither functions nor types are new.
    """
    reached = materialise(roots.select("function").distinct(), "rta")
    resolved: DataFrame | None = None
    for _ in rounds(most_rounds):
        types = instantiations.join(reached, "function", "left_semi").select("type").distinct()
        live = dynamic_calls.join(reached.withColumnRenamed("function", "caller"), "caller", "left_semi")
        resolved = live.join(methods.join(types, "type", "left_semi"), "method").select("caller", "site", F.col("function").alias("callee"), "type").distinct()
        out = static_calls.join(reached.withColumnRenamed("function", "caller"), "caller", "left_semi").select(F.col("callee").alias("function"))
        new, about = materialise_counted(out.unionByName(resolved.select(F.col("callee").alias("function"))).distinct().join(reached, "function", "left_anti"), "rta")
        if not about["n"]:
            break
        reached = materialise(reached.unionByName(new), "rta")
    return reached, resolved


#: Actions on dependent rows, the strongest last. Fixed values.
ACTIONS = {"reuse": 0, "verify": 1, "recompute": 2, "quarantine": 3, "drop": 4}


def invalidate(nodes: DataFrame, depends_on: DataFrame, changes: DataFrame, most_rounds: int | None = MOST_ROUNDS) -> DataFrame:
    """node and action of each node: the strongest action that reaches it along its dependencies, reuse where none does.

    changes (node, action); depends_on (node, input). A change goes on to what depends on the changed node.
    """
    order = F.coalesce(*[F.when(F.col("action") == a, F.lit(r)) for a, r in ACTIONS.items()], F.lit(0))
    e = maybe_broadcast(depends_on.where("node is not null and input is not null").select("node", "input").distinct())
    best = materialise(changes.groupBy("node").agg(F.max(order).alias("r")), "inv")
    new = best
    for _ in rounds(most_rounds):
        told = new.withColumnRenamed("node", "input").join(e, "input").groupBy("node").agg(F.max("r").alias("r"))
        last, (new, about) = new, materialise_counted(told.join(best.select("node", F.col("r").alias("old")), "node", "left").where("old is null or r > old").select("node", "r"), "inv")
        if not about["n"]:
            break
        old, best = best, materialise(best.unionByName(new).groupBy("node").agg(F.max("r").alias("r")), "inv")
        release(old, last)
    label = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.coalesce("r", F.lit(0)) + 1)
    return nodes.select("node").distinct().join(best, "node", "left").select("node", label.alias("action"))
