"""Control-flow facts of many small graphs at once: reachability, dominators, post-dominators, control dependence.

A graph is the edges of one function. Its blocks are few and the analyses need them together, so functions are spread over
the cluster and each is solved where its edges lie. A size guard leaves out functions whose relation could be
too large and reports each by a row with the status budget_exceeded instead.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pairs (blocks squared) that the relation of one function may have, where the caller sets no other bound.
MOST_PAIRS = 250_000


def _dominators(nodes: list, preds: dict, entry: object) -> dict:
    """For each node reachable from the entry its dominators, itself included, by intersecting those of its predecessors."""
    succ = defaultdict(list)
    for n, ps in preds.items():
        for p in ps:
            succ[p].append(n)
    order, seen, stack = [], {entry}, [(entry, iter(sorted(succ[entry])))]
    while stack:
        n, it = stack[-1]
        for m in it:
            if m not in seen:
                seen.add(m)
                stack.append((m, iter(sorted(succ[m]))))
                break
        else:
            order.append(n)
            stack.pop()
    order.reverse()
    doms = {n: None for n in order}
    doms[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for n in order[1:]:
            known = [doms[p] for p in preds[n] if p in doms and doms[p] is not None]
            new = set.intersection(*known) | {n} if known else {n}
            if new != doms[n]:
                doms[n], changed = new, True
    return doms


def _immediate(doms: dict) -> dict:
    """The strict dominator that has the most dominators itself."""
    return {n: max((d for d in ds if d != n), key=lambda d: len(doms[d])) for n, ds in doms.items() if len(ds) > 1}


def _one(edges: dict[str, list], entry: object, view: str) -> list[tuple]:
    nodes = sorted(set(edges["src"]) | set(edges["dst"]))
    fwd, back = defaultdict(set), defaultdict(set)
    for a, b in zip(edges["src"], edges["dst"]):
        fwd[a].add(b)
        back[b].add(a)
    out: list[tuple] = []
    if view == "reachable":
        seen, todo = {entry}, [entry]
        while todo:
            for m in fwd[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return [(n, n, n in seen) for n in nodes]
    if view == "dominators":
        doms = _dominators(nodes, back, entry)
        idom = _immediate(doms)
        return [(d, n, idom.get(n) == d) for n, ds in doms.items() for d in ds]
    # Post-dominators: the reverse graph from a virtual exit behind every node without successors.
    exit_ = object()

    class Key:  # sorts after all nodes
        def __lt__(self, other: object) -> bool:
            return False

    exit_ = Key()
    ends = [n for n in nodes if not fwd[n]] or nodes[-1:]
    preds = {n: set(fwd[n]) for n in nodes}
    for n in ends:
        preds[n] = preds[n] | {exit_}
    pdoms = _dominators(nodes, preds, exit_) if ends else {}
    ipdom = _immediate(pdoms)
    if view == "postdominators":
        return [(d, n, ipdom.get(n) is d or ipdom.get(n) == d) for n, ds in pdoms.items() if n is not exit_ for d in ds if d is not exit_]
    for a, b in sorted(set(zip(edges["src"], edges["dst"]))):
        stop, at = ipdom.get(a), b
        if a == b or at in pdoms.get(a, ()):
            continue
        while at is not stop and at is not exit_ and at is not None:
            out.append((a, at, True))
            at = ipdom.get(at)
    return sorted(set(out))


def control_flow(edges: DataFrame, entries: DataFrame, view: str, most_pairs: int | None = MOST_PAIRS) -> DataFrame:
    """function, block, other, immediate and status for a view of each function's graph.

    edges (function, src, dst); entries (function, entry). Views: reachable (block twice, whether it is reachable),
    dominators and postdominators (block dominates other; whether immediately), dependence (other is controlled by an
    edge out of block). Rows with nulls are left out; a function without edges gives no rows. A function whose blocks
    squared exceed ``most_pairs`` (None: no bound) gives a single row with null blocks and the status budget_exceeded; all
    other rows have the status present.
    """
    kinds = dict(edges.dtypes)
    schema = f"function {kinds['function']}, block {kinds['src']}, other {kinds['src']}, immediate boolean, status string"
    clean = edges.where("function is not null and src is not null and dst is not null").select("function", "src", "dst").distinct().join(entries.dropDuplicates(["function"]), "function")
    small, large = clean, None
    if most_pairs is not None:
        blocks = clean.select("function", F.explode(F.array("src", "dst")).alias("b")).distinct().groupBy("function").agg(F.count(F.lit(1)).alias("m"))
        wide = F.col("m") * F.col("m") > most_pairs
        small = clean.join(blocks.where(~wide), "function", "left_semi")
        none = F.lit(None).cast(kinds["src"])
        large = blocks.where(wide).select("function", none.alias("block"), none.alias("other"), F.lit(None).cast("boolean").alias("immediate"), F.lit("budget_exceeded").alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entry, edges = None, None, {"src": [], "dst": []}

        def rows() -> list[tuple]:
            return [(now, *r, "present") for r in _one(edges, entry, view)] if edges["src"] else []

        for b in batches:
            done: list[tuple] = []
            for f, a, c, e in zip(b["function"], b["src"], b["dst"], b["entry"]):
                if f != now:
                    done += rows()
                    now, entry, edges = f, e, {"src": [], "dst": []}
                edges["src"].append(a)
                edges["dst"].append(c)
            if done:
                yield pd.DataFrame(done, columns=["function", "block", "other", "immediate", "status"])
        yield pd.DataFrame(rows(), columns=["function", "block", "other", "immediate", "status"])

    # Functions come one after the other, each whole, so that a task works on many small ones without a group for each.
    out = small.select("function", "src", "dst", "entry").repartition("function").sortWithinPartitions("function").mapInPandas(run, schema)
    return out if large is None else out.unionByName(large)
