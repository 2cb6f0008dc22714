"""Strong components of many small graphs at once, one task a group."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame


def tarjan(edges: list[tuple]) -> list[list]:
    """Strong components in an order in which each comes after all that it has edges to. No recursion."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    held: list = []
    on: set = set()
    found: list[list] = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = len(index)
                    held.append(m)
                    on.add(m)
                    work.append((m, iter(out[m])))
                    break
                if m in on:
                    low[node] = min(low[node], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = [held.pop()]
                    while part[-1] != node:
                        part.append(held.pop())
                    on.difference_update(part)
                    found.append(part)
    return found


def strong_groups(edges: DataFrame, group: str) -> DataFrame:
    """group, node and component (its least node) of the graph (src, dst) of each group, which has to fit into a task."""
    kinds = dict(edges.dtypes)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], n, min(part)) for part in tarjan(list(zip(g["src"], g["dst"]))) for n in part]
        return pd.DataFrame(rows, columns=["group", "node", "component"])

    return edges.select(group, "src", "dst").groupBy(group).applyInPandas(run, f"group {kinds[group]}, node {kinds['src']}, component {kinds['src']}")
