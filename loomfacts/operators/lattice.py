"""Abstract interpretation of many small bodies: constant sets, nilness and initialisation of variables at each block.

Bodies are spread over the cluster; the fixpoint of one body runs in one group. Join is slot-wise; a literal set of more
than MOST_LITERALS values is top; loops widen after FUEL visits of a block, so the solver always ends.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

MOST_LITERALS = 4
FUEL = 8
TOP = "top"


def join_values(a: object, b: object) -> object:
    """Union of two literal sets, top beyond the cap; None is bottom."""
    if a is None or b is None:
        return b if a is None else a
    if a == TOP or b == TOP:
        return TOP
    out = a | b
    return out if len(out) <= MOST_LITERALS else TOP


def join_nil(a: str | None, b: str | None) -> str | None:
    if a is None or b is None or a == b:
        return b if a is None else a
    return "maybe"


def _solve(g: pd.DataFrame) -> list[tuple]:
    blocks: dict = defaultdict(list)
    succ: dict = defaultdict(set)
    order: dict = {}
    for r in g.sort_values(["block", "ordinal"], kind="stable").itertuples(index=False):
        order.setdefault(r.block, len(order))
        if r.op == "jump":
            succ[r.block].add(r.source)
        else:
            blocks[r.block].append((r.op, r.target, r.source))
    if not order:
        return []
    entry = next(iter(order))
    state: dict = {entry: {}}
    visits: dict = defaultdict(int)
    todo = [entry]
    while todo:
        b = min(todo, key=lambda x: order.get(x, len(order)))
        todo.remove(b)
        visits[b] += 1
        now = dict(state[b])
        for op, target, source in blocks[b]:
            if op == "const":
                now[target] = (frozenset([source]), "nil" if source == "nil" else "non_nil")
            elif op == "copy":
                now[target] = now.get(source, (TOP, "maybe"))
            elif op == "new":
                now[target] = (TOP, "non_nil")
            else:
                now[target] = (TOP, "maybe")
        for s in sorted(succ[b], key=str):
            old = state.get(s)
            if old is None:
                new = dict(now)
            else:
                new = {}
                for v in old.keys() | now.keys():
                    x, y = old.get(v), now.get(v)
                    if x is None or y is None:  # set on one way only
                        values, nil = (x or y)[0], "maybe"
                        new[v] = (values, nil)
                    else:
                        new[v] = (join_values(x[0], y[0]), join_nil(x[1], y[1]))
                if visits[s] >= FUEL:
                    new = {v: (TOP if old.get(v) != new[v] else new[v][0], new[v][1]) for v in new}
            if new != old:
                state[s] = new
                if s not in todo:
                    todo.append(s)
    out = []
    for b, vs in state.items():
        for v, (values, nil) in vs.items():
            out.append((b, v, TOP if values == TOP else ",".join(sorted(map(str, values))), nil))
    return out


def abstract_values(ops: DataFrame) -> DataFrame:
    """body, block, variable, constants and nilness at the entry of each block.

    ops (body, block, ordinal, op, target, source) as strings and numbers: const (target gets the literal source), copy,
    new, call (unknown value) and jump (source is the next block). The first block in order is the entry.
    """
    kinds = dict(ops.dtypes)
    schema = f"body {kinds['body']}, block {kinds['block']}, variable string, constants string, nilness string"

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in _solve(g)], columns=["body", "block", "variable", "constants", "nilness"])

    return ops.where("body is not null and block is not null").groupBy("body").applyInPandas(run, schema)
