"""Percentiles of very many values with a stated error, from mergeable states of collapsed buffers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_chunks
from .tree_aggregate import fan_in_rounds

#: Values of a buffer. A state has at most one full buffer a level and one that is not full.
BUFFER = 2048


class State:
    """A multiset of values, as buffers of equal size: a buffer of level l stands for 2**l times its values.

    Two buffers of one level collapse to one of the next by taking every second value of their merged order, from the
    first or the second place in turn, so the choice needs no random numbers. Each collapse at level l can move a rank
    by at most 2**l; ``error`` adds this up, so a rank read from the state is off by at most ``error``.
    """

    __slots__ = ("full", "tail", "n", "error", "turn")

    def __init__(self) -> None:
        self.full: dict[int, np.ndarray] = {}
        self.tail = np.empty(0, np.int64)
        self.n = self.error = self.turn = 0

    def add(self, values: np.ndarray) -> None:
        """Adds values of weight one."""
        self.n += len(values)
        self.tail = np.concatenate([self.tail, values]) if len(self.tail) else values
        if len(self.tail) >= BUFFER:
            whole = len(self.tail) // BUFFER * BUFFER
            for i in range(0, whole, BUFFER):
                self._carry(0, np.sort(self.tail[i : i + BUFFER]))
            self.tail = self.tail[whole:]

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while (other := self.full.pop(level, None)) is not None:
            merged = np.sort(np.concatenate([other, buffer]), kind="stable")
            buffer = merged[self.turn :: 2]
            self.turn ^= 1
            self.error += 1 << level
            level += 1
        self.full[level] = buffer

    def merge(self, full: dict[int, np.ndarray], tail: np.ndarray, n: int, error: int) -> None:
        self.add(tail)
        self.n += n - len(tail)
        self.error += error
        for level in sorted(full):
            self._carry(level, full[level])

    def row(self) -> tuple:
        levels = sorted(self.full)
        return self.n, self.error, levels, np.concatenate([self.full[x] for x in levels]) if levels else np.empty(0, np.int64), self.tail


_STATE = "n long, error long, levels array<int>, buffers array<long>, tail array<long>"
_COLUMNS = ["n", "error", "levels", "buffers", "tail"]


def _parts(levels: Sequence[int], buffers: np.ndarray) -> dict[int, np.ndarray]:
    b = np.asarray(buffers, np.int64)
    return {int(x): b[i * BUFFER : (i + 1) * BUFFER] for i, x in enumerate(levels)}


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _scale(kind: str) -> int:
    """Digits behind the point of a decimal type; raises for types whose values have no place in a 64-bit integer."""
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    if not m or int(m[1]) > 18:
        raise TypeError(f"no percentiles of {kind}: cast to double or decimal(18, s)")
    return int(m[2])


def _to_long(v: pd.Series, kind: str) -> np.ndarray:
    """Non-null values as integers in the same order: decimals by their unscaled value, doubles by their bits."""
    if kind in _INTEGERS:
        return v.to_numpy(np.int64)
    if kind in ("float", "double"):
        bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)  # adding zero makes -0.0 equal 0.0
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    scale = _scale(kind)
    return np.fromiter((int(x.scaleb(scale)) for x in v), np.int64, len(v))


def _from_long(x: int, kind: str) -> float:
    if kind in ("float", "double"):
        bits = np.int64(x)
        return float((bits ^ np.int64(0x7FFFFFFFFFFFFFFF) if bits < 0 else bits).view(np.float64))
    return x / 10 ** _scale(kind) if kind not in _INTEGERS else float(x)


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str], fan_in: int = 16, chunks: int | None = None) -> DataFrame:
    """A state for each group of ``keys`` and each column of ``values`` (as ``measure``).

    Each partition is sorted by ``keys`` where it is read, and a group's states are handed on as soon as it ends, so a
    task holds the states of one group, however many groups there are. The states of a group, one for each input
    partition, are merged in rounds of at most ``fan_in``, so no task gets all rows or all states of a large group.
    ``chunks`` is the number of partitions of ``df`` (needed if it comes from a shuffle). Values may be integers, floats,
    doubles or decimals of at most 18 digits. Null values are left out (NaN is the greatest value), a group without values
    gives no row; null keys form a group; ties and repeated rows all count; an empty table gives no rows.
    """
    chunks = chunks or input_chunks(df)
    types = dict(df.dtypes)
    for v in values:
        if types[v] not in (*_INTEGERS, "float", "double"):
            _scale(types[v])
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", measure string, chunk int, {_STATE}"
    key_list, value_list = list(keys), list(values)
    kinds = {v: types[v] for v in values}
    columns_out = [*key_list, "measure", "chunk", *_COLUMNS]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        states: dict[str, State] = {}
        chunk = 0

        def rows() -> list[tuple]:
            return [(*now, v, chunk, *s.row()) for v, s in states.items() if s.n]

        for b in batches:
            if not len(b):
                continue
            chunk = int(b["__chunk"].iloc[0])
            # The batch is sorted by the keys, so groups are runs of equal keys (null being equal to null).
            new = np.zeros(len(b), bool)
            for k in key_list:
                x = pd.factorize(b[k], use_na_sentinel=False)[0]
                new[1:] |= x[1:] != x[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            ends = np.concatenate([starts[1:], [len(b)]])
            longs = {}
            for v in value_list:
                there = b[v].notna().to_numpy() if kinds[v] not in ("float", "double") else ~b["__null_" + v].to_numpy(bool)
                at = np.concatenate([[0], np.cumsum(there)])
                longs[v] = (_to_long(b[v][there], kinds[v]), at)
            done = []
            for lo, hi, k in zip(starts, ends, b.iloc[starts][key_list].itertuples(index=False, name=None)):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k != now:
                    if now is not None:
                        done += rows()
                    now, states = k, {v: State() for v in value_list}
                for v in value_list:
                    values_of, at = longs[v]
                    if at[hi] > at[lo]:
                        states[v].add(values_of[at[lo] : at[hi]])
            if done:
                yield pd.DataFrame(done, columns=columns_out)
        if now is not None:
            yield pd.DataFrame(rows(), columns=columns_out)

    nulls = [F.col(v).isNull().alias(f"__null_{v}") for v in values if types[v] in ("float", "double")]
    out = df.select(*keys, *values, *nulls, F.spark_partition_id().alias("__chunk")).sortWithinPartitions(*keys).mapInPandas(build, schema)
    for left in fan_in_rounds(chunks, fan_in):
        out = merge_sketches(out.withColumn("chunk", F.col("chunk") % F.lit(left)), [*keys, "measure", "chunk"])
    return out.drop("chunk")


def merge_sketches(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state for each group of ``keys``, from all its states; errors add up."""
    types = dict(states.dtypes)
    key_list = list(keys)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {_STATE}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        state = State()
        for b in batches:
            done = []
            for *k, n, error, levels, buffers, tail in b[[*key_list, *_COLUMNS]].itertuples(index=False, name=None):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k != now:
                    if now is not None:
                        done.append((*now, *state.row()))
                    now, state = k, State()
                state.merge(_parts(levels, buffers), np.asarray(tail, np.int64), n, error)
            if done:
                yield pd.DataFrame(done, columns=[*key_list, *_COLUMNS])
        if now is not None:
            yield pd.DataFrame([(*now, *state.row())], columns=[*key_list, *_COLUMNS])

    return states.select(*keys, *_COLUMNS).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def quantiles(states: DataFrame, keys: Sequence[str], probabilities: Sequence[float], kinds: dict[str, str] | None = None) -> DataFrame:
    """For each state and probability: n, quantile, and rank_error, the most by which its rank can be off.

    The quantile of probability p is the value of rank ceil(p * n), at least 1. ``kinds`` gives the type of each measure
    where not all are integers; the quantiles are doubles then.
    """
    types = dict(states.dtypes)
    key_list, ps = list(keys), list(probabilities)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", n long, probability double, quantile {'double' if kinds else 'long'}, rank_error long"
    measure = key_list.index("measure") if kinds else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *k, n, error, levels, buffers, tail in b[[*key_list, *_COLUMNS]].itertuples(index=False, name=None):
                parts = [*_parts(levels, buffers).items(), (0, np.asarray(tail, np.int64))]
                v = np.concatenate([x for _, x in parts])
                w = np.concatenate([np.full(len(x), 1 << level) for level, x in parts])
                if not len(v):
                    continue
                by = np.argsort(v, kind="stable")
                up = np.cumsum(w[by])
                for p in ps:
                    at = int(np.searchsorted(up, max(1, int(np.ceil(round(p * n, 9))))))
                    x = int(v[by[min(at, len(v) - 1)]])
                    rows.append((*k, n, p, _from_long(x, kinds[k[measure]]) if kinds else x, error))
            yield pd.DataFrame(rows, columns=[*key_list, "n", "probability", "quantile", "rank_error"])

    return states.mapInPandas(run, schema)
