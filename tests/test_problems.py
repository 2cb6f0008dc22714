"""The general problems: snapshots, heavy keys, percentiles; against brute force on small fixtures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomfacts.operators.ordered import ordered_neighbours
from loomfacts.operators.quantiles import State, _parts, merge_sketches, quantiles, sketch
from loomfacts.operators import snapshot_diff as SD
from loomfacts.operators.tree_aggregate import fan_in_rounds, heavy_keys, per_key_results, tree_aggregate
from pyspark.sql import functions as F

DIAG = "series_id long, snapshot_id long, rule_id string, file string, severity string, message string, text_range struct<start_line:int,end_line:int>, stable_fingerprint string, ingested_at timestamp, extra string"
SNAP = "snapshot_id long, series_id long, status string, taken_at timestamp, leaf int, salt int"
CONTENT = ["rule_id", "file", "severity", "message", "text_range"]
T0 = dt.datetime(2025, 1, 1)


def brute(diag, snaps):
    held = defaultdict(dict)
    for r in diag:
        if r[7] is not None:
            k = (r[0], r[1])
            old = held[k].get(r[7])
            if old is None or (r[8] or dt.datetime.min) > (old[8] or dt.datetime.min):
                held[k][r[7]] = r
    by = defaultdict(set)
    for s in snaps:
        if s[2] == "complete":
            by[s[1]].add((s[3], s[0]))
    out = set()
    for series, order in by.items():
        order = sorted(order)
        for (_, a), (_, b) in zip(order, order[1:]):
            x, y = held[(series, a)], held[(series, b)]
            for fp in x.keys() | y.keys():
                kind = "added" if fp not in x else "removed" if fp not in y else "changed" if x[fp][2:7] != y[fp][2:7] else None
                if kind:
                    out.add((series, a, b, fp, kind))
    return out


def make(seed, series=6, keys=12):
    rng = random.Random(seed)
    diag, snaps, sid = [], [], 0
    for s in range(series):
        for k in range(rng.randint(1, 6)):
            sid += 1
            snaps.append((sid, s, rng.choice(["complete"] * 4 + ["aborted"]), T0 + dt.timedelta(hours=rng.random() * 900 + k), 1, 2))
            if rng.random() < 0.15:
                continue
            for key in rng.sample(range(keys), rng.randint(0, keys)):
                for _ in range(rng.choice([1, 1, 1, 2])):
                    lo = rng.choice([None, 1, 2])
                    diag.append((s, sid, rng.choice([None, "a", "b"]), rng.choice([None, "f"]), "warn", rng.choice([None, "m", "n"]), (lo, rng.choice([None, 3])), rng.choice([f"k{key}"] * 9 + [None]), T0 + dt.timedelta(seconds=len(diag)), "x"))
    return diag + rng.sample(diag, min(3, len(diag))), snaps + snaps[:2]


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, False)])
def test_snapshot_diff(spark, monkeypatch, seed, hot):
    if hot:  # every series above the share is cut into hash ranges
        monkeypatch.setattr(SD, "max", lambda *a: 3, raising=False)
    diag, snaps = make(seed)
    got = SD.snapshot_diff(spark.createDataFrame(diag, DIAG), spark.createDataFrame(snaps, SNAP), CONTENT, leaf_rows=1 if hot else 4).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(diag, snaps)


def test_snapshot_diff_empty(spark):
    none = SD.snapshot_diff(spark.createDataFrame([], DIAG), spark.createDataFrame([], SNAP), CONTENT)
    assert none.columns == ["series_id", "prev_snapshot_id", "snapshot_id", "stable_fingerprint", "change"] and none.count() == 0


def test_content_hash_tells_nulls_apart(spark):
    d = spark.createDataFrame([(None, "a", (1, None)), ("a", None, (1, None)), ("a", None, (None, 1)), ("a", None, None)], "x string, y string, z struct<p:int,q:int>")
    assert d.select(SD.content_hash(d, ["x", "y", "z"])).distinct().count() == 4


def test_neighbours_across_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(400)]
    rng.shuffle(rows)
    got = ordered_neighbours(spark.createDataFrame(rows, "g string, o long"), "g", ["o"], "o").collect()
    by = defaultdict(list)
    for g, o in sorted(rows, key=lambda r: r[1]):
        by[g].append(o)
    want = {(g, o, v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None) for g, v in by.items() for i, o in enumerate(v)}
    assert set(map(tuple, got)) == want


def test_tree_rounds():
    assert fan_in_rounds(1, 4) == [] and fan_in_rounds(5, 4) == [2, 1] and fan_in_rounds(64, 4) == [16, 4, 1]
    with pytest.raises(ValueError):
        fan_in_rounds(3, 1)


def test_heavy_and_per_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 30 + [f"r{i}" for i in range(60)] + [None]), rng.choice(["f1", None, "f2"]), rng.randrange(9), T0 + dt.timedelta(seconds=i)) for i in range(1200)]
    d = spark.createDataFrame(rows, "rule_id string, file string, series_id long, ingested_at timestamp").repartition(7)
    heavy = {tuple(r) for r in heavy_keys(d, ["rule_id", "file"], 0.03, 2).collect()}
    want = {(k, v, n) for k, i in (("rule_id", 0), ("file", 1)) for v, n in Counter(r[i] for r in rows).items() if v is not None and n >= 36}
    assert heavy == want
    got = {(r[0], r[1]): tuple(r)[2:] for r in per_key_results(d, ["rule_id", "file"], fan_in=2, buckets=4).collect()}
    for k, i in (("rule_id", 0), ("file", 1)):
        for v in {r[i] for r in rows}:
            mine = [r for r in rows if r[i] == v]
            assert got[(k, v)] == (len(mine), len({r[2] for r in mine}), max(r[3] for r in mine))
    assert heavy_keys(d.limit(0), ["rule_id"]).count() == 0


def test_tree_aggregate_names(spark):
    with pytest.raises(ValueError):
        tree_aggregate(spark.range(3), ["id"], {"a": F.count("id")}, {"b": F.sum("a")})


def rank_error(values, q, p):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, q, "left") + 1, np.searchsorted(s, q, "right")
    k = max(1, int(np.ceil(round(p * len(values), 9))))
    return max(0, lo - k, k - hi)


def test_state_error_is_a_bound():
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.lognormal(3, 2, 60_000).astype(np.int64), np.zeros(9000, np.int64)])
    rng.shuffle(values)
    total = State()
    for part in np.array_split(values, 9):
        s = State()
        for x in np.array_split(part, 40):
            s.add(x)
        n, e, levels, buffers, tail = s.row()
        total.merge(_parts(levels, buffers), tail, n, e)
    n, error, levels, buffers, tail = total.row()
    assert n == len(values) and 0 < error < 0.01 * n
    v = np.concatenate([*_parts(levels, buffers).values(), tail])
    w = np.concatenate([*[np.full(len(x), 1 << k) for k, x in _parts(levels, buffers).items()], np.ones(len(tail), int)])
    assert w.sum() == n
    by = np.argsort(v, kind="stable")
    up = np.cumsum(w[by])
    for p in (0.01, 0.2, 0.5, 0.9, 0.999):
        assert rank_error(values, v[by[np.searchsorted(up, np.ceil(p * n))]], p) <= error


def test_sketches_combine(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["s", "s", "s", "t", None]), rng.randrange(4), rng.choice([None, 0, 5, rng.randrange(10**12)]), rng.randrange(50)) for _ in range(3000)]
    d = spark.createDataFrame(rows, "suite string, day int, a long, b long").repartition(5)
    days = sketch(d, ["suite", "day"], ["a", "b"], fan_in=2)
    got = quantiles(merge_sketches(days, ["suite", "measure"]), ["suite", "measure"], [0.1, 0.5, 1.0]).collect()
    for r in got:
        mine = [x[2 if r["measure"] == "a" else 3] for x in rows if x[0] == r["suite"]]
        mine = [x for x in mine if x is not None]
        assert r["n"] == len(mine) and rank_error(np.array(mine), r["quantile"], r["probability"]) <= r["rank_error"]
    assert len(got) == 3 * 2 * 3
    assert quantiles(sketch(d.limit(0), ["suite"], ["a"], chunks=1), ["suite", "measure"], [0.5]).count() == 0


def test_sketch_of_doubles_and_decimals(spark):
    from decimal import Decimal

    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.choice([None, -0.0, 0.0, float("inf"), rng.uniform(-5, 5)]), Decimal(rng.randrange(-999, 999)) / 100) for _ in range(500)] + [("z", None, None)]
    d = spark.createDataFrame(rows, "suite string, x double, y decimal(12,2)")
    got = quantiles(sketch(d, ["suite"], ["x", "y"]), ["suite", "measure"], [0.1, 0.5, 1.0], {"x": "double", "y": "decimal(12,2)"}).collect()
    assert {r["suite"] for r in got} == {"a", None}
    for r in got:
        v = sorted(float(x[1 if r["measure"] == "x" else 2]) for x in rows if x[0] == r["suite"] and x[1 if r["measure"] == "x" else 2] is not None)
        assert r["n"] == len(v) and r["quantile"] == v[max(1, int(np.ceil(round(r["probability"] * len(v), 9)))) - 1] and r["rank_error"] == 0
    with pytest.raises(TypeError):
        sketch(d.selectExpr("suite", "cast(y as decimal(30,2)) as y"), ["suite"], ["y"])
