"""Sizes at which sums overflowed or loops and searches stopped without saying so."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomfacts.operators import components as K
from loomfacts.operators import control_flow as C
from loomfacts.operators import dataflow as D
from loomfacts.operators import fixpoint as G
from loomfacts.operators import incremental as I
from loomfacts.operators import ordered as O
from loomfacts.operators import report as R
from loomfacts.operators import snapshot_diff as SD


def test_snapshots_that_gain_millions_of_rows(spark):
    """A hot series that gains 3,000,000 rows and one below the salting bound that gains 30,000: no sum overflows."""
    at = dt.datetime(2025, 1, 1)
    snaps = spark.createDataFrame([(s * 10 + k, s, "complete", at + dt.timedelta(days=k)) for s in (1, 2) for k in (0, 1)], "snapshot_id long, series_id long, status string, taken_at timestamp")
    hot = spark.range(3_000_000).select(F.lit(1).cast("long").alias("series_id"), F.lit(11).cast("long").alias("snapshot_id"), F.col("id").cast("string").alias("stable_fingerprint"))
    calm = spark.range(30_000).select(F.lit(2).cast("long").alias("series_id"), F.lit(21).cast("long").alias("snapshot_id"), F.col("id").cast("string").alias("stable_fingerprint"))
    rows = hot.unionByName(calm).withColumn("rule_id", F.lit("r")).withColumn("ingested_at", F.lit(at))
    got = SD.snapshot_diff(rows, snaps, ["rule_id"]).groupBy("series_id", "change").count().collect()
    assert {tuple(r) for r in got} == {(1, "added", 3_000_000), (2, "added", 30_000)}


def test_digest_of_many_inputs(spark):
    rows = spark.range(300_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("k"), F.lit("c").alias("c"))
    one = I.input_digests(rows, ["g"], "k", "c").first()
    assert one["inputs"] == 300_000 and one["digest"] == I.input_digests(rows.repartition(7), ["g"], "k", "c").first()["digest"]
    changed = rows.withColumn("c", F.when(F.col("k") == "7", "d").otherwise(F.col("c")))
    assert one["digest"] != I.input_digests(changed, ["g"], "k", "c").first()["digest"]
    twice = [I.input_digests(spark.createDataFrame([("g", x, "c")] * 2, "g string, k string, c string"), ["g"], "k", "c").first()["digest"] for x in ("a", "b")]
    assert twice[0] != twice[1]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_long_chains_end_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(G, "JOINED_ROUNDS", 4)
    n = 14
    e = edges_of(spark, [(i, i + 1) for i in range(n)])
    start = spark.createDataFrame([(0,)], "node long")
    assert G.reachable(e, start).count() == n
    assert {tuple(r) for r in G.strong_components(e).collect()} == {(i, i) for i in range(n + 1)}
    calls = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(6)], "caller string, callee string")
    none = {"dynamic_calls": "caller string, site string, method string", "instantiations": "function string, type string", "methods": "type string, method string, function string"}
    reached, _ = G.rapid_types(spark.createDataFrame([("f0",)], "function string"), calls, *[spark.createDataFrame([], s) for s in none.values()])
    assert reached.count() == 7


def brute_components(pairs):
    out = defaultdict(set)
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for s in nodes:
                if a in reach[s] and b not in reach[s]:
                    reach[s].add(b)
                    changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}, out


@pytest.mark.parametrize("most", [500_000, 5])
def test_strong_components_and_schedule(spark, most):
    rng = random.Random(most)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(14)} | {(100, 101), (101, 100), (101, 102), (200, 200)})
    want, _ = brute_components(pairs)
    e = edges_of(spark, pairs)
    assert {r["node"]: r["component"] for r in G.strong_components(e, most_edges=most).collect()} == want
    level = {r["node"]: r["level"] for r in G.call_schedule(e, most_edges=most).collect()}
    for a, b in pairs:
        assert level[a] > level[b] or want[a] == want[b]
    assert G.strong_components(e.limit(0)).count() == 0
    order = [frozenset(p) for p in K.tarjan(pairs)]
    assert {min(p): p for p in order} == {c: frozenset(n for n in want if want[n] == c) for c in set(want.values())}


def test_taint_finds_the_one_path_among_dead_ends(spark):
    e = spark.createDataFrame([("s", f"n{i:02d}", "copy", None) for i in range(20)] + [("n19", "k", "copy", None)], "src string, dst string, kind string, site string")
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    assert [(r["path"], r["status"]) for r in D.taint_paths(e, node("s"), node("k"), most_paths=1, most_states=1).collect()] == [(["s", "n19", "k"], "present")]


def test_taint_says_what_a_bound_left_out(spark):
    chain = [(f"n{i}", f"n{i + 1}", "copy", None) for i in range(6)]
    wide = [("n0", f"m{i}", "copy", None) for i in range(4)] + [(f"m{i}", "n6", "copy", None) for i in range(4)]
    kinds = "src string, dst string, kind string, site string"
    node = lambda x: spark.createDataFrame([(x,)], "node string")
    short = D.taint_paths(spark.createDataFrame(chain, kinds), node("n0"), node("n6"), most_depth=3).collect()
    assert [(r["source"], r["path"], r["status"]) for r in short] == [("n0", None, "budget_exceeded")]
    cut = D.taint_paths(spark.createDataFrame(chain + wide, kinds), node("n0"), node("n6"), most_states=2).collect()
    assert cut and [r["status"] for r in sorted(cut, key=lambda r: (r["depth"], r["path"]))][-1] == "budget_exceeded"
    assert all(r["status"] == "present" for r in D.taint_paths(spark.createDataFrame(chain + wide, kinds), node("n0"), node("n6")).collect())


def test_control_flow_of_a_large_function(spark):
    e = spark.createDataFrame([("big", i, i + 1) for i in range(2000)] + [("small", 0, 1)], "function string, src long, dst long")
    entry = spark.createDataFrame([("big", 0), ("small", 0)], "function string, entry long")
    got = C.control_flow(e, entry, "reachable")
    assert {(r["function"], r["status"]) for r in got.collect()} == {("big", "budget_exceeded"), ("small", "present")}
    whole = C.control_flow(e, entry, "reachable", most_pairs=None)
    assert whole.where("function = 'big' and immediate and status = 'present'").count() == 2001


def test_numbers_and_top_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b"]), i, rng.randrange(50)) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, id long, v int")
    want, seen = {}, defaultdict(int)
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        want[i] = seen[g]
        seen[g] += 1
    got = O.ordered_numbers(d, ["g"], [F.col("v"), F.col("id")], "n")
    assert {r["id"]: r["n"] for r in got.collect()} == want
    top = R.top_k(d, "g", [F.col("v"), F.col("id")], 3).collect()
    assert {(r["id"], r["rank"]) for r in top} == {(i, n + 1) for i, n in want.items() if n < 3}
    assert all(r["truncated"] == (r["rank"] == 3) for r in top)
    assert O.ordered_numbers(d.limit(0), ["g"], [F.col("v")], "n").count() == 0
