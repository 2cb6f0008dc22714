"""Data flow, lattice, entry points, incremental work and streams on small fixtures."""

import itertools
import random

from pyspark.sql import functions as F

from loomfacts.operators import dataflow as D
from loomfacts.operators import entrypoints as EP
from loomfacts.operators import fixpoint as G
from loomfacts.operators import incremental as I
from loomfacts.operators import lattice as L
from loomfacts.operators import resolution as RS
from loomfacts.streaming import events as S


def test_taint_needs_matching_calls(spark):
    e = spark.createDataFrame(
        [("s", "f", "call", "1"), ("f", "g", "copy", None), ("g", "a", "return", "1"), ("g", "b", "return", "2"), ("a", "k", "copy", None), ("b", "k2", "copy", None), ("s", "c", "copy", None), ("c", "k", "copy", None), ("g", "f", "copy", None)],
        "src string, dst string, kind string, site string",
    )
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "node string")
    got = D.taint_paths(e, nodes("s"), nodes("k", "k2")).collect()
    assert sorted(r["path"] for r in got) == [["s", "c", "k"], ["s", "f", "g", "a", "k"]] and {r["status"] for r in got} == {"present"}
    assert [r["path"] for r in D.taint_paths(e, nodes("s"), nodes("k", "k2"), nodes("c")).collect()] == [["s", "f", "g", "a", "k"]]
    assert [(r["path"], r["status"]) for r in D.taint_paths(e, nodes("s"), nodes("k"), most_paths=1).collect()] == [(["s", "c", "k"], "budget_exceeded")]
    assert D.taint_paths(e.limit(0), nodes("s"), nodes("k")).count() == 0


def test_ranked_paths(spark):
    rng = random.Random(1)
    e = {(a, b): rng.randrange(5) for a in range(6) for b in range(6) if a != b and rng.random() < 0.5}
    got = [tuple(r) for r in D.ranked_paths(spark.createDataFrame([(a, b, p) for (a, b), p in e.items()], "src int, dst int, p int"), spark.createDataFrame([(0, 5)], "start int, end int"), "p", 5, 6).orderBy("rank").collect()]
    every = []
    for n in range(5):
        for mid in itertools.permutations(range(1, 5), n):
            path = [0, *mid, 5]
            if all(s in e for s in zip(path, path[1:])):
                every.append((sum(e[s] for s in zip(path, path[1:])), len(path), path))
    assert [(r[3], r[2]) for r in got] == [(c, p) for c, _, p in sorted(every)[:5]]


def test_slice_and_summaries(spark):
    e = spark.createDataFrame([("a", "b", "copy", True), ("b", "c", "copy", False), ("x", "c", "control", True)], "src string, dst string, kind string, certain boolean")
    seeds = spark.createDataFrame([("c",)], "node string")
    rows, status = D.slice_graph(e, seeds, ["copy"])
    assert {tuple(r) for r in rows.collect()} == {("c", 0), ("b", 1), ("a", 2)} and status.first()["status"] == "unknown"
    assert D.slice_graph(e, seeds, ["copy", "control"], most_depth=1)[1].first()["status"] == "partial"
    calls = spark.createDataFrame([("m", "f"), ("f", "g"), ("g", "f"), ("g", "gone")], "caller string, callee string")
    comps = G.strong_components(calls.where("callee <> 'gone'").select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    own = spark.createDataFrame([("g", "writes"), ("m", "reads")], "function string, effect string")
    got = {tuple(r) for r in D.bottom_up_summaries(calls, own, comps).collect()}
    assert got == {("m", "reads"), ("m", "writes"), ("m", "unresolved"), ("f", "writes"), ("f", "unresolved"), ("g", "writes"), ("g", "unresolved")}


def test_lattice(spark):
    ops = [(1, "a", 0, "const", "x", "1"), (1, "a", 1, "const", "n", "nil"), (1, "a", 2, "jump", None, "b"), (1, "a", 3, "jump", None, "c"), (1, "b", 0, "const", "x", "2"), (1, "b", 1, "new", "n", None), (1, "b", 2, "jump", None, "d"), (1, "c", 0, "copy", "y", "x"), (1, "c", 1, "jump", None, "d"), (1, "d", 0, "call", "z", None), (1, "d", 1, "jump", None, "d")]
    df = spark.createDataFrame(ops, "body int, block string, ordinal int, op string, target string, source string")
    got = {(r["block"], r["variable"]): (r["constants"], r["nilness"]) for r in L.abstract_values(df).collect()}
    assert got[("b", "x")] == ("1", "non_nil") and got[("d", "x")] == ("1,2", "non_nil") and got[("d", "n")] == ("top", "maybe") and got[("d", "y")][1] == "maybe"
    assert L.join_values(frozenset("abc"), frozenset("de")) == L.TOP and L.join_values(None, frozenset("a")) == frozenset("a") and L.join_nil("nil", "non_nil") == "maybe"
    assert L.abstract_values(df.limit(0)).count() == 0


def test_entrypoints(spark):
    x = spark.createDataFrame([("1", "f", "http_route", None, "/a/:id"), ("2", "f", "http_route", "get", "/a"), ("3", "g", "test", None, None), ("4", "g", "odd", None, None)], "entrypoint string, function string, kind string, method string, path string")
    got = {(r[0], r[1]) for r in EP.trust_boundaries(x).collect()}
    assert got == {("1", "path_param"), ("1", "query_string"), ("1", "request_body"), ("1", "request_header"), ("2", "query_string"), ("2", "request_header"), ("4", "unknown")}
    assert {r["entrypoint"]: r["edge_kind"] for r in EP.dispatch_edges(x).collect()} == {"1": "route", "2": "route", "3": "test", "4": "lifecycle"}
    m = spark.createDataFrame([("a", "b", "s", ["e"]), ("", "b", "s", ["e"]), ("*", "b", "s", ["e"]), ("a", "zz", "s", ["e"]), ("a", "b", None, ["e"]), ("a", "b", "s", [])], "source string, target string, scope string, evidence array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    reasons = sorted(str(r["reason"]) for r in EP.validate_models(m, known).collect())
    assert reasons == ["None", "broad_source", "empty_evidence", "empty_scope", "empty_source", "unknown_target"]


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1", "p"), ("y", "1", "p"), ("z", "1", None)], "k string, c string, a string")
    b = spark.createDataFrame([("x", "2", "p"), ("y", "2", "q"), ("z", "1", None), ("n", "1", "p")], "k string, c string, a string")
    got = {r["key"]: (r["change"], r["action"]) for r in I.change_rows(a, b, "k", {"content": "c", "api": "a"}).collect()}
    assert got == {"x": ("content", "verify"), "y": ("api", "recompute"), "n": ("added", "recompute")}
    d1, d2 = (I.input_digests(t.withColumn("g", F.lit(1)), ["g"], "k", "c").first() for t in (a, b.where("k <> 'n'")))
    assert d1["inputs"] == d2["inputs"] == 3 and d1["digest"] != d2["digest"]
    old = spark.createDataFrame([("u", "1"), ("v", "1")], "node string, digest string")
    new = spark.createDataFrame([("u", "1"), ("v", "2"), ("w", "1")], "node string, digest string")
    assert sorted(r["node"] for r in I.early_cutoff(new, old).collect()) == ["v", "w"]
    assert I.dependency_index(spark.createDataFrame([("a", "b"), ("a", "b"), (None, "b")], "node string, input string")).count() == 2


def test_alias_classes(spark):
    s = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1"), ("r", "2"), ("t", "2"), ("u", None)], "v string, o string")
    assert {r["variable"]: r["class"] for r in G.alias_classes(s, "v", "o").collect()} == {"p": "p", "q": "p", "r": "r", "t": "t"}
    asked = spark.createDataFrame([("q",), ("t",)], "variable string")
    assert {tuple(r) for r in G.alias_pairs(s, "v", "o", asked).collect()} == {("p", "p", 1, "must"), ("p", "r", 1, "may"), ("t", "r", 1, "may")}
    assert sum(r["members"] for r in G.alias_links(s, "v", "o").where("size = 1").collect()) == 3


def test_stream_with_late_rows(spark, tmp_path):
    rows = [(1, "2025-01-01 01:00:00", 1, "a", 1.0), (2, "2025-01-02 01:00:00", 1, "b", 2.0), (2, "2025-01-02 01:00:00", 1, "b", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    stream = S.read_stream(spark, str(tmp_path / "e.parquet"), df.schema)
    once = S.run_available(S.latest_ids(stream), "append")
    assert once.count() == 2
    counts = S.run_available(S.windowed_counts(S.read_stream(spark, str(tmp_path / "e.parquet"), df.schema)).select(F.col("w.start").alias("d"), "event_type", "events"), "update", ("d", "event_type"))
    assert sorted((r["event_type"], r["events"]) for r in counts.collect()) == [("a", 1), ("b", 2)]


def test_resolution(spark):
    calls = spark.createDataFrame([(1, 1, 0, "f"), (1, 2, 0, "g"), (1, 3, 0, "h"), (1, 4, 0, "a.b"), (1, 5, 0, "len"), (1, 6, 0, "zz")], "id long, line_no int, position int, callee string")
    symbols = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g"), (2, "h"), (3, "h")], "id long, name string")
    got = {r["callee"]: (r["status"], r["algorithm"], r["target"], r["reason"]) for r in RS.call_targets(calls, symbols, ["len"]).collect()}
    assert got == {"f": ("resolved", "lexical", 1, None), "g": ("resolved", "import_binding", 2, None), "h": ("ambiguous", None, None, None), "a.b": ("unresolved", None, None, "dynamic"), "len": ("unresolved", None, None, "builtin"), "zz": ("unresolved", None, None, "not_found")}
    one = spark.createDataFrame([("a", "b", "resolved", "exact")], "caller string, callee string, status string, precision string")
    assert [r["tier"] for r in RS.tiered_edges(one.limit(0), one, one).collect()] == ["site"]
    flags = spark.createDataFrame([(True, True, None), (None, True, False), (None, None, None)], "dynamic boolean, ambiguous boolean, duplicate boolean")
    assert [r[0] for r in flags.select(RS.requirement_status({c: F.col(c) for c in flags.columns})).collect()] == ["dynamic", "ambiguous", "resolved"]
    files = spark.createDataFrame([("src/a/x.ts",), ("test/a/y.ts",), ("test/b/z.ts",)], "relative_path string")
    assert [tuple(r) for r in RS.paired_paths(files, "^src/([^/]+)/", "^test/([^/]+)/").collect()] == [("a", "src/a/x.ts", "test/a/y.ts")]
    rel = spark.createDataFrame([(1, "a", "b", True)], "function int, block string, other string, immediate boolean")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "b"), (1, None, "b"), (2, "x", "y")], "function int, candidate string, event string")
    assert sorted((str(r["candidate"]), r["event"], r["holds"]) for r in RS.dominance_holds(pairs, rel).collect()) == [("None", "b", True), ("a", "b", True), ("b", "a", False), ("b", "b", True), ("x", "y", True)]


def test_dense_ids_and_graph_text(spark):
    keys = [f"k{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(k, 1) for k in keys * 2] + [(None, 1)], "key string, dense int").repartition(6)
    assert {r["key"]: r["dense_id"] for r in RS.dense_ids(df, "key").collect()} == {k: i for i, k in enumerate(keys)} | {None: None}
    assert [r[0] for r in RS.dot_lines(spark.createDataFrame([('a"', "b")], "src string, dst string")).collect()] == ['  "a\\"" -> "b";']


def test_interprocedural_edges(spark):
    got = RS.interprocedural_edges(
        spark.createDataFrame([("a", "c")], "src string, dst string"), spark.createDataFrame([("s1", "c", "d", "f"), ("s2", "d", "e", None)], "site string, at string, after string, callee string"),
        spark.createDataFrame([("f", "f_in")], "function string, node string"), spark.createDataFrame([("f", "f_out")], "function string, node string"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "c", "intra", None), ("c", "f_in", "call", "s1"), ("f_out", "d", "return", "s1"), ("c", "d", "call_to_return", "s1"), ("d", "e", "call_to_return", "s2")], key=str)
