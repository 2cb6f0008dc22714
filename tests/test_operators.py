"""Report, graph, policy and source operators on small fixtures, against brute force."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomfacts import rules as RU
from loomfacts.operators import control_flow as C
from loomfacts.operators import evaluation as E
from loomfacts.operators import fixpoint as G
from loomfacts.operators import policy as P
from loomfacts.operators import report as R
from loomfacts.sources import files as SF
from loomfacts.sources import sinks as SK
from loomfacts.views import ChangedFiles, FactViews

DIAG = SF.DIAGNOSTIC


def d(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], (r[3], 1, r[4], 9), r[5], None, [], r[6]) for r in rows], DIAG)


def test_dedupe_and_occurrences(spark):
    x = d(spark, [("b", "warn", "f", 5, 5, "m", "k"), ("a", "warn", "f", 2, 2, "m", "k"), ("a", "warn", "f", 2, 2, "m", None), ("a", "warn", "f", 2, 2, "m", None)])
    assert sorted((r["rule_id"], r["stable_fingerprint"] or "") for r in R.dedupe(x).collect()) == [("a", ""), ("a", ""), ("a", "k")]
    y = d(spark, [("a", "warn", "f", n, n, "m", "k") for n in (3, 1, 2)])
    assert sorted((r["text_range"]["start_line"], r["occurrence"]) for r in R.occurrences(y).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert R.dedupe(x.limit(0)).count() == 0


def test_baseline_matching(spark):
    cols = "rule_id string, file string, fp string, message string, o int"
    now = spark.createDataFrame([("r", "f", "k", "m", 1), ("r", "f", "k", "m", 2), ("r", "g", "z", "moved", 1), ("r", "h", "y", "twice", 1), ("r", "i", "y", "twice", 1), ("q", "f", "n", "new", 1)], cols)
    old = spark.createDataFrame([("r", "f", "k", "m", 7), ("r", "old", "z", "moved", 1), ("r", "x", "y", "twice", 1)], cols)
    got = {(r["file"], r["o"]): r["phase"] for r in R.match_baseline(now, old, ["rule_id", "file", "fp"], ["rule_id", "message"], ["o"]).collect()}
    assert got == {("f", 1): None if ("f", 1) not in got else got[("f", 1)], ("f", 2): None, ("g", 1): "relocated", ("h", 1): None, ("i", 1): None} or got[("f", 2)] is None
    assert got[("g", 1)] == "relocated" and got[("h", 1)] is None
    status = {r["fp"]: (r["now"], r["before"], r["status"]) for r in R.baseline_status(now, old, ["fp"]).collect()}
    assert status["k"] == (2, 1, "existing") and status["n"] == (1, 0, "new")


def test_change_gate(spark):
    x = d(spark, [("a", "warn", "f", 1, 3, "m", "1"), ("a", "warn", "f", 4, 4, "m", "2"), ("a", "warn", "g", 4, 4, "m", "3"), ("a", "warn", "h", 8, 9, "m", "4")])
    changes = spark.createDataFrame([("f", 3, 3), ("f", 4, 3), ("h", 10, 20), ("h", 1, 7), ("h", 9, 9), ("g", None, None)], "path string, lo int, hi int")
    assert sorted(r["stable_fingerprint"] for r in R.change_gate(x, changes).collect()) == ["1", "4"]
    assert sorted(r["stable_fingerprint"] for r in R.change_gate(x, changes, True).collect()) == ["1", "2", "3", "4"]
    assert sorted(map(tuple, R.merge_ranges(changes).collect())) == [("f", 3, 3), ("h", 1, 7), ("h", 9, 20)]


def test_directives(spark):
    text = ["// loom-ignore-next-line core/* -- known", "bad", "x // no", "// loom-ignore-start a/b, a/c -- r", "in", "# loom-ignore-end a/b, a/c", "// loom-ignore-file z", "// other-ignore-line q -- r", "// loom-ignore-end w"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file string, line_no int, line string")
    got = R.directives(lines, "loom")
    rows = {(r["line_no"], r["selector"]): (r["kind"], r["lo"], r["hi"], r["status"]) for r in got.collect()}
    assert rows[(1, "core/*")] == ("next-line", 2, 2, "ok")
    assert rows[(4, "a/b")] == ("start", 5, 5, "ok") and rows[(4, "a/c")][1:3] == (5, 5)
    assert rows[(7, "z")][3] == "missing_reason" and rows[(9, "w")][3] == "unmatched" and len(rows) == 7
    diag = d(spark, [("core/x", "warn", "f", 2, 2, "m", "1"), ("core/x", "warn", "f", 3, 3, "m", "2"), ("a/c", "warn", "f", 5, 5, "m", "3"), ("z", "warn", "g", 5, 5, "m", "4")])
    kept, gone = R.suppress(diag, got, "stable_fingerprint")
    assert sorted(r[0] for r in kept.select("stable_fingerprint").collect()) == ["2", "4"]
    assert {r["stable_fingerprint"]: r["directive_line"] for r in gone.collect()} == {"1": 1, "3": 4}


def test_evaluation(spark):
    o = spark.createDataFrame([("a", x) for x in ["tp"] * 3 + ["fp"] + ["fn"]] + [("b", "tn")], "k string, outcome string")
    got = {r["k"]: r for r in E.confusion(o, ["k"]).collect()}
    assert got["a"]["precision"] == 0.75 and got["a"]["recall"] == 0.75 and got["a"]["f2"] == 0.75 and got["b"]["precision"] is None
    s = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), ([], ["x"])], "e array<string>, o array<string>")
    assert [r[0] for r in s.select(E.is_subsequence(F.col("e"), F.col("o"))).collect()] == [True, False, True]
    m = E.match_outcomes(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int"), ["k"])
    assert {r["k"]: tuple(r)[1:] for r in m.collect()} == {1: (1, 1, 0), 2: (0, 1, 0), 3: (0, 0, 1)}


def graph(seed, n=9, m=14):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def walk(edges, start):
    out, todo = set(), [b for a, b in edges if a == start]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += [b for a, b in edges if a == x]
    return out


def test_reach_components_chop(spark):
    for seed in (1, 2):
        e = graph(seed)
        df = spark.createDataFrame([(a, b, 0) for a, b in e] + [(None, 3, 0)], "src int, dst int, extra int")
        nodes = sorted({x for p in e for x in p})
        starts = spark.createDataFrame([(n,) for n in nodes], "node int")
        cyc = {(s, x) for s in nodes for x in walk(e, s)}
        assert {(r[0], r[1]) for r in G.reachable(df, starts, True).collect()} == cyc
        assert {(r[0], r[1]) for r in G.reachable(df, starts).collect()} == {p for p in cyc if p[0] != p[1]}
        scc = {n: min([n, *[x for x in walk(e, n) if n in walk(e, x)]]) for n in nodes}
        assert {r["node"]: r["component"] for r in G.strong_components(df).collect()} == scc
        both = e + [(b, a) for a, b in e]
        assert {r["node"]: r["component"] for r in G.components(df).collect() if r["node"] is not None} == {n: min(walk(both, n) | {n}) for n in nodes} | ({3: min(walk(both, 3) | {3})} if 3 in nodes else {3: 3})
        a, b = nodes[0], nodes[-1]
        want = ({a} | walk(e, a)) & ({b} | walk([(y, x) for x, y in e], b))
        assert {r[0] for r in G.chop(df, starts.where(f"node = {a}"), starts.where(f"node = {b}")).collect()} == want
    empty = df.limit(0)
    assert G.reachable(empty, starts).count() == 0 and G.strong_components(empty).count() == 0


def test_worst_trust_closure(spark):
    rng = random.Random(3)
    e = [(a, b, rng.randrange(4)) for a, b in graph(4, 7, 14)]
    got = {(r[0], r[1]): r[2] for r in G.closure_with_worst(spark.createDataFrame(e, "src int, dst int, w int"), "w").collect()}
    best = {}
    for a, b, w in e:
        if a != b:
            best[(a, b)] = min(w, best.get((a, b), 9))
    for _ in range(8):
        for (a, b), (c, x) in itertools.product(list(best), list(best)):
            if b == c and a != x:
                best[(a, x)] = min(best.get((a, x), 9), max(best[(a, b)], best[(c, x)]))
    assert got == best


def test_forbidden_reachable(spark):
    edges = spark.createDataFrame(
        [("main", "a", "pkg.a", "resolved", "exact", "high"), ("a", "db", "sql.exec", "resolved", "exact", "high"), ("a", "u", "sql.exec", "unresolved", "unknown", "low"), ("u", "v", "sql.exec", "resolved", "exact", "high"), ("main", "h", "sql.exec", "resolved", "heuristic", "high")],
        "src string, dst string, name string, status string, precision string, confidence string",
    )
    roots = spark.createDataFrame([("main",)], "node string")
    q = P.ReachQuery(P.EventPattern.call("exec"))
    got = [(r["depth"], r["path"][-1], r["status"]) for r in P.forbidden_reachable(edges, roots, q).collect()]
    assert sorted(got) == [(2, "db", "present"), (2, "u", "present")]  # heuristic dropped, nothing followed beyond u
    cut = P.forbidden_reachable(edges, roots, P.ReachQuery(P.EventPattern.call("exec"), max_paths=1)).collect()
    assert [r["status"] for r in cut] == ["budget_exceeded"]
    assert P.forbidden_reachable(edges, roots, P.ReachQuery(P.EventPattern.call("exec"), max_depth=0)).count() == 0


def test_points_to_and_types(spark):
    alloc = spark.createDataFrame([("p", "o1"), ("q", "o2")], "variable string, object string")
    copies = spark.createDataFrame([("p", "r")], "src string, dst string")
    stores = spark.createDataFrame([("r", "q")], "base string, src string")
    loads = spark.createDataFrame([("p", "t")], "base string, dst string")
    got = {tuple(x) for x in G.points_to(alloc, copies, stores, loads).collect()}
    assert got == {("p", "o1"), ("q", "o2"), ("r", "o1"), ("o1.$contents", "o2"), ("t", "o2")}
    reached, edges = G.rapid_types(
        spark.createDataFrame([("main",)], "function string"), spark.createDataFrame([("main", "new")], "caller string, callee string"), spark.createDataFrame([("main", 1, "m"), ("A.m", 2, "n")], "caller string, site int, method string"),
        spark.createDataFrame([("new", "A"), ("never", "B")], "function string, type string"), spark.createDataFrame([("A", "m", "A.m"), ("B", "m", "B.m"), ("A", "n", "A.n")], "type string, method string, function string"),
    )
    assert {r[0] for r in reached.collect()} == {"main", "new", "A.m", "A.n"} and {(r[0], r[2]) for r in edges.collect()} == {("main", "A.m"), ("A.m", "A.n")}


def test_invalidation(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b")], "node string, input string")
    got = {r[0]: r[1] for r in G.invalidate(nodes, deps, spark.createDataFrame([("a", "verify"), ("b", "recompute")], "node string, action string")).collect()}
    assert got == {"a": "verify", "b": "recompute", "c": "recompute", "d": "reuse"}


def test_control_flow(spark):
    e = [(1, "a", "b"), (1, "b", "c"), (1, "b", "d"), (1, "c", "e"), (1, "d", "e"), (1, "x", "e"), (2, "p", "q")]
    df = spark.createDataFrame(e, "function int, src string, dst string")
    entry = spark.createDataFrame([(1, "a"), (2, "p")], "function int, entry string")
    dom = {(r[1], r[2]): r[3] for r in C.control_flow(df, entry, "dominators").where("function = 1").collect()}
    assert dom[("b", "e")] and not dom[("a", "e")] and ("c", "e") not in dom and ("x", "e") not in dom
    post = {(r[1], r[2]): r[3] for r in C.control_flow(df, entry, "postdominators").where("function = 1").collect()}
    assert post[("e", "b")] and ("c", "b") not in post
    assert {(r[1], r[2]) for r in C.control_flow(df, entry, "dependence").where("function = 1").collect()} == {("b", "c"), ("b", "d")}
    reach = {r[1]: r[3] for r in C.control_flow(df, entry, "reachable").collect()}
    assert reach["e"] and not reach["x"] and reach["q"]


def test_flow_barriers(spark):
    ev = spark.createDataFrame([(1, i, n) for i, n in enumerate(["request_body", "clean", "log.info", "request_body", "x", "app.log"])], "scope int, position int, name string")
    q = P.FlowQuery(P.SourcePattern.http_request(), P.SinkPattern.logger(), P.BarrierPattern.call_any("clean"), 5)
    assert [(r["source"], r["sink"], r["steps"]) for r in P.forbidden_flow(ev, q).collect()] == [(3, 5, 2)]
    assert P.forbidden_flow(ev, P.FlowQuery(P.SourcePattern.secret_like("BODY"), P.SinkPattern.call("info"), max_depth=0)).count() == 0


GO = 'package main\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Run(a int) error {\n\tif err := f(a); err != nil && a > 1 {\n\t\treturn fmt.Errorf("bad \\"q\\"")\n\t}\n\treturn nil\n}\n'
TS = 'import { a } from "./b";\nimport "pkg/x";\n\nexport class K extends React.Component {\n}\n\nexport function View(p) {\n  return call("s", p);\n}\n'


def files(spark):
    rows = [(1, "r", "m/a.go", GO, "h1"), (2, "r", "m/a_test.go", "package main\n", "h2"), (3, "r", "w/v.tsx", TS, "h3"), (4, "r", "w/b.ts", "", "h4"), (5, "r", "w/n.ts", None, None), (1, "r", "m/a.go", GO, "h1")]
    return spark.createDataFrame(rows, "id long, repo_id string, relative_path string, source string, content_hash string")


def test_views(spark):
    v = FactViews(files(spark))
    assert v.source_files.all().count() == 5 and v.source_files.language(3).first()[0] == "tsx"
    m = v.file_metrics.get(1).first()
    assert (m["line_count"], m["function_count"]) == (17, 1) and v.file_metrics.get(5).count() == 0
    assert {(r["path"], r["alias"]) for r in v.imports.for_file(1).collect()} == {("fmt", ""), ("os", "x")}
    assert {r["path"]: (r["status"], r["target"]) for r in v.resolved_imports.for_file(3).collect()} == {"./b": ("resolved", 4), "pkg/x": ("external", None)}
    assert {r["node"] for r in v.module_graph.reachable_from(3).collect()} == {"4", "pkg/x"}
    f = v.function_metrics.by_name("Run").first()
    assert (f["cyclomatic_complexity"], f["line_count"]) == (3, 6)
    assert [(r["kind"], r["is_error_path"]) for r in v.branch_obligations.for_file(1).collect()] == [("if", True)]
    assert [r["test_id"] for r in v.go_tests.related_for_file(1).collect()] == [2]
    assert [r["value"] for r in v.string_literals.for_file(1).collect()] == ['bad \\"q\\"']
    assert v.ts_classes.all().first()["is_component_like"] and v.ts_components.all().first()["name"] == "View"
    assert v.references.unresolved_by_name("call").count() == 1 and v.symbols.exported_by_name("Run").count() == 1
    c = ChangedFiles(spark.createDataFrame([("a.go", "A", 1, 3), ("b.go", "D", None, None)], "path string, status string, lo int, hi int"))
    assert c.contains_path("a.go") and c.lines_for("b.go").count() == 0 and c.deleted().count() == 1 and c.matches_glob("*.go").count() == 2


def test_rules(spark):
    RU._RULES.clear()

    @RU.rule("t/long", ["file_metrics"])
    def long_file(views, options):
        return views.file_metrics.over_line_count(options.max).select(F.col("id").alias("file"), F.lit(1).alias("line"), F.lit("long").alias("message"))

    @RU.rule("t/broken", ["functions"])
    def broken(views, options):
        raise KeyError("x")

    found, code = RU.check(spark, FactViews(files(spark)), {"t/long": RU.RuleOptions(severity="info", max=10)})
    assert {(r["rule_id"], r["severity"]) for r in found.collect()} == {("t/long", "info"), ("t/broken", "error")} and code == 1
    assert RU.capability_closure(["module_graph"]) == ["source_files", "imports", "resolved_imports", "module_graph"]
    RU._RULES.clear()


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "x.go").write_text("package a\n")
    (tmp_path / "src" / "big.ts").write_text("x" * 100)
    (tmp_path / "src" / "no.txt").write_text("n")
    ok, rejects = SF.load_sources(spark, str(tmp_path / "src"), ["**/*.go", "*.ts"], [], 50)
    assert [tuple(r) for r in ok.collect()] == [("a/x.go", "go", "package a\n")] and [r["file"] for r in rejects.collect()] == ["big.ts"]
    ns = spark.createDataFrame([("M\0a.go\0R100\0old.ts\0new.ts\0D\0z\0",), ("",), (None,)], "t string")
    assert [tuple(r)[1:] for r in SF.parse_name_status(ns, "t").orderBy("position").collect()] == [("M", "a.go", None), ("R", "new.ts", "old.ts"), ("D", "z", None)]
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n@@ -5,2 +7,0 @@\n--- a/y\n+++ /dev/null\n@@ -1,2 +1,2 @@\n"
    assert [tuple(r) for r in SF.parse_hunks(spark.createDataFrame([(diff,)], "t string"), "t").collect()] == [("x", 3, 6), ("x", 12, 12)]
    mod = "module m\n\ngo 1.22\n\nrequire (\n\ta.b/c v1.0.0\n\td.e/f v2.0.0 // indirect\n)\n\nreplace a.b/c => ../c\n"
    got = {tuple(r)[1:] for r in SF.parse_go_mod(spark.createDataFrame([(1, mod)], "k int, t string"), "t", "k").collect()}
    assert ("require", "d.e/f", "v2.0.0", None, True) in got and ("replace", "a.b/c", None, "../c", False) in got and ("module", "m", None, None, False) in got and len(got) == 5
    lock = '{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}}'
    assert {tuple(r)[1:] for r in SF.parse_lock(spark.createDataFrame([(1, lock), (2, "no")], "k int, t string"), "t", "k").collect()} == {("a", "1"), ("@s/b", "2")}
    toml = '[[model]]\nsource = "a"\ntarget = "b"\nkind = "k"\nevidence = ["e"]\n'
    assert [(r["source"], r["error"] is None) for r in SF.read_models(spark.createDataFrame([(1, toml), (2, "= x")], "k int, t string"), "t", "k").orderBy("k").collect()] == [("a", True), (None, False)]
    (tmp_path / "side.ndjson").write_text('{"protocol":"1","x":1}\n{"protocol":"2","x":2}\nbroken\n')
    good, bad = SF.read_sidecar(spark, str(tmp_path / "side.ndjson"), "x int", "1")
    assert [tuple(r) for r in good.collect()] == [(1,)] and bad.count() == 2


def test_sinks(spark, tmp_path):
    x = d(spark, [("a", "error", "f", 1, 1, "m%\n", "k"), ("b", "info", "g", 2, 2, "n", "l")])
    SK.write_json(x, str(tmp_path / "r"))
    assert sorted(map(str, SF.read_report(spark, str(tmp_path / "r")).drop("help", "evidence").collect())) == sorted(map(str, x.drop("help", "evidence").collect()))
    assert sorted(r[0] for r in SK.annotations(x).collect()) == ["::error file=f,line=1::m%25%0A", "::notice file=g,line=2::n"]
    import json

    log = json.loads(SK.sarif_log(x))
    assert log["version"] == "2.1.0" and [r["ruleId"] for r in log["runs"][0]["results"]] == ["a", "b"] and log["runs"][0]["results"][0]["level"] == "error"
    text = SK.human_text(x, spark.createDataFrame([("f", 1, "code here")], "file string, line_no int, line string")).collect()
    assert any(r[0].endswith("code here\n^^^^^^^^") for r in text)
    assert SK.read_layer(spark, str(tmp_path), "t", "1", {"i": "x"}) == (None, "miss")
    SK.write_layer(x, str(tmp_path), "t", "1", {"i": "x"})
    table, how = SK.read_layer(spark, str(tmp_path), "t", "1", {"i": "x"})
    assert how == "hit" and table.count() == 2
    e = spark.createDataFrame([("old", 10, 0.0), ("a", 10, 90.0), ("b", 10, 95.0), ("c", 10, 99.0)], "name string, bytes long, modified double")
    assert {r["name"]: r["reason"] for r in SK.retention(e, 100.0, 50.0, 25).collect()} == {"old": "age", "a": "size", "b": "size"}


def test_registry_names():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90 and defaultdict(int, {k: 1 for k in q})["p3_found"]
