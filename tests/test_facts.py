"""Facts from tokens against lists written by hand, and the relations on them."""

import pytest

from loomfacts.operators import dataflow as D
from loomfacts.operators import extract as X
from loomfacts.operators.facts import Facts, matching_spans
from loomfacts.operators.syntax import MODULE, file_facts

GO = '''package svc

import (
	"fmt"
	x "net/http"
)

type Box[T any] struct {
	A, B int
	x.Client
}

type (
	A struct{ n int }
	B = A
	C interface { Do(a int) error; Other() }
)

type M map[string]struct{}

func Map[T any](xs []T, f func(T) T) (out []T, err error) {
	for i, v := range xs {
		if err != nil || i > 3 {
			return nil, err
		} else if v == nil {
			continue
		}
		out = append(out, f(v))
	}
	switch len(out) {
	case 1:
		fmt.Println("a", 'c')
	default:
		panic(`raw`)
	}
	return
}

func (b *Box[T]) Get(k string) int { return b.A }

func TestGet(t *testing.T) {
	t.Run("x", func(t *testing.T) { if 1 != 2 { t.Errorf("bad %d", 3) } })
}
'''
TS = '''import React, { useState as u } from "react";
import {
  a,
  b
} from '../../lib/y';
export { q } from './q';
const fs = require("fs"), k = 'it\\'s';
export class View<T> extends React.Component<T> {
  private n = 1;
  constructor(private a: string) { super(a); }
  async load(id: string): Promise<void> { const r = await fetch(`/api/${id}`); this.n = r; if (a ? b : c) { throw new Error("x"); } }
}
export default function main<T>({ a, b }: P, c = 1): { x: number } { const o = new Map(); o.v = c; const w = o.v; return w; }
const helper = async (x: number): Promise<number> => { try { return main(x); } catch (e) { log(e); } };
const one = y => y + 1;
function inner() { function deep() { while (1) { break; } } deep(); }
const re = /["'{(]/.test(k) ? 1 : 2;
export { helper, inner as renamed };
'''


def of(source, lang, kind):
    return [r for r in file_facts(source, lang) if r[0] == kind]


def test_go_declarations():
    assert [(r[3], r[4], r[5]) for r in of(GO, "go", "type")] == [("Box", "struct", "generic"), ("A", "struct", ""), ("B", "alias", ""), ("C", "interface", ""), ("M", "named", "")]
    assert [r[6] for r in of(GO, "go", "type")][:4] == [["A", "Client"], ["n"], [], ["Do", "Other"]]
    assert [(r[3], r[4], r[5], r[6], r[7]) for r in of(GO, "go", "function")] == [("Map", "function", "", ["xs", "f"], 7), ("Get", "method", "Box", ["k"], 1), ("TestGet", "function", "", ["t"], 2), (MODULE, "module", "", [], 1)]
    assert [(r[3], r[4]) for r in of(GO, "go", "import")] == [("fmt", ""), ("net/http", "x")]
    assert [r[3] for r in of(GO, "go", "package")] == ["svc"]
    assert [(r[3], r[4]) for r in of(GO, "go", "literal")] == [("a", '"'), ("c", "'"), ("raw", "`"), ("x", '"'), ("bad %d", '"')]
    assert [(r[3], r[4], r[5], r[6][:2], r[7]) for r in of(GO, "go", "test")] == [("TestGet", "1", "1", ["Errorf", "Run"], 0)]
    assert [(r[3], r[5], r[8]) for r in of(GO, "go", "branch")] == [("for", "body", False), ("for", "exit", False), ("if", "then", True), ("if", "else", False), ("if", "then", False), ("if", "else", False), ("switch", "1", False), ("switch", "default", False)]
    assert [r[3] for r in of(GO, "go", "call")] == ["append", "f", "len", "fmt.Println", "panic", "t.Run", "t.Errorf"]


def test_script_declarations():
    assert [(r[3], r[5]) for r in of(TS, "typescript", "import")] == [("react", "static"), ("../../lib/y", "static"), ("./q", "export"), ("fs", "require")]
    assert of(TS, "typescript", "import")[1][6] == ["a", "b"]
    assert [(r[3], r[4], r[6], r[8]) for r in of(TS, "typescript", "class")] == [("View", "React.Component", ["constructor", "load"], True)]
    got = [(r[3], r[4], r[5], r[6], r[8]) for r in of(TS, "typescript", "function")]
    assert got == [("constructor", "method", "View", ["a"], True), ("load", "method", "View", ["id"], True), ("main", "function", "", ["a", "b", "c"], True), ("helper", "arrow", "", ["x"], True), ("one", "arrow", "", ["y"], False), ("inner", "function", "", [], True), ("deep", "function", "", [], False), (MODULE, "module", "", [], False)]
    assert [r[3] for r in of(TS, "typescript", "export")] == ["helper", "inner"]
    assert [r[3] for r in of(TS, "typescript", "literal")] == ["it\\'s", "/api/${id}", "x"]
    assert [(r[3], r[4]) for r in of(TS, "typescript", "alloc")] == [("o", "Map")]
    assert [(r[3], r[4], r[6]) for r in of(TS, "typescript", "store")] == [("this", "n", ["r"]), ("o", "v", ["c"])]
    assert [(r[3], r[4], r[5]) for r in of(TS, "typescript", "load")] == [("w", "o", "v")]


def test_blocks_of_a_loop_with_early_return():
    src = "package a\nfunc F(x int) int {\n\tfor x > 0 {\n\t\tif x == 3 { return 1 }\n\t\tx--\n\t}\n\treturn 0\n}\n"
    assert {(r[3], r[4], r[5]) for r in of(src, "go", "edge")} == {("0", "2", "next"), ("2", "3", "body"), ("2", "4", "exit"), ("3", "5", "then"), ("5", "1", "return"), ("3", "6", "else"), ("6", "2", "back"), ("4", "1", "return")}


@pytest.mark.parametrize("source", ["", "package", "func (", "func f(", "class {", "import", "export {", "const x =", "if (", "switch x {", "`", "/*", "type (", "a ? b : c ? d", "}" * 50, "(" * 50, "if (a) " * 3000 + ";", "{" * 3000])
def test_broken_texts_do_not_crash(source):
    for lang in ("go", "typescript", "jsx"):
        assert [r[3] for r in file_facts(source, lang) if r[0] == "function"][-1] == MODULE


def files(spark, texts, repo="r"):
    rows = [(i, repo, p, "", s, "h") for i, (p, s) in enumerate(texts)] + [(99, repo, "z.go", "", None, None), (98, repo, "z.md", "", "x", "h")]
    return spark.createDataFrame(rows + rows[:1], "id long, repo_id string, relative_path string, language string, source string, content_hash string")


def test_relations(spark):
    texts = [
        ("src/a/x.ts", 'import { load } from "../../lib/y";\nexport function run(p, q) { const v = load(p); const w = twice(q); return w; }\nfunction twice(n) { return n; }\nfunction each(f, v) { return f(v); }\nfunction go(v) { return each(twice, v); }\napp.get("/u/:id", run);\n'),
        ("lib/y/index.ts", "export function load(id) { const o = new Box(); o.v = id; const r = o.v; return r; }\nclass Box { get(k) { return k; } }\nexport function top() { const b = new Box(); return b.get(1); }\n"),
        ("m.go", "package m\n\nfunc main() { http.HandleFunc(\"/x\", serve) }\n\nfunc serve() {}\n\nfunc TestA(t *testing.T) {}\n"),
    ]
    f = Facts(files(spark, texts))
    names = {r["key"]: r["name"] for r in f.functions.collect()}
    edges = {(names[r["caller"]], names[r["callee"]], r["tier"]) for r in f.call_edges().collect()}
    assert edges == {("run", "load", "import"), ("run", "twice", "lexical"), ("go", "each", "lexical"), ("each", "twice", "summary"), (MODULE, "run", "framework"), ("top", "get", "solver"), ("main", "serve", "framework")}
    assert {(r["kind"], r["method"], r["path"], r["handler"]) for r in f.entrypoints.collect()} == {("http_route", "GET", "/u/:id", "run"), ("http_route", None, "/x", "serve"), ("test", None, None, "TestA")}
    named = lambda x: names[x.split("#")[0]] + "#" + x.split("#")[1]
    flow = {(named(r["src"]), named(r["dst"]), r["kind"]) for r in f.flow_edges().collect()}
    assert {("run#p", "load#id", "call"), ("run#q", "twice#n", "call"), ("twice#<return>", "run#w", "return"), ("twice#n", "twice#<return>", "result"), ("load#id", "load#o.v", "store"), ("load#o.v", "load#r", "load"), ("run#w", "run#<return>", "result")} <= flow
    assert {(names[r["function"]], r["parameter"]) for r in f.taint_in_taint_out.collect()} >= {("twice", "n"), ("load", "id")}
    points = {(named(r["variable"]), r["object"].split("#")[1]) for r in f.points_to.where("not variable like '%$contents'").collect()}
    assert ("load#o", "Box@1") in points
    node = lambda name, v: spark.createDataFrame([(next(k for k, n in names.items() if n == name) + "#" + v,)], "node string")
    e = f.flow_edges()
    found = D.taint_paths(e, node("run", "q"), node("run", "<return>")).collect()
    assert [[named(x) for x in r["path"]] for r in found] == [["run#q", "twice#n", "twice#<return>", "run#w", "run#<return>"]]
    assert {r["effect"] for r in f.effects.collect()} >= {"writes_memory", "allocates", "calls_unknown"}
    assert {(r["kind"], r["n"]) for r in f.membership.groupBy("kind").agg(X.F.count(X.F.lit(1)).alias("n")).collect()} >= {("method_of", 1)}
    spans = f.functions.select("id", "line", "end_line", "name", "key")
    assert matching_spans(spans, spans).count() == spans.count()
    one = f.extension_edges(spark.createDataFrame([("main", "top"), ("main", "nowhere")], "source string, target string"))
    assert [(names[r["caller"]], names[r["callee"]], r["tier"]) for r in one.collect()] == [("main", "top", "extension")]
    empty = Facts(files(spark, []).limit(0))
    assert empty.functions.count() == 0 and empty.entrypoints.count() == 0


CASES = [
    ("src/a/b/x.ts", "../../lib/y", "resolved", "src/lib/y.ts"), ("src/a/b/x.ts", "./d", "resolved", "src/a/b/d/index.ts"), ("src/a/b/x.ts", "./e.js", "resolved", "src/a/b/e.tsx"), ("src/a/b/x.ts", "../../../root", "resolved", "root.mjs"),
    ("src/a/b/x.ts", "../../../../out", "unresolved", None), ("src/a/b/x.ts", ".././b/./d/index", "resolved", "src/a/b/d/index.ts"), ("src/a/b/x.ts", "./f.js", "resolved", "src/a/b/f.js"), ("src/a/b/x.ts", "react", "external", None),
    ("src/a/b/x.ts", "@app/lib/y", "setup_missing", None), ("src/a/b/x.ts", "..", "resolved", "src/a/index.js"), ("src/a/b/x.ts", "./none", "unresolved", None),
]


def test_script_resolution(spark):
    paths = ["src/lib/y.ts", "src/a/b/d/index.ts", "src/a/b/e.tsx", "root.mjs", "src/a/b/f.js", "src/a/b/f.ts", "src/a/index.js"]
    texts = [("src/a/b/x.ts", "".join(f'import q{i} from "{c[1]}";\n' for i, c in enumerate(CASES)))] + [(p, "x") for p in paths]
    d = files(spark, texts)
    ids = {i: p for i, (p, _) in enumerate(texts)}
    got = {r["line_no"]: (r["status"], ids.get(r["target"])) for r in X.resolved_imports(d).where("id = 0").collect()}
    assert got == {i + 1: (c[2], c[3]) for i, c in enumerate(CASES)}
    aliased = X.resolved_imports(d, {"@app/": "src/"}).where("path = '@app/lib/y'").first()
    assert (aliased["status"], ids[aliased["target"]]) == ("resolved", "src/lib/y.ts")
