"""Grammars, lexers and the parse check."""

import pytest
from pyspark.sql import functions as F

from loomfacts.llm import lexers as L
from loomfacts.llm.parse_check import check, failing_files, failure_rates, parse_files
from loomfacts.llm.peg import compile_grammar

VALID = {
    "go": [
        "package a\n", "\ufeff// c\npackage a; import \"x\"\nvar _ = 1\n", "package a\r\n\r\nfunc f() {\r\n\tx := []int{1,2,}\r\n\tfor i := range x { _ = i }\r\n}\r\n",
        "package a\nfunc f[T any, U ~int | string](a T, b ...U) (x, y int) {\n\tif v, ok := m[k]; ok && v == (T{1}) {\n\t} else if !ok {\n\t\treturn\n\t}\n\tswitch x := y.(type) {\n\tcase nil, []int, *T, func(int) bool:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-c:\n\t}\nL:\n\tfor ; ; {\n\t\tbreak L\n\t}\n\tgo func() {}()\n\tdefer f()\n\treturn 1, 2\n}\n",
        "package a\ntype (\n\tA = B\n\tI interface { M(int) error; ~int | ~string; io.Reader }\n\tS struct { *E; a, b int `j:\"x\"`; pkg.T }\n\tG[K comparable, V any] map[K][]V\n)\nconst (\n\tX = iota\n\tY\n)\nvar z = map[string][]T{\"a\": {{1, 2}, {x: 3}}}\nvar r = '\\''\nvar s = `raw\n}`\nvar p = pt.New[int](a[1:2:3], <-c, &T{}, *x)\n",
        "package a\nfunc f() {\n\tx := y /* c\n */\n\tz := 1\n\tfor _, x := range []int{1} {\n\t}\n\tfor x < 3 {\n\t}\n\tif (T{} == x) {\n\t}\n}",
    ],
    "javascript": [
        "", "\n", "#!/usr/bin/env node\nlet a = 1\nlet b = 2", "import a, {b as c, default as d} from 'x'; export * from \"y\"\nexport default class {}\n", "with (a) b\nvar let_ = 010; label: for (;;) { continue label }",
        "a\n++b\nc = d\n/e/g.test(f)\nif (x) /re[/]x/.exec(y)\nx = y / z / w", "const f = async ({a, b: [c = 1, ...d]}, ...r) => ({...a, [b]: 1, get x() { return 1 }, async *g() {}, 'q': 2, n})\n",
        "class A extends B { static #p = 1; static { this.x = 1 } get = 1\n set\n 'k'() {} async m() { for await (const x of y) {} super.m?.(#p in this) } }", "x = `a${b`${c}`}d` + `}`; y = a ? (b, c) : d => e; z = a?.b?.[c]?.(d) ?? (e || f); new.target; import.meta; import('x')",
        "do x++; while (x < 5) y\nswitch (a) { case 1: case 2: b; break; default: }\ntry {} catch {} finally {}\nvar {a = 1, ...b} = c, [d,, e] = f\nasync function* g() { yield* h; await i }\nx = function () {}\nx ||= 1; x **= 2; x >>>= 3; x = a >>> b >= c > d",
        "return_ = 1; a = b ? c : d ? e : f; let of = 1; for (const of of of) {}\nfor (var i = 0, n = 3; i < n; i++) {}\nfor (x in y) {}\n;(function () {})()",
    ],
    "typescript": [
        "const a: number = <any>b as string satisfies C; let x!: Map<string, Array<Set<number>>> = y!\n", "type A<T extends K = {}> = T extends (infer U)[] ? U : { readonly [P in keyof T]?: T[P] } & { a: 1; b?(): void } | `x${string}` | [a: number, ...b: string[]]\n",
        "interface I<T> extends J, K<T> { (x: number): string; new (y): I; readonly [k: string]: any; m?<U>(this: Window, a?: U): asserts a is U }\n", "abstract class C<T> extends D<T> implements E, F { private readonly x?: number = 1; constructor(public a: string, protected b = 2) { super() } abstract m(): void; static async f<T>(x: T): Promise<T> { return x } declare y: 1; [k: string]: any }\n",
        "enum E { A, B = 1 << 2, 'c' = 3 }\ndeclare module 'x' { export function f(a: number): void; export = g }\nnamespace N.M { export const x = 1 }\nimport type { T } from './t'; import fs = require('fs'); export type { T }; export import q = N.M\n",
        "function f(a: string): string\nfunction f(a: any): any { return f<number>(a) < b > (c) }\nconst g = <T,>(x: T): x is T => !!x; const h = async <T>(x: T) => x; @dec() class X { @a b = 1 }\nlet u: unique symbol, v: typeof import('x').y<string>, w: new () => void, z: (a: number) => b is string\n",
    ],
    "tsx": ["const a = <T,>(x: T) => <div className=\"a\" {...p} on={() => <b/>}>t {x as any} {/* c */}<A.B<string> x='1'/></div>\nconst f = <></>\nlet x: Array<Array<number>> = y\n"],
    "jsx": ["export default () => (<ul>{a.map((i) => (<li key={i.id}>it's {i} &amp; b</li>))}</ul>)\nconst c = a < b && c > d\n"],
}
INVALID = {
    "go": [("", "truncated"), ("package a\nfunc f() {\n", None), ("package a\nfunc f() {\n\tx := \"abc\n}\n", None), ("package a\n<<<<<<< HEAD\nvar a = 1\n=======\n>>>>>>> x\n", "conflict_marker"), ("const a = require(\"b\");\n", None), ("package a\nvar c = 'ab'\n", None), ("package a\nvar x = a /* open\n", None), ("package a\nfunc f() { if x == T{1} { } }\n", None)],
    "javascript": [("const a: number = 1", "wrong_language"), ("function f() {", "truncated"), ("a = {", "truncated"), ("x = `a${", None), ("let a = 3px", None), ("}", None), ("const x = <div/>;", None), ("/* open", "truncated"), ("{\"a\": 1, \"b\": 2}", None), ("def f(x):\n  return x\n", None), ("[truncated 12 lines]\n", "cut_notice"), ("a b", None), ("foo(a,,b)", None), ("if (a) { b } }", None)],
    "typescript": [("const a = <div>x</div>;\n", None), ("enum { A }", None), ("interface X { a: }", None)],
    "tsx": [("const a = <Foo>raw;\nfunction f() { return 1 }\n", None), ("const a = <a></b>", None), ("x = <div>{a</div>", None)],
    "jsx": [("return <div className=", None), ("const a = <p>1 > 2</p>", None)],
}


@pytest.mark.parametrize("language,source", [(k, s) for k, v in VALID.items() for s in v])
def test_valid(language, source):
    assert check(source, language) is None and check(source, language, explain=False) is None


@pytest.mark.parametrize("language,source,cause", [(k, *x) for k, v in INVALID.items() for x in v])
def test_invalid(language, source, cause):
    f = check(source, language)
    assert f is not None and check(source, language, explain=False) is not None and 0 <= f.at <= len(source)
    assert cause is None or f.cause == cause


def test_furthest_failure():
    assert check("package a\nfunc f() {\n\tx := 1 +\n}\n", "go").at == len("package a\nfunc f() {\n\tx := 1 +\n")
    assert check("let a = 1;\nlet b = = 2;", "javascript").at == 19


@pytest.mark.parametrize("language,source", [(k, s) for k, v in VALID.items() for s in v] + [(k, x[0]) for k, v in INVALID.items() for x in v])
def test_lines_read_like_texts(language, source):
    """Tokens put together from lines are those of the whole text, up to names that were made equal."""
    jsx = language in ("tsx", "jsx")
    try:
        want = L.lex_go(source) if language == "go" else L.lex_js(source, jsx)
    except L.LexError:
        return
    quick = [L.fast_go(source)] if language == "go" else [L.fast_js(source, jsx), L.lex_js(source, jsx, fast=True)]
    for q in quick:
        if q is not None:
            assert q[0] == want[0] and q[-1] == want[-1] and (language == "go" or q[2] - {0} == want[2] - {0})


def test_deep_and_long():
    assert check("x = " + "(" * 3000 + "1" + ")" * 3000, "javascript") is None
    assert check("x = [" + "1," * 100_000 + "]", "javascript") is None


def test_peg_operators():
    parse = compile_grammar("s <- 'a'* &'b' ('b' / 'c')+ !'c' 'd'? \"x\" EOF", "s", {}, {}, True)

    def run(kinds):
        return parse([*["ID" if k == "x" else k for k in kinds], "EOF", "EOF"], [*kinds, "", ""], set(), {})[0]

    assert run(["a", "a", "b", "c", "d", "x"]) == 7 and run(["b", "x"]) == 3 and run(["a", "c", "x"]) == -1 and run(["b", "d"]) == -1


def rows(spark):
    data = [(1, "r", "a.go", "go", "package a\n", 0), (2, "r", "b.go", None, "oops", 0), (3, "q", "c.py", "unknown", "oops", 0), (4, "q", "d.mjs", None, "export {", 0), (5, "q", "e.ts", "typescript", None, 0), (6, "q", "f.tsx", "TSX", "", 0), (2, "r", "b.go", None, "oops", 0), (7, None, None, None, "x", 0)]
    return spark.createDataFrame(data, "id long, repo_id string, relative_path string, language string, source string, ok int")


def test_operator(spark):
    df = rows(spark)
    assert sorted(r[0] for r in failing_files(df).select("id").collect()) == [2, 4]
    assert {(r["repo_id"], r["language"]): (r["files"], r["failed"], r["failure_rate"]) for r in failure_rates(df).collect()} == {("r", "go"): (2, 1, 0.5), ("q", "javascript"): (1, 1, 1.0), ("q", "tsx"): (1, 0, 0.0)}
    assert parse_files(df).where(F.col("id") == 4).first()["fail_line"] == 1
    assert parse_files(df.limit(0)).count() == 0
