"""Scalar functions and predicates."""

import pytest
from pyspark.sql import functions as F

from loomfacts.functions import predicates as P
from loomfacts.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text,lines,full", [("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\n\n \t\nb", 4, 2), ("\n", 1, 0)])
def test_line_counts(spark, text, lines, full):
    assert one(spark, T.line_count(F.col("x")), x=text) == lines
    assert one(spark, T.non_empty_line_count(F.col("x")), x=text) == full


def test_fnv(spark):
    assert T.fnv64(["a"], 0xFF) != T.fnv64(["a"], 0xFE) and T.fnv64(["ab", "c"], 0xFF) != T.fnv64(["a", "bc"], 0xFF)
    rows = [("a", "b"), ("", None), ("ä€😀", "x" * 300)]
    d = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in d.select(T.fingerprint(F.col("a"), F.col("b"))).collect()] == [T.fnv64(list(r), 0xFF) for r in rows]
    assert [r[0] for r in d.select(T.stable_key(F.col("a"), F.col("b"))).collect()] == [T.fnv64(list(r), 0xFE) for r in rows]
    assert T.fnv64([], 0xFF) == "cbf29ce484222325"


def test_strings(spark):
    assert one(spark, T.ascii_lower(F.col("x")), x="ÄBC") == "Äbc"
    assert one(spark, T.collapse_spaces(F.col("x")), x="  a \t\n b ") == "a b"
    assert one(spark, T.unquote(F.col("x")), x='"a\\"b"') == 'a"b'
    assert one(spark, T.unquote(F.col("x")), x="`a\\b`") == "a\\b"
    assert one(spark, T.import_package_name(F.col("x")), x="@a/b/c") == "@a/b"
    assert one(spark, T.import_package_name(F.col("x")), x="lodash/fp") == "lodash"
    assert one(spark, T.capture_between(F.col("x"), "pkg/", "/api"), x="pkg/core/api/x.go") == "core"
    assert one(spark, T.capture_between(F.col("x"), "pkg/", "/api"), x="pkg/a/b/api") is None
    assert one(spark, T.escape_annotation(F.col("x")), x="a%\r\n") == "a%25%0D%0A"
    assert one(spark, T.byte_offset(F.col("x"), F.col("c")), x="aäb", c=3) == 3
    assert one(spark, T.split_top_level(F.col("x")), x='a, f(b, c), "x,y", {d, e}') == ["a", "f(b, c)", '"x,y"', "{d, e}"]
    assert one(spark, T.words(F.col("x")), x="b a_1 b") == ["a_1", "b"]
    assert one(spark, T.contains_any_folded(F.col("x"), []), x="a") is False


@pytest.mark.parametrize(
    "pattern,path,want",
    [("*.go", "a.go", True), ("*.go", "x/a.go", False), ("**/*.go", "a.go", True), ("**/*.go", "x/y/a.go", True), ("src/**", "src/a/b", True), ("{a,b}/*.t?", "b/x.ts", True), ("[ab]*.go", "c.go", False), ("[!ab].go", "c.go", True), ("./x.go", "x.go", True), ("[broken*", "x/[broken/y", True)],
)
def test_globs(spark, pattern, path, want):
    assert one(spark, P.matches_glob(F.col("x"), pattern), x=path) is want


def test_predicates(spark):
    for selector, rule, want in (("*", "a/b", True), ("a/*", "a/b", True), ("a/*", "ab/c", False), ("a/b", "a/b", True), ("a/b", "a/c", False)):
        assert one(spark, P.selects(F.col("s"), F.col("r")), s=selector, r=rule) is want
    assert one(spark, P.names_call(F.col("x"), "info"), x="logger.info") is True
    assert one(spark, P.is_logger(F.col("x")), x="App.Error") is True
    assert one(spark, P.passes_floor(F.col("s"), F.col("p"), "exact"), s="unknown", p="heuristic") is True
    assert one(spark, P.passes_floor(F.col("s"), F.col("p"), "syntax"), s="resolved", p="heuristic") is False
    assert one(spark, P.in_scope(F.col("x"), [], ["**/*_test.go"], ["a.go"]), x="a.go") is False
    assert one(spark, P.in_scope(F.col("x"), [], ["**/*_test.go"]), x="a.go") is True
    assert one(spark, P.weakest(F.array(F.lit("exact"), F.col("x")), P.PRECISION_RANK), x="heuristic") == 1
    assert one(spark, P.names_preferred(F.array(), F.array(F.col("x")), ["f"]), x="f") is True
    assert one(spark, P.names_preferred(F.array(F.lit("g")), F.array(F.col("x")), ["f"]), x="f") is False
