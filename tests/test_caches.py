"""Layers, demand, baselines, rule fixtures, and views that came later."""

import pytest
from pyspark.sql import functions as F

from loomfacts.rules import rule, run_rule_fixtures
from loomfacts.sources import sinks as S
from loomfacts.views import ChangedFileRef, ChangedFiles, Violations


def test_layers_are_listed_and_deleted(spark, tmp_path):
    df = spark.range(3)
    root = str(tmp_path / "cache")
    keys = [S.write_layer(df, root, "facts", v, {"a": "1"}) for v in ("1", "2")]
    entries = S.layer_entries(spark, root)
    assert {(r["name"], r["key"], r["complete"]) for r in entries.collect()} == {("facts", k, True) for k in keys}
    stats = S.layer_statistics(entries).first()
    assert (stats["layers"], stats["incomplete"]) == (2, 0) and stats["bytes"] > 0
    assert S.delete_layers(spark, root, "facts", [keys[0]]) == 1
    assert S.read_layer(spark, root, "facts", "1", {"a": "1"})[1] == "miss"
    assert S.read_layer(spark, root, "facts", "2", {"a": "1"})[1] == "hit"


def test_demand_tracks_reads(spark):
    d, runs = S.Demand(most_depth=3), []
    d.define("a", lambda x: runs.append("a") or spark.range(2))
    d.define("b", lambda x: x.read("a").union(x.read("a")))
    assert d.read("b").count() == 4 and d.read("b").count() == 4 and runs == ["a"]
    assert {tuple(r) for r in d.reads(spark).collect()} == {("b", "a")}
    assert d.drop("a") == ["a", "b"]
    d.define("loop", lambda x: x.read("loop"))
    with pytest.raises(RecursionError):
        d.read("loop")


def test_baseline_keeps_the_ignore_section(spark, tmp_path):
    d = spark.createDataFrame([("r", "f", "m"), ("r", "f", "m"), ("q", None, "n")], "rule_id string, file string, message string")
    at = str(tmp_path / "base")
    S.write_baseline(d, at, ["rule_id", "file"], d.select("rule_id", "file").limit(1))
    S.write_baseline(d.where("rule_id = 'r'"), at, ["rule_id", "file"])
    active, ignored = S.read_baseline(spark, at)
    assert [(r["rule_id"], r["rows"]) for r in active.collect()] == [("r", 2)] and ignored.count() == 1


def test_retention_without_one_task(spark):
    rows = [("a", 10, 1.0), ("b", 20, 50.0), ("c", 30, 60.0), ("d", 40, 70.0)]
    got = S.retention(spark.createDataFrame(rows, "name string, bytes long, modified double"), 100.0, 90.0, 60)
    assert {(r["name"], r["reason"]) for r in got.collect()} == {("a", "age"), ("b", "size"), ("c", "size")}


def test_rule_fixtures(spark):
    rule("test/todo", ["source_files"])(lambda v, o: v.source_files.all().select(F.col("relative_path").alias("file"), F.lit(1).alias("line"), F.lit("a file").alias("message")))
    cases = [
        {"name": "ok", "rule": "test/todo", "files": {"a.go": "package a\n"}, "expect": [{"file": "a.go", "line": 1, "message_contains": "file"}]},
        {"name": "twice", "rule": "test/todo", "files": {"a.go": ""}, "expect": [{"file": "a.go", "line": 1}, {"file": "a.go", "line": 1}]},
        {"name": "none", "rule": "test/todo", "files": {"a.go": ""}},
    ]
    assert [r["status"] for r in run_rule_fixtures(spark, cases).collect()] == ["pass", "missing", "unexpected"]


def test_later_views(spark):
    v = Violations(spark.createDataFrame([("s", 5, "violated", "exact"), ("t", 6, "unknown", "syntax")], "scope string, position long, status string, precision string"))
    assert v.status("violated").count() == 1 and v.precision().count() == 2
    assert {(r["file"], r["line"]) for r in v.diagnostic("r", "m").collect()} == {("s", 5), ("t", 6)}
    c = ChangedFiles(spark.createDataFrame([("a/b.go", "M", 3, 4), ("a/b.go", "M", 1, 2), ("c.go", "D", None, None)], "path string, status string, lo int, hi int"))
    ref = c.ref("a/b.go")
    assert ref.lines == ((1, 2), (3, 4)) and ref.is_modified and ref.matches_glob("a/*.go") and c.ref("none") is None
    assert ChangedFileRef("x", "R100").is_renamed and not ref.is_deleted and c.ref("c.go").is_deleted and not ref.is_added
