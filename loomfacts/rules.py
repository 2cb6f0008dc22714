"""Rules: functions from fact views to diagnostics, their options, the capabilities they need, and running them all."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.report import dedupe, exit_status, filter_report
from .views import FactViews

#: The facts each capability is derived from. Fixed values.
DERIVED_FROM: dict[str, tuple[str, ...]] = {
    "source_files": (), "file_metrics": ("source_files",), "packages": ("source_files",), "imports": ("source_files",), "functions": ("source_files",), "function_metrics": ("functions",), "complexity_metrics": ("functions",),
    "string_literals": ("source_files",), "jsx_attributes": ("source_files",), "branch_obligations": ("functions",), "go_types": ("source_files",), "ts_classes": ("source_files",), "ts_components": ("functions",), "tests": ("source_files",),
    "resolved_imports": ("imports", "source_files"), "module_graph": ("resolved_imports",), "symbols": ("functions", "module_graph"), "references": ("symbols",), "calls": ("references", "symbols"), "events": ("calls",),
    "control_flow": ("functions",), "dataflow": ("calls", "control_flow"), "coverage": ("branch_obligations",), "changed_files": (),
}


@dataclass(frozen=True)
class RuleOptions:
    severity: str = "warn"
    files: tuple[str, ...] = ()
    allow_files: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    max: int | None = None
    deny: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    needs: tuple[str, ...]
    run: Callable[[FactViews, RuleOptions], DataFrame]


_RULES: dict[str, Rule] = {}


def rule(rule_id: str, needs: Iterable[str]) -> Callable:
    """Registers a function (views, options) -> findings with columns file, line and message."""
    wanted = tuple(needs)
    unknown = [n for n in wanted if n not in DERIVED_FROM]
    if unknown:
        raise ValueError(f"unknown capabilities: {unknown}")

    def wrap(f: Callable) -> Callable:
        if len(inspect.signature(f).parameters) != 2:
            raise TypeError("a rule takes views and options")
        _RULES[rule_id] = Rule(rule_id, wanted, f)
        return f

    return wrap


def registered() -> dict[str, Rule]:
    return dict(_RULES)


def capability_closure(needs: Iterable[str]) -> list[str]:
    """The capabilities and all they are derived from, each after its inputs."""
    out: list[str] = []

    def visit(c: str) -> None:
        if c in out:
            return
        for d in DERIVED_FROM[c]:
            visit(d)
        out.append(c)

    for n in needs:
        visit(n)
    return out


def run_rules(spark: SparkSession, views: FactViews, options: dict[str, RuleOptions] | None = None, only: str = "*") -> DataFrame:
    """Diagnostics of all rules as one plan: the union of their plans, duplicates dropped.

    A rule that cannot be planned does not stop the others: it gives one diagnostic of its own.
    """
    empty = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
    parts = []
    for r in _RULES.values():
        o = (options or {}).get(r.rule_id, RuleOptions())
        try:
            found = r.run(views, o).select(F.col("file").cast("string").alias("file"), F.col("line").cast("int").alias("line"), F.col("message").cast("string").alias("message")).withColumn("severity", F.lit(o.severity))
        except Exception as e:  # noqa: BLE001 - contained: reported as a diagnostic of the rule
            found = spark.createDataFrame([(None, 1, f"rule failed: {type(e).__name__}", "error")], "file string, line int, message string, severity string")
        parts.append(found.withColumn("rule_id", F.lit(r.rule_id)))
    if not parts:
        raise ValueError("no rules are registered")
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    place = F.struct(F.col("line").alias("start_line"), F.lit(1).alias("start_col"), F.col("line").alias("end_line"), F.lit(1).alias("end_col")).cast(empty)
    d = d.withColumn("text_range", place).withColumn("evidence", F.array().cast("array<struct<label:string,value:string>>")).withColumn("stable_fingerprint", F.md5(F.concat_ws("\x1f", "rule_id", F.coalesce("file", F.lit("")), "message", F.col("line").cast("string"))))
    return filter_report(dedupe(d.drop("line")), only)


def check(spark: SparkSession, views: FactViews, options: dict[str, RuleOptions] | None = None, only: str = "*", most_shown: int | None = None) -> tuple[DataFrame, int]:
    """Diagnostics (at most ``most_shown`` of them) and the exit code, which is found before any are cut off."""
    d = run_rules(spark, views, options, only)
    code = exit_status(d).first()["exit_code"]
    return (d if most_shown is None else d.orderBy("file", "text_range", "rule_id").limit(most_shown)), code


def run_rule_fixtures(spark: SparkSession, fixtures: Iterable[dict], options: dict[str, RuleOptions] | None = None) -> DataFrame:
    """Runs rules on fixtures: fixture, rule_id, expected, found, status (pass, missing, unexpected).

    A fixture has a name, a rule, files (path to source) and expect, the diagnostics as dicts of file, line and, where
    it is given, a part of the message (message_contains). A diagnostic that is expected twice has to be found twice.
    """
    rows = []
    for n, x in enumerate(fixtures):
        files = spark.createDataFrame([(i, f"fixture{n}", p, "", s, "") for i, (p, s) in enumerate(sorted(x["files"].items()))], "id long, repo_id string, relative_path string, language string, source string, content_hash string")
        rule_of = _RULES[x["rule"]]
        o = (options or {}).get(x["rule"], RuleOptions())
        found = [(r["file"], r["line"], r["message"]) for r in rule_of.run(FactViews(files), o).select("file", "line", "message").collect()]  # a fixture is a few files
        left, missing = list(found), 0
        for e in x.get("expect", ()):
            hit = next((f for f in left if f[0] == e["file"] and f[1] == e["line"] and e.get("message_contains", "") in f[2]), None)
            if hit is None:
                missing += 1
            else:
                left.remove(hit)
        rows.append((x["name"], x["rule"], len(x.get("expect", ())), len(found), "missing" if missing else "unexpected" if left else "pass"))
    return spark.createDataFrame(rows, "fixture string, rule_id string, expected int, found int, status string")
