"""Queries over facts from tokens and the relations on them; SQL where an independent pattern over whole texts can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators import fixpoint as G
from ..operators.control_flow import control_flow
from ..operators.facts import Facts, evidence_projection
from ..session import materialise, table
from .source_queries import _LINES

Query = Callable[[SparkSession, str], DataFrame]

def _on(f: Callable[[Facts], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Facts(table(spark, sf_dir, "source_files")))


def _flow(view: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Facts(table(spark, sf_dir, "source_files")).blocks.select("function", "src", "dst")
        return control_flow(e, e.select("function").distinct().withColumn("entry", F.lit(0)), view)

    return run


def _taint(f: Facts) -> DataFrame:
    """From parameters of exported functions to results of functions, through calls and returns that match."""
    sources = f.functions.where("is_exported and fn >= 0").select(F.explode("parameters").alias("p"), "key").select(F.concat_ws("#", "key", "p").alias("node"))
    sinks = f.functions.select(F.concat_ws("#", "key", F.lit("<return>")).alias("node"))
    return D.taint_paths(materialise(f.flow_edges(), "flow"), sources, sinks)


def _taint_rows(f: Facts) -> DataFrame:
    return _taint(f).select("source", "sink", "depth", F.array_join("path", " > ").alias("path"), "status")


def _effects(f: Facts) -> DataFrame:
    """The effects of each function and of all that it calls."""
    calls = materialise(f.direct_edges.select("caller", "callee").distinct(), "calls")
    every = f.functions.select(F.col("key").alias("node"))
    scc = G.strong_components(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    components = materialise(scc.unionByName(every.join(scc, "node", "left_anti").select("node", F.col("node").alias("component"))), "components")
    return D.bottom_up_summaries(calls, f.effects, components)


def _call_schedule(f: Facts) -> DataFrame:
    e = f.direct_edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return G.call_schedule(materialise(e.distinct(), "calls"))


QUERIES: dict[str, Query] = {
    "fact_functions": _on(lambda f: f.functions.select("id", "fn", "name", "kind", "owner", F.array_join("parameters", ",").alias("parameters"), "line", "end_line", "complexity", "is_exported", "is_test")),
    "fact_go_functions": _on(lambda f: f.functions.where("language = 'go' and fn >= 0").select("id", "name", "line", "is_exported")),
    "fact_types": _on(lambda f: f.types.select("id", "line", "name", "kind", "generic", "base", "is_exported", "is_component_like", F.array_join("members", ",").alias("members"))),
    "fact_go_types": _on(lambda f: f.types.where("kind <> 'class'").select("id", "line", "name")),
    "fact_classes": _on(lambda f: f.types.where("kind = 'class' and name <> ''").select("id", "line", "name", "is_exported")),
    "fact_packages": _on(lambda f: f.of("package").select("id", "line", "name")),
    "fact_imports": _on(lambda f: f.imports.select("id", "line", "path", "kind", "alias")),
    "fact_go_imports": _on(lambda f: f.imports.where("language = 'go'").select("id", "line", "path", "alias")),
    "fact_literals": _on(lambda f: f.literals.select("id", "line", "position", "value", "quote")),
    "fact_calls": _on(lambda f: f.calls.groupBy("callee", "kind").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("id").alias("files"))),
    "fact_branches": _on(lambda f: f.branches),
    "fact_tests": _on(lambda f: f.tests.select("function", "name", "assertions", "subtests", "table_rows", F.size("evidence").alias("words"))),
    "fact_blocks": _on(lambda f: f.blocks),
    "fact_operations": _on(lambda f: f.operations.groupBy("function", "kind").agg(F.count(F.lit(1)).alias("operations"))),
    "fact_scopes": _on(lambda f: f.scopes.groupBy("function", "binding").agg(F.count(F.lit(1)).alias("names"))),
    "fact_symbols": _on(lambda f: f.symbols.groupBy("kind", "is_exported").agg(F.count(F.lit(1)).alias("symbols"))),
    "fact_call_edges": _on(lambda f: f.call_edges().select("caller", "callee", "id", "site", "tier", "status", "precision")),
    "fact_dispatch": _on(lambda f: f.solver_edges),
    "fact_local_flow": _on(lambda f: f.local_flow.select("src", "dst", "kind")),
    "fact_call_flow": _on(lambda f: f.call_flow),
    "fact_taint_in_out": _on(lambda f: f.taint_in_taint_out),
    "fact_effects": _on(_effects),
    "fact_points_to": _on(lambda f: f.points_to),
    "fact_graph_nodes": _on(lambda f: f.graph_nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))),
    "fact_membership": _on(lambda f: f.membership.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))),
    "fact_entrypoints": _on(lambda f: f.entrypoints),
    "fact_taint_paths": _on(_taint_rows),
    "fact_evidence": _on(lambda f: evidence_projection(_taint(f))),
    "fact_dominators": _flow("dominators"),
    "fact_postdominators": _flow("postdominators"),
    "fact_control_dependence": _flow("dependence"),
    "fact_reachable_blocks": _flow("reachable"),
    "fact_call_schedule": _on(_call_schedule),
}

# Declarations stand at the beginning of a line in the test tables: patterns over lines, written without the lexer.
SQL = {
    "fact_go_functions": rf"WITH {_LINES}, x AS (SELECT DISTINCT id, line_no, line, regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]', 1) AS name FROM l WHERE language = 'go') SELECT id, name, line_no AS line, regexp_matches(name, '^[A-Z]') AS is_exported FROM x WHERE name <> ''",
    "fact_go_types": rf"WITH {_LINES}, x AS (SELECT DISTINCT id, line_no, regexp_extract(line, '^type\s+(\w+)\s', 1) AS name FROM l WHERE language = 'go') SELECT id, line_no AS line, name FROM x WHERE name <> ''",
    "fact_classes": rf"WITH {_LINES}, x AS (SELECT DISTINCT id, line_no, line, regexp_extract(line, '^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)', 1) AS name FROM l WHERE language IN ('typescript', 'tsx', 'javascript', 'jsx')) SELECT id, line_no AS line, name, starts_with(line, 'export') AS is_exported FROM x WHERE name <> ''",
    "fact_packages": rf"WITH {_LINES}, x AS (SELECT DISTINCT id, line_no, regexp_extract(line, '^package\s+(\w+)', 1) AS name FROM l WHERE language = 'go') SELECT id, line_no AS line, name FROM x WHERE name <> ''",
    "fact_go_imports": rf"""WITH {_LINES}, x AS (SELECT DISTINCT id, line_no, regexp_extract(line, '^(?:import\s+|\s+)(?:([\w.]+)\s+)?"([^"\s]+)"\s*(?://.*)?$', ['alias', 'path']) AS m FROM l WHERE language = 'go') SELECT id, line_no AS line, m.path AS path, m.alias AS alias FROM x WHERE m.path <> ''""",
}
