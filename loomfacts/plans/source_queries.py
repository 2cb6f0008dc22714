"""Queries over the facts of source files, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import any_glob, in_scope
from ..functions.text import contains_any_folded, import_package_name
from ..operators import extract as X
from ..operators import policy as P
from ..rules import RuleOptions, rule, run_rules
from ..session import table
from ..views import FactViews

Query = Callable[[SparkSession, str], DataFrame]


def _on_files(fact: Callable[[DataFrame], DataFrame], then: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fact(table(spark, sf_dir, "source_files"))
        return then(df) if then else df

    return run


def _imported_packages(df: DataFrame) -> DataFrame:
    scripts = df.where((F.col("language") != "go") & ~F.col("path").startswith("."))
    return scripts.groupBy(import_package_name(F.col("path")).alias("package")).agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("id").alias("files"))


def _module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    file_nodes = X.source_files(files).select(F.lit("file").alias("kind"), F.concat("repo_id", F.lit("/"), "relative_path").alias("label"))
    packages = X.resolved_imports(files).where("status = 'external'").select(F.lit("external").alias("kind"), F.col("path").alias("label"))
    return file_nodes.unionByName(packages).distinct()


def _module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    return X.resolved_imports(files).groupBy("id", "path", "status").agg(F.count(F.lit(1)).alias("imports"), F.min("line_no").alias("first_line"))


def _exported_names(df: DataFrame) -> DataFrame:
    return df.where("is_exported").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def _missing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    go = X.source_files(files).where("language = 'go'").where(~F.col("relative_path").rlike(r"_test\.go$"))
    return go.join(X.related_tests(files).select("id").distinct(), "id", "left_anti").select("id", "relative_path")


def _views(spark: SparkSession, sf_dir: str) -> FactViews:
    return FactViews(table(spark, sf_dir, "source_files"))


def _reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).references.all().groupBy("status").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("callee").alias("names"))


def _call_events_missing_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).missing_guard(P.GuardQuery(P.EventPattern.call("info"), P.GuardPattern.call_any("push", "filter")))


def _call_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir).forbidden_flow(P.FlowQuery(P.EventPattern.call("push"), P.SinkPattern.logger(), P.BarrierPattern.call_any("report"), 5))


def _long_files(views: FactViews, options: RuleOptions) -> DataFrame:
    found = views.file_metrics.over_line_count(options.max or 120).join(views.source_files.all().select("id", "relative_path"), "id")
    return found.select(F.col("relative_path").alias("file"), F.lit(1).alias("line"), F.format_string("file has %d lines", "line_count").alias("message"))


def _denied_literals(views: FactViews, options: RuleOptions) -> DataFrame:
    found = views.string_literals.all().where(contains_any_folded(F.col("value"), list(options.deny) or ["budget exceeded"])).join(views.source_files.all().select("id", "relative_path"), "id")
    return found.select(F.col("relative_path").alias("file"), F.col("line_no").alias("line"), F.concat(F.lit("literal "), "value").alias("message"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule("metrics/long-file", ["file_metrics"])(_long_files)
    rule("literals/denied", ["string_literals"])(_denied_literals)
    return run_rules(spark, _views(spark, sf_dir)).groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("diagnostics"), F.min("text_range.start_line").alias("first_line"))


QUERIES: dict[str, Query] = {
    "src_symbols_by_kind": lambda s, p: _views(s, p).symbols.all().groupBy("kind", "is_exported").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("name").alias("names")),
    "src_reference_status": _reference_status,
    "src_call_events_missing_guard": _call_events_missing_guard,
    "src_call_flow": _call_flow,
    "src_rules": _rules,
    "src_files": _on_files(X.source_files),
    "src_file_metrics": _on_files(X.file_metrics),
    "src_over_line_count": _on_files(X.file_metrics, lambda d: d.where("line_count > 120").select("id", "line_count")),
    "src_over_byte_count": _on_files(X.file_metrics, lambda d: d.where("byte_count > 5000").select("id", "byte_count")),
    "src_over_function_count": _on_files(X.file_metrics, lambda d: d.where("function_count > 6").select("id", "function_count")),
    "src_metrics_for_language": _on_files(X.file_metrics, lambda d: d.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("byte_count").alias("bytes"), F.sum("function_count").alias("functions"))),
    "src_go_packages": _on_files(X.packages),
    "src_imports": _on_files(X.imports),
    "src_imported_packages": _on_files(X.imports, _imported_packages),
    "src_functions": _on_files(X.functions),
    "src_function_metrics": _on_files(X.function_metrics),
    "src_over_complexity": _on_files(X.function_metrics, lambda d: d.where("cyclomatic_complexity > 8").select("id", "name", "cyclomatic_complexity")),
    "src_over_function_lines": _on_files(X.function_metrics, lambda d: d.where("line_count > 30").select("id", "name", "line_count")),
    "src_call_names": _on_files(X.call_names, lambda d: d.groupBy("callee").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("id").alias("files"))),
    "src_go_types": _on_files(X.go_types),
    "src_ts_classes": _on_files(X.ts_classes),
    "src_ts_components": _on_files(X.ts_components),
    "src_string_literals": _on_files(X.string_literals),
    "src_literal_denylist": _on_files(X.string_literals, lambda d: d.where(contains_any_folded(F.col("value"), ["Retry", "BUDGET"])).select("id", "line_no", "position", "value")),
    "src_jsx_attributes": _on_files(X.jsx_attributes),
    "src_branch_obligations": _on_files(X.branch_obligations),
    "src_error_branches_by_kind": _on_files(X.branch_obligations, lambda d: d.groupBy("kind").agg(F.count(F.lit(1)).alias("branches"), F.count_if("is_error_path").alias("error_paths"))),
    "src_exported_names": _on_files(X.functions, _exported_names),
    "src_test_files": _on_files(X.test_files, lambda d: d.select("id", "relative_path")),
    "src_related_tests": _on_files(X.related_tests),
    "src_untested_go_files": _missing_tests,
    "src_resolved_imports": _on_files(X.resolved_imports),
    "src_import_status": _on_files(X.resolved_imports, lambda d: d.groupBy("status").agg(F.count(F.lit(1)).alias("imports"))),
    "src_module_nodes": _module_nodes,
    "src_module_edges": _module_edges,
    "src_in_scope": _on_files(X.source_files, lambda d: d.where(in_scope(F.col("relative_path"), ["**/*.go", "web/**"], ["**/*_test.go"], ["web/none.go"])).select("id", "relative_path")),
    "src_glob_matches": _on_files(X.source_files, lambda d: d.where(any_glob(F.col("relative_path"), ["{lib,pkg}/**/*.ts", "src/*/*.g?", "[wm]*/*/*.jsx"])).select("id", "relative_path")),
}

# Building blocks of the SQL below.
_LANG = "CASE lower(regexp_extract(relative_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXTENSIONS.items()) + " ELSE 'unknown' END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FILES = f"f AS (SELECT DISTINCT id, repo_id, relative_path, {_LANG} AS language, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS directory, content_hash, source FROM source_files)"
_LINES = f"""{_FILES}, l0 AS (SELECT id, language, string_split(regexp_replace(source, '^\ufeff', ''), chr(10)) AS a FROM f WHERE source IS NOT NULL),
l AS (SELECT id, language, generate_subscripts(a, 1) AS line_no, regexp_replace(unnest(a), '\\r$', '') AS line FROM l0)"""
_SCRIPT = "language IN ('typescript', 'tsx', 'javascript', 'jsx')"


def _has(pattern: str) -> str:
    return f"regexp_matches(line, {_q(pattern)})"


def _get(pattern: str, group: int) -> str:
    return f"regexp_extract(line, {_q(pattern)}, {group})"


_METRICS = f"""m AS (SELECT id, language, CASE WHEN length(source) = 0 THEN 0 ELSE length(source) - length(replace(source, chr(10), '')) + CASE WHEN suffix(source, chr(10)) THEN 0 ELSE 1 END END AS line_count,
len(list_filter(string_split(source, chr(10)), lambda x: length(trim(regexp_replace(x, '[\\t\\r\\f ]+', '', 'g'))) > 0)) AS non_empty_line_count, strlen(source) AS byte_count,
len(regexp_extract_all(source, {_q("(?m)" + X.GO_FUNC + "|(?m)" + X.TS_FUNC)})) AS function_count FROM f WHERE source IS NOT NULL)"""
_IMPORTS = f"""i AS (SELECT DISTINCT id, language, line_no, {_get(X.GO_IMPORT, 2)} AS path, {_get(X.GO_IMPORT, 1)} AS alias FROM l WHERE language = 'go' AND {_has(X.GO_IMPORT)}
UNION SELECT id, language, line_no, {_get(X.TS_IMPORT, 1)}, '' FROM l WHERE {_SCRIPT} AND {_has(X.TS_IMPORT)})"""
_TS_NAME = f"coalesce(nullif({_get(X.TS_FUNC, 1)}, ''), {_get(X.TS_FUNC, 2)})"
_FUNCTIONS = f"""fn AS (SELECT DISTINCT id, language, {_get(X.GO_FUNC, 1)} AS name, line_no, regexp_matches({_get(X.GO_FUNC, 1)}, '^[A-Z]') AS is_exported, regexp_matches({_get(X.GO_FUNC, 1)}, '^(Test|Benchmark|Fuzz|Example)') AS is_test
FROM l WHERE language = 'go' AND {_has(X.GO_FUNC)} UNION SELECT id, language, {_TS_NAME}, line_no, line LIKE 'export %', FALSE FROM l WHERE {_SCRIPT} AND {_has(X.TS_FUNC)})"""
_NOT = ", ".join(f"'{x}'" for x in X.NOT_CALLS)
_CALLS_OF = f"len(list_filter(regexp_extract_all(line, {_q(X.CALL)}, 1), lambda x: x NOT IN ({_NOT})))"
_FUNCTION_METRICS = f"""n1 AS (SELECT *, sum((CASE WHEN language = 'go' THEN {_has(X.GO_FUNC)} ELSE {_has(X.TS_FUNC)} END)::INT) OVER (PARTITION BY id ORDER BY line_no) AS k FROM l WHERE language <> 'unknown'),
n2 AS (SELECT *, coalesce(sum(regexp_matches(line, '^[}})]')::INT) OVER (PARTITION BY id, k ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM n1 WHERE k > 0),
fm AS (SELECT id, arg_min(coalesce(nullif({_get(X.GO_FUNC, 1)}, ''), {_TS_NAME}), line_no) AS name, min(line_no) AS start_line, count(*) AS line_count, sum(strlen(line) + 1)::BIGINT AS byte_count,
1 + sum(len(regexp_extract_all(line, {_q(X.DECISION)}))) AS cyclomatic_complexity, sum({_CALLS_OF}) AS calls FROM n2 WHERE closed = 0 GROUP BY id, k)"""
_COMMENT = "regexp_matches(line, '^\\s*(//|\\*|/\\*)')"
_LITERALS = f"""s0 AS (SELECT DISTINCT id, line_no, regexp_extract_all(line, {_q(X.STRING)}, 1) AS a FROM l WHERE language <> 'unknown' AND NOT {_has(X.GO_IMPORT + "|" + X.TS_IMPORT)} AND NOT {_COMMENT}),
s AS (SELECT id, line_no, generate_subscripts(a, 1) - 1 AS position, unnest(a) AS value FROM s0)"""
_BRANCHES = f"""b AS (SELECT DISTINCT id, line_no, {_get(X.BRANCH, 1)} AS kind, {_get(X.BRANCH, 2)} AS condition, {" OR ".join(f"contains(regexp_replace(lower({_get(X.BRANCH, 2)}), chr(92) || 's', '', 'g'), '{t}')" for t in X.ERROR_TERMS)} AS is_error_path
FROM l WHERE language <> 'unknown' AND {_has(X.BRANCH)})"""
# The folder is cut by the number of leading ``../``; all other segments stay, unlike in the operator, which folds over segments.
_DOTS = "len(regexp_extract(path, '^((?:\\./)*(?:\\.\\./)*)', 1))"
_UPS = "len(regexp_extract_all(regexp_extract(path, '^((?:\\./)*(?:\\.\\./)*)', 1), '\\.\\./'))"
_PARTS = "CASE WHEN directory = '' THEN [] ELSE string_split(directory, '/') END"
_PROBES = ", ".join(f"b || '.{e}'" for e in X.PROBED)
_INDEX = ", ".join(f"b || '/index.{e}'" for e in X.PROBED)
_RESOLVED = f"""j AS (SELECT i.*, f.repo_id, f.directory FROM i JOIN (SELECT DISTINCT id, repo_id, directory FROM f) f USING (id)),
c0 AS (SELECT id, line_no, path, repo_id, array_to_string(list_concat(list_slice({_PARTS}, 1, len({_PARTS}) - {_UPS}), [substr(path, {_DOTS} + 1)]), '/') AS b FROM j WHERE path LIKE '.%' AND language <> 'go' AND len({_PARTS}) >= {_UPS}),
c1 AS (SELECT id, line_no, path, repo_id, [CASE WHEN regexp_matches(b, '\\.[cm]?[jt]sx?$') THEN b END, {_PROBES}, CASE WHEN b LIKE '%.js' THEN b[:-4] || '.ts' END, CASE WHEN b LIKE '%.js' THEN b[:-4] || '.tsx' END, CASE WHEN b LIKE '%.jsx' THEN b[:-5] || '.tsx' END, CASE WHEN b LIKE '%.mjs' THEN b[:-5] || '.mts' END, CASE WHEN b LIKE '%.cjs' THEN b[:-5] || '.cts' END, {_INDEX}] AS a FROM c0),
c AS (SELECT id, line_no, path, repo_id, generate_subscripts(a, 1) AS priority, unnest(a) AS candidate FROM c1),
h AS (SELECT c.id, line_no, path, arg_min(t.id, priority) AS target FROM c JOIN (SELECT DISTINCT id, repo_id, relative_path FROM f) t ON t.repo_id = c.repo_id AND t.relative_path = candidate GROUP BY c.id, line_no, path),
r AS (SELECT j.id, j.line_no, j.path, target, CASE WHEN contains(j.path, '${{') THEN 'dynamic' WHEN target IS NOT NULL THEN 'resolved' WHEN j.path LIKE '.%' THEN 'unresolved' WHEN j.path LIKE '@app/%' THEN 'setup_missing' ELSE 'external' END AS status
FROM j LEFT JOIN h ON h.id = j.id AND h.line_no = j.line_no AND h.path = j.path)"""
_RELATED = """g AS (SELECT DISTINCT id, repo_id, relative_path, directory FROM f WHERE language = 'go'),
rt AS (SELECT a.id, b.id AS test_id FROM g a JOIN g b USING (repo_id, directory) WHERE NOT regexp_matches(a.relative_path, '_test\\.go$') AND regexp_matches(b.relative_path, '_test\\.go$'))"""
_PKG = "CASE WHEN path LIKE '@%' THEN regexp_extract(path, '^(@[^/]+/[^/]+|@[^/]*)', 1) ELSE regexp_extract(path, '^([^/]*)', 1) END"
_CALLS = f"""k0 AS (SELECT DISTINCT id, line_no, regexp_extract_all(line, {_q(X.CALL)}, 1) AS a FROM l WHERE language <> 'unknown' AND NOT {_has(X.GO_FUNC + "|" + X.TS_FUNC)} AND NOT {_COMMENT}),
k AS (SELECT id, line_no, unnest(a) AS callee FROM k0)"""

_TYPES = f"""ty AS (SELECT DISTINCT id, {_get(X.GO_TYPE, 1)} AS name, line_no FROM l WHERE language = 'go' AND {_has(X.GO_TYPE)}),
cl AS (SELECT DISTINCT id, {_get(X.TS_CLASS, 1)} AS name, line_no, line LIKE 'export %' AS is_exported FROM l WHERE {_SCRIPT} AND {_has(X.TS_CLASS)}),
sy AS (SELECT id, name, 'function' AS kind, is_exported FROM fn UNION ALL SELECT id, name, 'type', regexp_matches(name, '^[A-Z]') FROM ty UNION ALL SELECT id, name, 'class', is_exported FROM cl)"""
_CALL_ROWS = f"""k0 AS (SELECT DISTINCT id, line_no, regexp_extract_all(line, {_q(X.CALL)}, 1) AS a FROM l WHERE language <> 'unknown' AND NOT {_has(X.GO_FUNC + "|" + X.TS_FUNC)} AND NOT {_COMMENT}),
k1 AS (SELECT id, line_no, generate_subscripts(a, 1) - 1 AS position, unnest(a) AS callee FROM k0), k AS (SELECT * FROM k1 WHERE callee NOT IN ({_NOT})),
ev AS (SELECT id AS scope, line_no::BIGINT * 1048576 + position AS position, callee AS name FROM k)"""


def _named(*names: str) -> str:
    return "(" + " OR ".join(f"name = '{n}' OR list_last(string_split(name, '.')) = '{n}'" for n in names) + ")"


SQL = {
    "src_symbols_by_kind": f"WITH {_LINES}, {_FUNCTIONS}, {_TYPES} SELECT kind, is_exported, count(*) AS symbols, count(DISTINCT name) AS names FROM sy GROUP BY 1, 2",
    "src_reference_status": f"""WITH {_LINES}, {_FUNCTIONS}, {_TYPES}, {_CALL_ROWS}, kn AS (SELECT name, count(*) AS c FROM sy GROUP BY 1)
        SELECT CASE WHEN c IS NULL THEN 'unresolved' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, count(*) AS calls, count(DISTINCT callee) AS names FROM k LEFT JOIN kn ON kn.name = callee GROUP BY 1""",
    "src_call_events_missing_guard": f"WITH {_LINES}, {_CALL_ROWS}, g AS (SELECT scope, min(position) AS p FROM ev WHERE {_named('push', 'filter')} GROUP BY 1) SELECT ev.* FROM ev LEFT JOIN g USING (scope) WHERE {_named('info')} AND (p IS NULL OR p >= position)",
    "src_call_flow": f"""WITH {_LINES}, {_CALL_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY position) AS n FROM ev), a AS (SELECT * FROM o WHERE {_named('push')}), z AS (SELECT * FROM o WHERE name = 'log' OR regexp_matches(lower(name), '\\.(log|info|warn|error)$')), b AS (SELECT * FROM o WHERE {_named('report')})
        SELECT a.scope, a.position AS source, z.position AS sink, z.n - a.n AS steps FROM a JOIN z ON a.scope = z.scope AND z.n > a.n AND z.n <= a.n + 5 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.scope = a.scope AND b.n > a.n AND b.n < z.n)""",
    "src_rules": f"""WITH {_LINES}, {_METRICS}, {_LITERALS}, p AS (SELECT DISTINCT id, relative_path FROM f), d AS (SELECT DISTINCT 'metrics/long-file' AS rule_id, relative_path AS file, 1 AS line, 'file has ' || line_count || ' lines' AS message FROM m JOIN p USING (id) WHERE line_count > 120
        UNION SELECT 'literals/denied', relative_path, line_no, 'literal ' || value FROM s JOIN p USING (id) WHERE contains(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'budget exceeded'))
        SELECT rule_id, file, count(*) AS diagnostics, min(line) AS first_line FROM d GROUP BY 1, 2""",
    "src_files": f"WITH {_FILES} SELECT DISTINCT id, repo_id, relative_path, language, directory, content_hash FROM f",
    "src_file_metrics": f"WITH {_FILES}, {_METRICS} SELECT * FROM m",
    "src_over_line_count": f"WITH {_FILES}, {_METRICS} SELECT id, line_count FROM m WHERE line_count > 120",
    "src_over_byte_count": f"WITH {_FILES}, {_METRICS} SELECT id, byte_count FROM m WHERE byte_count > 5000",
    "src_over_function_count": f"WITH {_FILES}, {_METRICS} SELECT id, function_count FROM m WHERE function_count > 6",
    "src_metrics_for_language": f"WITH {_FILES}, {_METRICS} SELECT language, count(*) AS files, sum(line_count)::BIGINT AS lines, sum(byte_count)::BIGINT AS bytes, sum(function_count)::BIGINT AS functions FROM m GROUP BY 1",
    "src_go_packages": f"WITH {_LINES} SELECT DISTINCT id, {_get(X.GO_PACKAGE, 1)} AS name, line_no FROM l WHERE language = 'go' AND {_has(X.GO_PACKAGE)}",
    "src_imports": f"WITH {_LINES}, {_IMPORTS} SELECT * FROM i",
    "src_imported_packages": f"WITH {_LINES}, {_IMPORTS} SELECT {_PKG} AS package, count(*) AS imports, count(DISTINCT id) AS files FROM i WHERE language <> 'go' AND path NOT LIKE '.%' GROUP BY 1",
    "src_functions": f"WITH {_LINES}, {_FUNCTIONS} SELECT * FROM fn",
    "src_function_metrics": f"WITH {_LINES}, {_FUNCTION_METRICS} SELECT * FROM fm",
    "src_over_complexity": f"WITH {_LINES}, {_FUNCTION_METRICS} SELECT id, name, cyclomatic_complexity FROM fm WHERE cyclomatic_complexity > 8",
    "src_over_function_lines": f"WITH {_LINES}, {_FUNCTION_METRICS} SELECT id, name, line_count FROM fm WHERE line_count > 30",
    "src_call_names": f"WITH {_LINES}, {_CALLS} SELECT callee, count(*) AS calls, count(DISTINCT id) AS files FROM k WHERE callee NOT IN ({_NOT}) GROUP BY 1",
    "src_go_types": f"WITH {_LINES} SELECT DISTINCT id, line_no, {_get(X.GO_TYPE, 1)} AS name, CASE WHEN {_get(X.GO_TYPE, 2)} IN ('struct', 'interface') THEN {_get(X.GO_TYPE, 2)} WHEN {_get(X.GO_TYPE, 2)} = '=' THEN 'alias' ELSE 'named' END AS kind FROM l WHERE language = 'go' AND {_has(X.GO_TYPE)}",
    "src_ts_classes": f"WITH {_LINES} SELECT DISTINCT id, line_no, {_get(X.TS_CLASS, 1)} AS name, line LIKE 'export %' AS is_exported, regexp_matches(line, 'extends (React\\.)?(Pure)?Component') AS is_component_like FROM l WHERE {_SCRIPT} AND {_has(X.TS_CLASS)}",
    "src_ts_components": f"WITH {_LINES}, {_FUNCTIONS} SELECT id, name, line_no FROM fn WHERE language IN ('tsx', 'jsx') AND regexp_matches(name, '^[A-Z]')",
    "src_string_literals": f"WITH {_LINES}, {_LITERALS} SELECT * FROM s",
    "src_literal_denylist": f"WITH {_LINES}, {_LITERALS} SELECT * FROM s WHERE contains(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'retry') OR contains(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'budget')",
    "src_jsx_attributes": f"WITH {_LINES}, a0 AS (SELECT DISTINCT id, line_no, regexp_extract_all(line, {_q(X.JSX_ATTRIBUTE)}) AS a FROM l WHERE language IN ('tsx', 'jsx') AND regexp_matches(line, '^\\s*<')), a1 AS (SELECT id, line_no, generate_subscripts(a, 1) - 1 AS position, unnest(a) AS line FROM a0) SELECT id, line_no, position, {_get(X.JSX_ATTRIBUTE, 1)} AS name, {_get(X.JSX_ATTRIBUTE, 2)} AS value FROM a1",
    "src_branch_obligations": f"WITH {_LINES}, {_BRANCHES} SELECT * FROM b",
    "src_error_branches_by_kind": f"WITH {_LINES}, {_BRANCHES} SELECT kind, count(*) AS branches, count(*) FILTER (is_error_path) AS error_paths FROM b GROUP BY 1",
    "src_exported_names": f"WITH {_LINES}, {_FUNCTIONS} SELECT id, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM fn WHERE is_exported GROUP BY id",
    "src_test_files": f"WITH {_FILES} SELECT DISTINCT id, relative_path FROM f WHERE regexp_matches(relative_path, '_test\\.go$|\\.(test|spec)\\.[cm]?[jt]sx?$')",
    "src_related_tests": f"WITH {_FILES}, {_RELATED} SELECT * FROM rt",
    "src_untested_go_files": f"WITH {_FILES}, {_RELATED} SELECT id, relative_path FROM g WHERE NOT regexp_matches(relative_path, '_test\\.go$') AND id NOT IN (SELECT id FROM rt)",
    "src_resolved_imports": f"WITH {_LINES}, {_IMPORTS}, {_RESOLVED} SELECT * FROM r",
    "src_import_status": f"WITH {_LINES}, {_IMPORTS}, {_RESOLVED} SELECT status, count(*) AS imports FROM r GROUP BY 1",
    "src_module_nodes": f"WITH {_LINES}, {_IMPORTS}, {_RESOLVED} SELECT 'file' AS kind, repo_id || '/' || relative_path AS label FROM f UNION SELECT 'external', path FROM r WHERE status = 'external'",
    "src_module_edges": f"WITH {_LINES}, {_IMPORTS}, {_RESOLVED} SELECT id, path, status, count(*) AS imports, min(line_no) AS first_line FROM r GROUP BY 1, 2, 3",
    "src_in_scope": f"WITH {_FILES} SELECT DISTINCT id, relative_path FROM f WHERE (regexp_matches(relative_path, '^(?:.*/)?[^/]*\\.go$') OR relative_path LIKE 'web/%') AND NOT regexp_matches(relative_path, '_test\\.go$') AND relative_path <> 'web/none.go'",
    "src_glob_matches": f"WITH {_FILES} SELECT DISTINCT id, relative_path FROM f WHERE regexp_matches(relative_path, '^(?:lib|pkg)/(?:.*/)?[^/]*\\.ts$') OR regexp_matches(relative_path, '^src/[^/]*/[^/]*\\.g[^/]$') OR regexp_matches(relative_path, '^[wm][^/]*/[^/]*/[^/]*\\.jsx$')",
}
