"""Queries over entry points, paths, summaries and incremental work, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators import entrypoints as EP
from ..operators import extract as X
from ..operators import fixpoint as G
from ..operators import incremental as I
from ..operators import resolution as RS
from ..session import table
from .graph_queries import _J, _V, _chain, _journey_edges, _journeys
from ..views import FactViews
from .source_queries import _CALL_ROWS, _FILES, _FUNCTIONS, _LINES, _TYPES, _get, _has, _q

Query = Callable[[SparkSession, str], DataFrame]


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    return EP.roots(X.functions(files), X.packages(files), configured=["report.DecodeSpan"])


def _entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported functions by the top folder of their file: cmd is a command, server and services are routes, tests are tests."""
    files = table(spark, sf_dir, "source_files")
    x = X.functions(files).where("is_exported").join(X.source_files(files).select("id", "relative_path"), "id")
    top = F.regexp_extract("relative_path", "^([^/]*)/", 1)
    kind = F.when(F.col("relative_path").rlike(r"_test\.go$|\.test\."), "test").when(top == "cmd", "cli_command").when(top.isin("server", "services"), "http_route").when(top == "web", "middleware").otherwise("unknown")
    method = F.when(F.col("name").startswith("Load") | F.col("name").startswith("load"), "GET").when(F.lower("name").startswith("register"), "POST")
    return x.select(F.concat_ws("#", F.col("id").cast("string"), "name").alias("entrypoint"), F.col("name").alias("function"), kind.alias("kind"), method.alias("method"), F.concat(F.lit("/"), top, F.when(F.lower("name").endswith("byname"), "/:name").otherwise("")).alias("path")).distinct()


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.trust_boundaries(_entrypoints(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("entrypoints"))


def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.dispatch_edges(_entrypoints(spark, sf_dir)).groupBy("edge_kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("function").alias("functions"))


def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.topology_overlays(table(spark, sf_dir, "source_files")).groupBy("repo_id", "overlay").agg(F.count(F.lit(1)).alias("files"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as models: their source is the rule, their target what its diagnostics name, their scope the severity."""
    d = table(spark, sf_dir, "report_diagnostics")
    m = d.groupBy(F.coalesce("rule_id", F.lit("")).alias("source"), F.coalesce("file", F.lit("")).alias("target"), F.col("severity").alias("scope")).agg(F.collect_set(F.get("evidence", F.lit(0))["label"]).alias("evidence"))
    known = table(spark, sf_dir, "rule_catalog").select(F.col("rule_id").alias("key")).union(d.where("severity = 'error' and file is not null").select("file"))
    return EP.validate_models(m, known).groupBy("reason").agg(F.count(F.lit(1)).alias("models"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ways through each week of a user, from its first type of event to its last; rare lengths of names cost more."""
    e, ends = _journeys(spark, sf_dir)
    node = lambda c: F.concat_ws(":", "function", c)
    edges = e.select(node("src").alias("src"), node("dst").alias("dst"), F.abs(F.length("src") - F.length("dst")).alias("p"))
    found = D.ranked_paths(edges, ends.select(node("entry").alias("start"), node("exit").alias("end")), "p", 4, 4)
    return found.select("start", "end", F.array_join("path", ">").alias("path"), "cost", "rank")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot inherits: the tool versions of itself and all later ones of its series."""
    edges, _, s = _chain(spark, sf_dir)
    calls = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    own = s.select(F.col("snapshot_id").alias("function"), F.col("tool_version").alias("effect"))
    each = s.select(F.col("snapshot_id").alias("node"), F.col("snapshot_id").alias("component"))
    return D.bottom_up_summaries(calls, own, each)


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("repo_id", "relative_path", "content_hash").distinct()
    return I.input_digests(files, ["repo_id"], "relative_path", "content_hash")


def _change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rules differ between the catalogue's default and the gravest severity seen."""
    catalog = table(spark, sf_dir, "rule_catalog").select("rule_id", F.col("default_severity").alias("api"), F.col("title").alias("content"))
    seen = table(spark, sf_dir, "report_diagnostics").where("rule_id is not null").groupBy("rule_id").agg(F.max("severity").alias("api")).join(catalog.select("rule_id", "content"), "rule_id", "left")
    return I.change_rows(catalog, seen.select("rule_id", "api", "content"), "rule_id", {"content": "content", "api": "api"})


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies behind aborted snapshots: a backward slice over their chain."""
    edges, _, s = _chain(spark, sf_dir)
    e = edges.withColumn("kind", F.lit("copy")).withColumn("certain", F.lit(True))
    return D.slice_graph(e, s.where("status = 'aborted'").select(F.col("snapshot_id").alias("node")), ["copy"], most_nodes=10**9)[0].select("node", "depth")


def _taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the first snapshots to aborted ones which no snapshot of tool version 0.3.1 interrupts."""
    edges, first, s = _chain(spark, sf_dir)
    e = edges.withColumn("kind", F.lit("copy")).withColumn("site", F.lit(None).cast("string"))
    bad = s.where("status = 'aborted'").select(F.col("snapshot_id").alias("node"))
    found = D.taint_paths(e, first, bad, s.where("tool_version = '0.3.1' and status <> 'aborted'").select(F.col("snapshot_id").alias("node")))
    return found.select("source", "sink", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "status")


def _reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, first, _ = _chain(spark, sf_dir)
    return G.reachable(edges, first).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def _call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    found = RS.call_targets(X.call_names(files), FactViews(files).symbols.all(), ["len", "append", "make", "require"])
    return found.groupBy("status", "algorithm", "reason").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("callee").alias("names"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntactic names, since there are neither refined edges nor resolved sites of the test callee."""
    names = X.call_names(table(spark, sf_dir, "source_files")).select(F.col("id").alias("caller"), "callee")
    none = names.limit(0).withColumn("status", F.lit("")).withColumn("precision", F.lit(""))
    return RS.tiered_edges(none, none, names).groupBy("tier", "status", "callee").agg(F.count(F.lit(1)).alias("edges"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pkg and of internal in folders of the same name, by repository."""
    return RS.paired_paths(table(spark, sf_dir, "source_files").where("repo_id is not null"), r"^pkg/([^/]+)/[^/]+$", r"^internal/([^/]+)/[^/]+$", keys=["repo_id"])


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("id", "relative_path").distinct()
    return RS.dense_ids(files, "relative_path")


def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RS.dot_lines(_journey_edges(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "res_call_targets": _call_targets,
    "res_tiers": _tiers,
    "res_paired_paths": _pairs,
    "res_dense_ids": _dense,
    "res_dot": _dot,
    "res_test_facts": lambda s, p: RS.test_facts(table(s, p, "source_files")),
    "res_directories": lambda s, p: RS.neighbours_in_directory(table(s, p, "source_files")),
    "ent_roots": _roots,
    "ent_trust_boundaries": _boundaries,
    "ent_dispatch": _dispatch,
    "ent_overlays": _overlays,
    "ent_model_validation": _models,
    "flow_ranked_paths": _ranked,
    "flow_summaries": _summaries,
    "flow_slice": _slice,
    "flow_taint_paths": _taint,
    "flow_reach_counts": _reach_counts,
    "inc_digests": _digests,
    "inc_change_rows": _change_rows,
}

_S = """s AS (SELECT series_id, snapshot_id, status, tool_version, lag(snapshot_id) OVER (PARTITION BY series_id ORDER BY taken_at, snapshot_id) AS prev FROM (SELECT DISTINCT series_id, snapshot_id, taken_at, status, tool_version FROM report_snapshots)), e AS (SELECT prev AS src, snapshot_id AS dst FROM s WHERE prev IS NOT NULL)"""
_EP = f"""ep AS (SELECT DISTINCT fn.id || '#' || name AS entrypoint, name AS function, CASE WHEN regexp_matches(relative_path, '_test\\.go$|\\.test\\.') THEN 'test' WHEN relative_path LIKE 'cmd/%' THEN 'cli_command' WHEN relative_path LIKE 'server/%' OR relative_path LIKE 'services/%' THEN 'http_route'
WHEN relative_path LIKE 'web/%' THEN 'middleware' ELSE 'unknown' END AS kind, CASE WHEN name LIKE 'Load%' OR name LIKE 'load%' THEN 'GET' WHEN lower(name) LIKE 'register%' THEN 'POST' END AS method, lower(name) LIKE '%byname' AS param
FROM fn JOIN (SELECT DISTINCT id, relative_path FROM f) p ON p.id = fn.id WHERE is_exported)"""
_PK = f"pk AS (SELECT DISTINCT id, {_get(X.GO_PACKAGE, 1)} AS package FROM l WHERE language = 'go' AND {_has(X.GO_PACKAGE)})"

SQL = {
    "res_call_targets": f"""WITH {_LINES}, {_FUNCTIONS}, {_TYPES}, {_CALL_ROWS}, kn AS (SELECT name, count(DISTINCT id) AS c FROM sy GROUP BY 1), lo AS (SELECT DISTINCT id, name FROM sy),
        r AS (SELECT k.callee, CASE WHEN lo.id IS NOT NULL OR c = 1 THEN 'resolved' WHEN c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN lo.id IS NOT NULL THEN 'lexical' WHEN c = 1 THEN 'import_binding' END AS algorithm FROM k LEFT JOIN lo ON lo.id = k.id AND lo.name = k.callee LEFT JOIN kn ON kn.name = k.callee)
        SELECT status, algorithm, CASE WHEN status <> 'unresolved' THEN NULL WHEN callee IN ('len', 'append', 'make', 'require') THEN 'builtin' WHEN contains(callee, '.') THEN 'dynamic' ELSE 'not_found' END AS reason, count(*) AS calls, count(DISTINCT callee) AS names FROM r GROUP BY 1, 2, 3""",
    "res_tiers": f"WITH {_LINES}, {_CALL_ROWS} SELECT 'name' AS tier, 'heuristic' AS status, callee, count(*) AS edges FROM k GROUP BY 3",
    "res_paired_paths": """WITH p AS (SELECT DISTINCT repo_id, relative_path FROM source_files WHERE repo_id IS NOT NULL), a AS (SELECT repo_id, regexp_extract(relative_path, '^pkg/([^/]+)/[^/]+$', 1) AS context, relative_path AS "left" FROM p WHERE regexp_matches(relative_path, '^pkg/([^/]+)/[^/]+$')),
        b AS (SELECT repo_id, regexp_extract(relative_path, '^internal/([^/]+)/[^/]+$', 1) AS context, relative_path AS "right" FROM p WHERE regexp_matches(relative_path, '^internal/([^/]+)/[^/]+$')) SELECT * FROM a JOIN b USING (repo_id, context)""",
    "res_dense_ids": "SELECT id, relative_path, dense_rank() OVER (ORDER BY relative_path) - 1 AS dense_id FROM (SELECT DISTINCT id, relative_path FROM source_files)",
    "res_dot": f"""WITH {_J} SELECT '  "' || src || '" -> "' || dst || '";' AS value FROM j""",
    "res_test_facts": f"""WITH {_LINES}, t AS (SELECT DISTINCT l.id, line_no, line FROM l JOIN f USING (id) WHERE regexp_matches(relative_path, '_test\\.go$|\\.(test|spec)\\.[cm]?[jt]sx?$'))
        SELECT id, sum(len(regexp_extract_all(line, {_q(RS.ASSERTION)})))::BIGINT AS assertion_count, sum(len(regexp_extract_all(line, {_q(RS.SUBTEST)})))::BIGINT AS subtest_count, count(*) FILTER (regexp_matches(line, {_q(RS.TABLE_ROW)})) AS table_rows FROM t GROUP BY 1""",
    "res_directories": f"WITH {_FILES} SELECT repo_id, directory, count(DISTINCT relative_path) AS files FROM f GROUP BY 1, 2",
    "ent_roots": f"""WITH {_LINES}, {_FUNCTIONS}, {_PK}, x AS (SELECT fn.*, package FROM fn LEFT JOIN pk USING (id)), k AS (SELECT id, name, 1 AS o, 'go_main' AS kind FROM x WHERE language = 'go' AND name = 'main' AND package = 'main' UNION ALL SELECT id, name, 2, 'go_init' FROM x WHERE language = 'go' AND name = 'init'
        UNION ALL SELECT id, name, 4, 'configured' FROM x WHERE name = 'DecodeSpan' UNION ALL SELECT id, name, CASE language WHEN 'go' THEN 5 ELSE 6 END, CASE language WHEN 'go' THEN 'go_exported' ELSE 'script_exported' END FROM x WHERE is_exported AND NOT is_test),
        r AS (SELECT id, name, arg_min(kind, o) AS kind FROM k GROUP BY 1, 2) SELECT *, CASE kind WHEN 'script_exported' THEN 'setup_aware' ELSE 'resolved_static' END AS precision FROM r""",
    "ent_trust_boundaries": f"""WITH {_LINES}, {_FUNCTIONS}, {_EP}, b AS (SELECT unnest(CASE kind WHEN 'http_route' THEN list_filter([CASE WHEN param THEN 'path_param' END, 'query_string', CASE WHEN method IS NULL OR method = 'POST' THEN 'request_body' END, 'request_header'], lambda x: x IS NOT NULL)
        WHEN 'middleware' THEN ['request_body', 'request_header', 'query_string'] WHEN 'cli_command' THEN ['cli_args', 'cli_flags'] WHEN 'test' THEN [] ELSE ['unknown'] END) AS source FROM ep) SELECT source, count(*) AS entrypoints FROM b GROUP BY 1""",
    "ent_dispatch": f"""WITH {_LINES}, {_FUNCTIONS}, {_EP} SELECT CASE kind WHEN 'http_route' THEN 'route' WHEN 'cli_command' THEN 'route' WHEN 'middleware' THEN 'middleware' WHEN 'test' THEN 'test' ELSE 'lifecycle' END AS edge_kind, count(*) AS edges, count(DISTINCT function) AS functions FROM ep GROUP BY 1""",
    "ent_overlays": """WITH p AS (SELECT DISTINCT repo_id, relative_path FROM source_files), o AS (SELECT repo_id, 'generated' AS overlay FROM p WHERE regexp_matches(relative_path, '(?:^|/)__generated__/|[._](?:gen|generated|pb)\\.[a-z]+$')
        UNION ALL SELECT repo_id, 'tests' FROM p WHERE regexp_matches(relative_path, '_test\\.go$|\\.(?:test|spec)\\.[cm]?[jt]sx?$|(?:^|/)(?:tests?|__tests__)/') UNION ALL SELECT repo_id, 'vendored' FROM p WHERE regexp_matches(relative_path, '(?:^|/)(?:vendor|node_modules|third_party)/')
        UNION ALL SELECT repo_id, 'internal' FROM p WHERE regexp_matches(relative_path, '(?:^|/)internal/') UNION ALL SELECT repo_id, 'deploy' FROM p WHERE regexp_matches(relative_path, '(?:^|/)(?:deploy|k8s|helm|terraform)/') UNION ALL SELECT repo_id, 'codeowners' FROM p WHERE regexp_matches(relative_path, '(?:^|/)CODEOWNERS$'))
        SELECT repo_id, overlay, count(*) AS files FROM o GROUP BY 1, 2""",
    "ent_model_validation": """WITH m AS (SELECT coalesce(rule_id, '') AS source, coalesce(file, '') AS target, severity AS scope, count(evidence[1].label) AS n FROM report_diagnostics GROUP BY 1, 2, 3), k AS (SELECT rule_id AS key FROM rule_catalog UNION SELECT file FROM report_diagnostics WHERE severity = 'error' AND file IS NOT NULL)
        SELECT CASE WHEN trim(source) = '' THEN 'empty_source' WHEN trim(target) = '' THEN 'empty_target' WHEN trim(coalesce(scope, '')) = '' THEN 'empty_scope' WHEN n = 0 THEN 'empty_evidence' WHEN source NOT IN (SELECT key FROM k) THEN 'unknown_source' WHEN target NOT IN (SELECT key FROM k) THEN 'unknown_target' END AS reason, count(*) AS models FROM m GROUP BY 1""",
    "flow_ranked_paths": f"""WITH RECURSIVE {_V}, pairs AS (SELECT en.function, entry AS a, exit AS z FROM en JOIN ex ON ex.function = en.function WHERE entry <> exit), r AS (SELECT function, a, z, a AS node, [function || ':' || a] AS path, 0::BIGINT AS cost FROM pairs
        UNION ALL SELECT r.function, a, z, dst, list_append(path, r.function || ':' || dst), cost + abs(length(src) - length(dst)) FROM r JOIN t ON t.function = r.function AND node = src WHERE node <> z AND len(path) <= 4 AND NOT list_contains(path, r.function || ':' || dst))
        SELECT function || ':' || a AS start, function || ':' || z AS "end", array_to_string(path, '>') AS path, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY cost, len(path), path) AS rank FROM r WHERE node = z AND len(path) > 1) WHERE rank <= 4""",
    "flow_summaries": f"WITH RECURSIVE {_S}, p AS (SELECT snapshot_id AS function, tool_version AS effect FROM s UNION SELECT src, effect FROM p JOIN e ON function = dst) SELECT * FROM p",
    "flow_slice": f"WITH RECURSIVE {_S}, p AS (SELECT snapshot_id AS node, 0 AS depth FROM s WHERE status = 'aborted' UNION SELECT src, depth + 1 FROM p JOIN e ON node = dst) SELECT node, min(depth) AS depth FROM p GROUP BY 1",
    "flow_taint_paths": f"""WITH RECURSIVE {_S}, p AS (SELECT snapshot_id AS source, snapshot_id AS node, 0 AS depth, snapshot_id::VARCHAR AS path, FALSE AS done FROM s WHERE prev IS NULL UNION ALL SELECT source, dst, depth + 1, path || '>' || dst, s.status = 'aborted' FROM p JOIN e ON node = src JOIN s ON s.snapshot_id = dst
        WHERE NOT done AND NOT (s.tool_version = '0.3.1' AND s.status <> 'aborted')) SELECT source, node AS sink, depth, path, 'present' AS status FROM p WHERE done""",
    "flow_reach_counts": f"WITH RECURSIVE {_S}, r AS (SELECT src AS start, dst AS node, 1 AS depth FROM e WHERE src IN (SELECT snapshot_id FROM s WHERE prev IS NULL) UNION ALL SELECT start, dst, depth + 1 FROM r JOIN e ON node = src) SELECT depth, count(*) AS nodes FROM r GROUP BY 1",
    "inc_digests": "SELECT repo_id, count(*) AS inputs, sum(('0x' || substr(md5(coalesce(relative_path, '') || chr(1) || coalesce(content_hash, '')), 1, 15))::BIGINT)::VARCHAR AS digest FROM (SELECT DISTINCT repo_id, relative_path, content_hash FROM source_files) GROUP BY 1",
    "inc_change_rows": """WITH n AS (SELECT rule_id, max(severity) AS api, any_value(title) AS content FROM report_diagnostics LEFT JOIN rule_catalog USING (rule_id) WHERE rule_id IS NOT NULL GROUP BY 1),
        x AS (SELECT coalesce(c.rule_id, n.rule_id) AS key, CASE WHEN c.rule_id IS NULL THEN 'added' WHEN n.rule_id IS NULL THEN 'removed' WHEN c.default_severity IS DISTINCT FROM n.api THEN 'api' WHEN c.title IS DISTINCT FROM n.content THEN 'content' END AS change FROM rule_catalog c FULL JOIN n ON c.rule_id = n.rule_id)
        SELECT key, change, CASE change WHEN 'content' THEN 'verify' ELSE 'recompute' END AS action FROM x WHERE change IS NOT NULL""",
}
