"""Queries over diagnostics, snapshots and runs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_annotation
from ..operators import evaluation as E
from ..operators import report as R
from ..session import maybe_broadcast, table

Query = Callable[[SparkSession, str], DataFrame]
#: Deliveries before and after this time are the two sides of comparisons.
CUT = "2025-02-15"


def _d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_diagnostics")


def _on(fact: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fact(_d(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _d(spark, sf_dir).where("stable_fingerprint is not null")
    return d.where(F.col("ingested_at") < CUT), d.where(F.col("ingested_at") >= CUT)


def _dedupe(d: DataFrame) -> DataFrame:
    return R.dedupe(d, ["series_id", "stable_fingerprint"]).select("series_id", "stable_fingerprint", "file", F.col("text_range.start_line").alias("line"), "rule_id", "message")


def _occurrences(d: DataFrame) -> DataFrame:
    return R.occurrences(d, ["snapshot_id", "ingested_at", "message"]).select("rule_id", "file", "stable_fingerprint", "occurrence", F.col("text_range.start_line").alias("line"), "snapshot_id")


def _baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _sides(spark, sf_dir)
    return R.baseline_status(now, before, ["series_id", "stable_fingerprint"])


def _baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("identities"), F.sum("now").alias("rows_now"), F.sum("before").alias("rows_before"))


def _match_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["series_id", "rule_id", "file", "stable_fingerprint", "message", "snapshot_id"]
    before, now = (x.where("rule_id is not null and file is not null").select(*columns).distinct() for x in _sides(spark, sf_dir))
    return R.match_baseline(now, before, ["series_id", "rule_id", "file", "stable_fingerprint"], ["series_id", "rule_id", "message"], ["snapshot_id", "message"]).select("series_id", "stable_fingerprint", "snapshot_id", "phase")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _d(spark, sf_dir).where("rule_id = 'core/missing-guard' and file is not null")
    return d.select(F.col("file").alias("path"), F.col("text_range.start_line").alias("lo"), F.col("text_range.end_line").alias("hi")).distinct()


def _change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = R.change_gate(_d(spark, sf_dir), _changes(spark, sf_dir))
    return hit.groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("diagnostics"))


def _change_gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.change_gate(_d(spark, sf_dir), _changes(spark, sf_dir), whole_file=True).groupBy("file").agg(F.count(F.lit(1)).alias("diagnostics"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _d(spark, sf_dir)
    parts = [(d, "rule_id", "rule_catalog"), (d, "snapshot_id", "report_snapshots"), (d, "repo_id", "repositories"), (table(spark, sf_dir, "report_snapshots").distinct(), "snapshot_id", "report_diagnostics"), (table(spark, sf_dir, "documents"), "source", "mix_targets"), (table(spark, sf_dir, "mix_targets"), "source", "documents")]
    out = [R.referential_gaps(child, table(spark, sf_dir, t), k).select(F.concat(F.lit(k), F.lit(">"), F.lit(t)).alias("reference"), F.col(k).cast("string").alias("key_value"), "rows") for child, k, t in parts]
    return reduce(DataFrame.unionByName, out)


def _top_k(d: DataFrame) -> DataFrame:
    x = d.where("file is not null").select("file", F.col("text_range.start_line").alias("line"), "message").distinct()
    return R.top_k(x, "file", [F.col("line"), F.col("message")], 3)


def _severity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = maybe_broadcast(table(spark, sf_dir, "rule_catalog").select("rule_id", "default_severity"))
    return _d(spark, sf_dir).join(rules, "rule_id").where("severity <> default_severity").groupBy("rule_id", "default_severity", "severity").agg(F.count(F.lit(1)).alias("diagnostics"))


def _run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = (x.groupBy("series_id", "stable_fingerprint").agg(F.max_by("severity", F.struct("ingested_at", "severity")).alias("severity")) for x in _sides(spark, sf_dir))
    return E.run_delta(before, now, ["series_id", "stable_fingerprint"], "severity")


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = maybe_broadcast(table(spark, sf_dir, "rule_catalog").select("rule_id", "default_severity", "capability"))
    x = _d(spark, sf_dir).join(rules, "rule_id")
    said, true = F.col("severity") == "error", F.col("default_severity") == "error"
    return E.confusion(x.withColumn("outcome", F.when(said & true, "tp").when(said, "fp").when(true, "fn").otherwise("tn")), ["capability"])


def _match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _sides(spark, sf_dir)
    return E.match_outcomes(before, now, ["series_id", "stable_fingerprint"]).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scale_runs").dropDuplicates(["run_id"])


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.gate(F.col("cold_wall_clock_ms"), 5000, 20000)
    return _runs(spark, sf_dir).groupBy("suite_id", g.alias("gate")).agg(F.count(F.lit(1)).alias("runs"))


def _budget_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.budget_gate(F.col("cold_wall_clock_ms"), F.col("warm_wall_clock_ms"), 1.2, 500)
    return _runs(spark, sf_dir).groupBy("suite_id", g.alias("gate")).agg(F.count(F.lit(1)).alias("runs"))


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.coalesce(F.col("failure_detail"), F.lit(""))
    category = F.when(F.col("status") == "ok", "none").when(F.col("status") == "skipped_after_failure", "setup_missing").when(F.col("status") == "oom", "budget_exceeded").when(F.contains(F.lower(detail), F.lit("unsupported")), "unsupported").otherwise("missing_fact")
    return _runs(spark, sf_dir).groupBy("status", category.alias("category")).agg(F.count(F.lit(1)).alias("runs"), F.count("failure_detail").alias("with_detail"))


def _annotations(d: DataFrame) -> DataFrame:
    text = F.concat(F.lit("::"), F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("notice"), F.lit(" file="), "file", F.lit(",line="), F.col("text_range.start_line").cast("string"), F.lit("::"), escape_annotation(F.col("message")))
    return d.where("file is not null and message is not null").groupBy(text.alias("annotation")).agg(F.count(F.lit(1)).alias("copies"))


def _json_rows(d: DataFrame) -> DataFrame:
    line = F.to_json(F.struct(F.coalesce("rule_id", F.lit("-")).alias("rule"), F.col("severity"), F.coalesce("file", F.lit("-")).alias("file"), F.col("text_range.start_line").alias("line")))
    return d.groupBy(line.alias("record")).agg(F.count(F.lit(1)).alias("copies"))


def _snapshot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose declared number of diagnostics is not the number of their distinct fingerprints."""
    have = _d(spark, sf_dir).groupBy("snapshot_id").agg(F.count_distinct("stable_fingerprint").alias("found"))
    s = table(spark, sf_dir, "report_snapshots").dropDuplicates(["snapshot_id"]).where("declared_diagnostics is not null")
    return s.join(have, "snapshot_id", "left").select("snapshot_id", "status", "declared_diagnostics", F.coalesce("found", F.lit(0)).alias("found")).where("declared_diagnostics <> found")


QUERIES: dict[str, Query] = {
    "rep_check_stats": _on(lambda d: R.check_stats(d, ["severity", "repo_id", "rule_id"])),
    "rep_rule_summary": _on(R.rule_summary),
    "rep_example_per_rule": _on(R.example_per_rule),
    "rep_identity_groups": _on(lambda d: R.identity_groups(d, ["repo_id", "stable_fingerprint"])),
    "rep_worst_per_file": _on(lambda d: R.worst_of(d, ["file"])),
    "rep_dedupe": _on(_dedupe),
    "rep_occurrences": _on(_occurrences),
    "rep_filter_selector": _on(lambda d: R.filter_report(d, "core/*").groupBy("rule_id").agg(F.count(F.lit(1)).alias("diagnostics"))),
    "rep_scope": _on(lambda d: R.scope_filter(d, ["**/*.go", "web/**"], ["**/*_test.go"]).groupBy("file").agg(F.count(F.lit(1)).alias("diagnostics"))),
    "rep_baseline_status": _baseline_status,
    "rep_baseline_counts": _baseline_counts,
    "rep_match_baseline": _match_baseline,
    "rep_merge_ranges": lambda s, p: R.merge_ranges(_changes(s, p)),
    "rep_change_gate": _change_gate,
    "rep_change_gate_files": _change_gate_files,
    "rep_exit_status": _on(R.exit_status),
    "rep_referential_gaps": _gaps,
    "rep_invalid_spans": _on(lambda d: R.invalid_spans(d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("diagnostics"))),
    "rep_top_k": _on(_top_k),
    "rep_evidence_labels": _on(lambda d: d.select(F.explode("evidence").alias("e")).groupBy("e.label").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("e.value").alias("values"))),
    "rep_severity_drift": _severity_drift,
    "rep_run_delta": _run_delta,
    "rep_confusion": _confusion,
    "rep_match_outcomes": _match_outcomes,
    "rep_gates": _gates,
    "rep_budget_gates": _budget_gates,
    "rep_unknown_taxonomy": _taxonomy,
    "rep_annotations": _on(_annotations),
    "rep_json_rows": _on(_json_rows),
    "rep_snapshot_gaps": _snapshot_gaps,
}

_CORE = "CASE WHEN rule_id LIKE 'core/%' THEN 0 ELSE 1 END"
_BOTH = f"b AS (SELECT * FROM report_diagnostics WHERE stable_fingerprint IS NOT NULL AND ingested_at < '{CUT}'), n AS (SELECT * FROM report_diagnostics WHERE stable_fingerprint IS NOT NULL AND ingested_at >= '{CUT}')"
_STATUS = """s AS (SELECT coalesce(x.series_id, y.series_id) AS series_id, coalesce(x.fp, y.fp) AS stable_fingerprint, coalesce(k, 0) AS now, coalesce(m, 0) AS before, CASE WHEN m IS NULL THEN 'new' WHEN k IS NULL THEN 'fixed' ELSE 'existing' END AS status
FROM (SELECT series_id, stable_fingerprint AS fp, count(*) AS k FROM n GROUP BY 1, 2) x FULL JOIN (SELECT series_id, stable_fingerprint AS fp, count(*) AS m FROM b GROUP BY 1, 2) y ON x.series_id = y.series_id AND x.fp = y.fp)"""
_CHANGES = "c AS (SELECT DISTINCT file AS path, text_range.start_line AS lo, text_range.end_line AS hi FROM report_diagnostics WHERE rule_id = 'core/missing-guard' AND file IS NOT NULL)"
_RUNS = "r AS (SELECT DISTINCT * FROM scale_runs)"
_IDS = "series_id, rule_id, file, stable_fingerprint"

SQL = {
    "rep_check_stats": """SELECT 'severity' AS dimension, severity AS value, count(*) AS diagnostics FROM report_diagnostics GROUP BY 2 UNION ALL SELECT 'repo_id', repo_id, count(*) FROM report_diagnostics GROUP BY 2
        UNION ALL SELECT 'rule_id', rule_id, count(*) FROM report_diagnostics GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM report_diagnostics""",
    "rep_rule_summary": """SELECT rule_id, count(*) AS total, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'warn') AS warns, count(*) FILTER (severity = 'error') AS errors,
        max(CASE severity WHEN 'info' THEN 0 WHEN 'warn' THEN 1 WHEN 'error' THEN 2 END) AS gravest, count(DISTINCT file) AS files FROM report_diagnostics GROUP BY 1""",
    "rep_example_per_rule": """SELECT rule_id, file, line, message FROM (SELECT rule_id, file, text_range.start_line AS line, message, row_number() OVER (PARTITION BY rule_id ORDER BY file, text_range.start_line, text_range.start_col, message) AS k
        FROM report_diagnostics WHERE file IS NOT NULL) WHERE k = 1""",
    "rep_identity_groups": "SELECT repo_id, stable_fingerprint, count(*) AS multiplicity, min(message) AS message FROM report_diagnostics GROUP BY 1, 2",
    "rep_worst_per_file": "SELECT file, arg_max(severity, CASE severity WHEN 'info' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS severity, count(*) AS diagnostics FROM report_diagnostics GROUP BY 1",
    "rep_dedupe": f"""SELECT series_id, stable_fingerprint, file, text_range.start_line AS line, rule_id, message FROM (SELECT *, row_number() OVER (PARTITION BY series_id, stable_fingerprint
        ORDER BY file NULLS FIRST, text_range.start_line, text_range.start_col, {_CORE}, rule_id NULLS FIRST, message NULLS FIRST) AS k FROM report_diagnostics WHERE stable_fingerprint IS NOT NULL) WHERE k = 1
        UNION ALL SELECT series_id, stable_fingerprint, file, text_range.start_line, rule_id, message FROM report_diagnostics WHERE stable_fingerprint IS NULL""",
    "rep_occurrences": """SELECT rule_id, file, stable_fingerprint, row_number() OVER (PARTITION BY rule_id, file, stable_fingerprint ORDER BY text_range.start_line, text_range.start_col, text_range.end_line, text_range.end_col, snapshot_id, ingested_at, message) - 1 AS occurrence,
        text_range.start_line AS line, snapshot_id FROM report_diagnostics""",
    "rep_filter_selector": "SELECT rule_id, count(*) AS diagnostics FROM report_diagnostics WHERE rule_id LIKE 'core/%' OR rule_id LIKE 'parser/%' OR len(list_filter(evidence, lambda e: e.label = 'capability')) > 0 GROUP BY 1",
    "rep_scope": "SELECT file, count(*) AS diagnostics FROM report_diagnostics WHERE (file LIKE '%.go' OR file LIKE 'web/%') AND file NOT LIKE '%\\_test.go' ESCAPE '\\' GROUP BY 1",
    "rep_baseline_status": f"WITH {_BOTH}, {_STATUS} SELECT * FROM s",
    "rep_baseline_counts": f"WITH {_BOTH}, {_STATUS} SELECT status, count(*) AS identities, sum(now)::BIGINT AS rows_now, sum(before)::BIGINT AS rows_before FROM s GROUP BY 1",
    "rep_match_baseline": f"""WITH {_BOTH}, x AS (SELECT *, row_number() OVER (PARTITION BY {_IDS} ORDER BY snapshot_id, message) AS k FROM (SELECT DISTINCT {_IDS}, message, snapshot_id FROM n WHERE rule_id IS NOT NULL AND file IS NOT NULL)),
        y AS (SELECT *, row_number() OVER (PARTITION BY {_IDS} ORDER BY snapshot_id, message) AS k FROM (SELECT DISTINCT {_IDS}, message, snapshot_id FROM b WHERE rule_id IS NOT NULL AND file IS NOT NULL)),
        rest AS (SELECT * FROM x ANTI JOIN y USING ({_IDS}, k)), lefto AS (SELECT * FROM y ANTI JOIN x USING ({_IDS}, k)),
        once AS (SELECT series_id, rule_id, message FROM rest GROUP BY ALL HAVING count(*) = 1 INTERSECT SELECT series_id, rule_id, message FROM lefto GROUP BY ALL HAVING count(*) = 1)
        SELECT series_id, stable_fingerprint, snapshot_id, 'exact' AS phase FROM x SEMI JOIN y USING ({_IDS}, k)
        UNION ALL SELECT rest.series_id, stable_fingerprint, snapshot_id, CASE WHEN once.series_id IS NOT NULL THEN 'relocated' END FROM rest LEFT JOIN once ON rest.series_id = once.series_id AND rest.rule_id = once.rule_id AND rest.message = once.message""",
    "rep_merge_ranges": f"""WITH {_CHANGES}, w AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS f FROM c WHERE lo <= hi),
        g AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM w) SELECT path, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY path, k""",
    "rep_change_gate": f"""WITH {_CHANGES} SELECT rule_id, file, count(*) AS diagnostics FROM report_diagnostics d WHERE EXISTS (SELECT 1 FROM c WHERE c.path = d.file AND d.text_range.start_line <= c.hi AND c.lo <= greatest(d.text_range.start_line, d.text_range.end_line) AND c.lo <= c.hi) GROUP BY 1, 2""",
    "rep_change_gate_files": f"WITH {_CHANGES} SELECT file, count(*) AS diagnostics FROM report_diagnostics WHERE file IN (SELECT path FROM c) GROUP BY 1",
    "rep_exit_status": "SELECT count(*) AS diagnostics, coalesce(max((severity = 'error')::INT), 0) AS exit_code FROM report_diagnostics",
    "rep_referential_gaps": """SELECT 'rule_id>rule_catalog' AS reference, rule_id AS key_value, count(*) AS rows FROM report_diagnostics WHERE rule_id NOT IN (SELECT rule_id FROM rule_catalog) GROUP BY 2
        UNION ALL SELECT 'snapshot_id>report_snapshots', snapshot_id::VARCHAR, count(*) FROM report_diagnostics WHERE snapshot_id NOT IN (SELECT snapshot_id FROM report_snapshots) GROUP BY 2
        UNION ALL SELECT 'repo_id>repositories', repo_id, count(*) FROM report_diagnostics WHERE repo_id NOT IN (SELECT repo_id FROM repositories) GROUP BY 2
        UNION ALL SELECT 'snapshot_id>report_diagnostics', snapshot_id::VARCHAR, 1 FROM (SELECT DISTINCT snapshot_id FROM report_snapshots) WHERE snapshot_id NOT IN (SELECT snapshot_id FROM report_diagnostics)
        UNION ALL SELECT 'source>mix_targets', source, count(*) FROM documents WHERE source NOT IN (SELECT source FROM mix_targets) GROUP BY 2
        UNION ALL SELECT 'source>documents', source, count(*) FROM mix_targets WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY 2""",
    "rep_invalid_spans": """SELECT rule_id, count(*) AS diagnostics FROM report_diagnostics WHERE text_range IS NULL OR text_range.end_line < text_range.start_line OR (text_range.end_line = text_range.start_line AND text_range.end_col < text_range.start_col)
        OR text_range.start_line < 1 OR text_range.start_col < 1 GROUP BY 1""",
    "rep_top_k": """SELECT file, line, message, rank, rank = 3 AND n > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, message) AS rank, count(*) OVER (PARTITION BY file) AS n
        FROM (SELECT DISTINCT file, text_range.start_line AS line, message FROM report_diagnostics WHERE file IS NOT NULL)) WHERE rank <= 3""",
    "rep_evidence_labels": "SELECT e.label AS label, count(*) AS rows, count(DISTINCT e.value) AS values FROM (SELECT unnest(evidence) AS e FROM report_diagnostics) GROUP BY 1",
    "rep_severity_drift": "SELECT rule_id, default_severity, severity, count(*) AS diagnostics FROM report_diagnostics JOIN rule_catalog USING (rule_id) WHERE severity <> default_severity GROUP BY 1, 2, 3",
    "rep_run_delta": f"""WITH {_BOTH}, x AS (SELECT series_id, stable_fingerprint, arg_max(severity, struct_pack(a := ingested_at, s := severity)) AS v FROM b GROUP BY 1, 2), y AS (SELECT series_id, stable_fingerprint, arg_max(severity, struct_pack(a := ingested_at, s := severity)) AS v FROM n GROUP BY 1, 2)
        SELECT x.v AS from_value, y.v AS to_value, count(*) AS cases FROM x FULL JOIN y ON x.series_id = y.series_id AND x.stable_fingerprint = y.stable_fingerprint GROUP BY 1, 2""",
    "rep_confusion": """WITH o AS (SELECT capability, count(*) FILTER (severity = 'error' AND default_severity = 'error') AS tp, count(*) FILTER (severity = 'error' AND default_severity <> 'error') AS fp,
        count(*) FILTER (severity <> 'error' AND default_severity = 'error') AS fn, count(*) FILTER (severity <> 'error' AND default_severity <> 'error') AS tn FROM report_diagnostics JOIN rule_catalog USING (rule_id) GROUP BY 1),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM o)
        SELECT capability, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN 4 * p + r <> 0 THEN 5 * p * r / (4 * p + r) END, 6) AS f2,
        round(CASE WHEN 0.25 * p + r <> 0 THEN 1.25 * p * r / (0.25 * p + r) END, 6) AS f05, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr FROM q""",
    "rep_match_outcomes": f"""WITH {_BOTH}, z AS (SELECT coalesce(p.m, 0) AS e, coalesce(q.m, 0) AS o FROM (SELECT series_id, stable_fingerprint, count(*) AS m FROM b GROUP BY 1, 2) p FULL JOIN (SELECT series_id, stable_fingerprint, count(*) AS m FROM n GROUP BY 1, 2) q
        ON p.series_id = q.series_id AND p.stable_fingerprint = q.stable_fingerprint) SELECT sum(least(e, o))::BIGINT AS tp, sum(greatest(e - o, 0))::BIGINT AS fn, sum(greatest(o - e, 0))::BIGINT AS fp FROM z""",
    "rep_gates": f"WITH {_RUNS} SELECT suite_id, CASE WHEN cold_wall_clock_ms IS NULL THEN 'unknown' WHEN cold_wall_clock_ms > 20000 THEN 'fail' WHEN cold_wall_clock_ms > 5000 THEN 'warn' ELSE 'pass' END AS gate, count(*) AS runs FROM r GROUP BY 1, 2",
    "rep_budget_gates": f"""WITH {_RUNS} SELECT suite_id, CASE WHEN cold_wall_clock_ms IS NULL OR warm_wall_clock_ms IS NULL THEN 'unknown' WHEN cold_wall_clock_ms > warm_wall_clock_ms * 1.2::DOUBLE AND cold_wall_clock_ms > warm_wall_clock_ms + 500 THEN 'fail' ELSE 'pass' END AS gate,
        count(*) AS runs FROM r GROUP BY 1, 2""",
    "rep_unknown_taxonomy": f"""WITH {_RUNS} SELECT status, CASE WHEN status = 'ok' THEN 'none' WHEN status = 'skipped_after_failure' THEN 'setup_missing' WHEN status = 'oom' THEN 'budget_exceeded' WHEN contains(lower(coalesce(failure_detail, '')), 'unsupported') THEN 'unsupported'
        ELSE 'missing_fact' END AS category, count(*) AS runs, count(failure_detail) AS with_detail FROM r GROUP BY 1, 2""",
    "rep_annotations": """SELECT '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || text_range.start_line || '::' ||
        replace(replace(replace(message, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS annotation, count(*) AS copies FROM report_diagnostics WHERE file IS NOT NULL AND message IS NOT NULL GROUP BY 1""",
    "rep_json_rows": """SELECT to_json(struct_pack(rule := coalesce(rule_id, '-'), severity := severity, file := coalesce(file, '-'), line := text_range.start_line))::VARCHAR AS record, count(*) AS copies FROM report_diagnostics GROUP BY 1""",
    "rep_snapshot_gaps": """SELECT snapshot_id, status, declared_diagnostics, found FROM (SELECT s.snapshot_id, status, declared_diagnostics, coalesce(f, 0) AS found FROM (SELECT DISTINCT snapshot_id, status, declared_diagnostics FROM report_snapshots) s
        LEFT JOIN (SELECT snapshot_id, count(DISTINCT stable_fingerprint) AS f FROM report_diagnostics GROUP BY 1) d USING (snapshot_id) WHERE declared_diagnostics IS NOT NULL) WHERE declared_diagnostics <> found""",
}
