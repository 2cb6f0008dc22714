"""Queries of the general problems: snapshots, heavy keys, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import merge_sketches, quantiles, sketch
from ..operators.snapshot_diff import snapshot_diff
from ..operators.tree_aggregate import heavy_keys, per_key_results
from ..session import materialise, maybe_broadcast, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(table(spark, sf_dir, "report_diagnostics"), table(spark, sf_dir, "report_snapshots"), ["rule_id", "file", "severity", "message", "text_range"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "report_diagnostics"), ["rule_id", "file"]).select("key_kind", "key_value")


def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key_results(table(spark, sf_dir, "report_diagnostics"), ["rule_id", "file"]).withColumnsRenamed({"group_count": "series_count", "latest": "latest_ingest"})


MEASURES = ("cold_wall_clock_ms", "warm_wall_clock_ms", "peak_rss_bytes")
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was delivered twice counts once."""
    return table(spark, sf_dir, "scale_runs").select("run_id", "suite_id", F.to_date("measured_at").alias("day"), *MEASURES).dropDuplicates(["run_id"]).drop("run_id")


def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each suite, day of measured_at and cost."""
    return sketch(_runs(spark, sf_dir), ["suite_id", "day"], MEASURES, chunks=int(spark.conf.get("spark.sql.shuffle.partitions")))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day, and (with a null day) of all days, combined from the states of the days."""
    days = materialise(daily_states(spark, sf_dir), "days")
    each = quantiles(days, ["suite_id", "day", "measure"], PROBABILITIES)
    whole = quantiles(merge_sketches(days, ["suite_id", "measure"]), ["suite_id", "measure"], PROBABILITIES)
    return each.unionByName(whole.withColumn("day", F.lit(None).cast("date")))


def p5_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(merge_sketches(daily_states(spark, sf_dir), ["suite_id", "measure"]), ["suite_id", "measure"], PROBABILITIES)


def p5_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true ranks of each quantile of all days reach the asked rank within rank_error, counted over all runs."""
    found = materialise(p5_all_days(spark, sf_dir), "quantiles")
    each = _runs(spark, sf_dir).select("suite_id", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select("suite_id", "x.measure", "x.v").where("v is not null")
    asked = found.groupBy("suite_id", "measure").agg(F.collect_list(F.struct("probability", "quantile", "rank_error")).alias("q"))
    at = each.groupBy("suite_id", "measure", "v").agg(F.count(F.lit(1)).alias("k")).join(maybe_broadcast(asked), ["suite_id", "measure"])
    at = at.select("suite_id", "measure", "v", "k", F.explode("q").alias("q")).select("suite_id", "measure", "v", "k", "q.*")
    k = F.col("k")
    ranks = at.groupBy("suite_id", "measure", "probability").agg(F.sum(k).alias("n"), F.sum(F.when(F.col("v") < F.col("quantile"), k).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("quantile"), k).otherwise(0)).alias("upto"), F.max("rank_error").alias("e"))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("probability") * F.col("n"), 9)))
    return ranks.select("suite_id", "measure", "probability", "n", ((F.col("below") + 1 - F.col("e") <= rank) & (rank <= F.col("upto") + F.col("e"))).alias("within_bound"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_per_key": p4_per_key, "p5_percentiles": p5_percentiles, "p5_all_days": p5_all_days, "p5_rank_check": p5_rank_check}

# Percentiles as exact order statistics. The states give the same, with a rank error of 0, while a group has fewer values
# than a buffer, as all have at the scale of the correctness check; p5_rank_check checks the stated bound at any scale.
_RUNS = "r AS (SELECT suite_id, day, unnest([{'m': 'cold_wall_clock_ms', 'v': cold_wall_clock_ms}, {'m': 'warm_wall_clock_ms', 'v': warm_wall_clock_ms}, {'m': 'peak_rss_bytes', 'v': peak_rss_bytes}], recursive := true) FROM (SELECT DISTINCT run_id, suite_id, measured_at::DATE AS day, cold_wall_clock_ms, warm_wall_clock_ms, peak_rss_bytes FROM scale_runs))"


def _exact(day: str, keys: str) -> str:
    return f"""SELECT suite_id, {day} m AS measure, n, p AS probability, v AS quantile, 0::BIGINT AS rank_error FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM r WHERE v IS NOT NULL) x
        CROSS JOIN (SELECT unnest([{", ".join(map(str, PROBABILITIES))}])::DOUBLE AS p) WHERE k = greatest(1, ceil(round(p * n, 9)))"""


SQL = {
    "p5_percentiles": f"WITH {_RUNS} {_exact('day,', 'suite_id, day, m')} UNION ALL BY NAME {_exact('NULL::DATE AS day,', 'suite_id, m')}",
    "p5_all_days": f"WITH {_RUNS} {_exact('', 'suite_id, m')}",
    "p5_rank_check": f"WITH {_RUNS} SELECT suite_id, m AS measure, p AS probability, count(*) AS n, TRUE AS within_bound FROM r CROSS JOIN (SELECT unnest([{', '.join(map(str, PROBABILITIES))}])::DOUBLE AS p) WHERE v IS NOT NULL GROUP BY 1, 2, 3",
    "p3_found": """
        WITH s AS (SELECT DISTINCT series_id, snapshot_id, taken_at FROM report_snapshots WHERE status = 'complete'),
        p AS (SELECT series_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY series_id ORDER BY taken_at) AS prev_snapshot_id FROM s),
        r AS (SELECT * FROM (SELECT series_id, snapshot_id, stable_fingerprint, rule_id, file, severity, message, text_range,
                row_number() OVER (PARTITION BY series_id, snapshot_id, stable_fingerprint ORDER BY ingested_at DESC NULLS LAST) AS k
              FROM report_diagnostics WHERE stable_fingerprint IS NOT NULL) WHERE k = 1),
        c AS (SELECT p.prev_snapshot_id, r.* FROM p JOIN r USING (series_id, snapshot_id) WHERE p.prev_snapshot_id IS NOT NULL),
        b AS (SELECT p.prev_snapshot_id, p.snapshot_id AS later, r.* FROM p JOIN r ON r.series_id = p.series_id AND r.snapshot_id = p.prev_snapshot_id)
        SELECT coalesce(c.series_id, b.series_id) AS series_id, coalesce(c.prev_snapshot_id, b.prev_snapshot_id) AS prev_snapshot_id,
               coalesce(c.snapshot_id, b.later) AS snapshot_id, coalesce(c.stable_fingerprint, b.stable_fingerprint) AS stable_fingerprint,
               CASE WHEN b.series_id IS NULL THEN 'added' WHEN c.series_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM c FULL JOIN b ON c.series_id = b.series_id AND c.snapshot_id = b.later AND c.stable_fingerprint = b.stable_fingerprint
        WHERE b.series_id IS NULL OR c.series_id IS NULL OR c.rule_id IS DISTINCT FROM b.rule_id OR c.file IS DISTINCT FROM b.file
           OR c.severity IS DISTINCT FROM b.severity OR c.message IS DISTINCT FROM b.message OR c.text_range IS DISTINCT FROM b.text_range""",
    "p4_found": """
        WITH k AS (SELECT 'rule_id' AS key_kind, rule_id AS key_value FROM report_diagnostics UNION ALL SELECT 'file', file FROM report_diagnostics)
        SELECT key_kind, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM report_diagnostics)""",
    "p4_per_key": """
        WITH k AS (SELECT 'rule_id' AS key_kind, rule_id AS key_value, series_id, ingested_at FROM report_diagnostics
                   UNION ALL SELECT 'file', file, series_id, ingested_at FROM report_diagnostics)
        SELECT key_kind, key_value, count(*) AS row_count, count(DISTINCT series_id) AS series_count, max(ingested_at) AS latest_ingest FROM k GROUP BY 1, 2""",
}
