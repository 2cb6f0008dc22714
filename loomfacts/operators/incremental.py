"""Change-driven work: digests of inputs, typed change rows, and what they leave to be done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a change of an input asks of what was derived from it.
ACTION_OF = {"content": "verify", "syntax": "recompute", "imports": "recompute", "api": "recompute", "topology": "recompute", "toolchain": "recompute", "rule": "recompute", "extension": "quarantine", "provider": "drop", "unknown": "recompute"}


def input_digests(rows: DataFrame, keys: Sequence[str], identity: str, digest: str) -> DataFrame:
    """inputs and digest of each group of inputs (identity, digest): order-free, so no group is sorted or gathered.

    The digest is the sum of the leading 60 bits of the MD5 sums of all inputs, as a decimal that 10**12 of them cannot
    overflow; an input that stands twice counts twice. A null identity or digest counts as empty.
    """
    text = F.concat(F.coalesce(F.col(identity).cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(F.col(digest).cast("string"), F.lit("")))
    lead = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("inputs"), F.sum(lead).cast("string").alias("digest"))


def change_rows(before: DataFrame, after: DataFrame, key: str, aspects: dict[str, str]) -> DataFrame:
    """key, change and action for each changed input; ``aspects`` names for each kind of change the column that shows it.

    The gravest kind (the last of ``aspects`` that differs) is given; new and gone inputs have the kinds added and removed.
    """
    a = before.select(F.col(key).alias("key"), *[F.col(c).alias(f"a_{k}") for k, c in aspects.items()], F.lit(1).alias("__a"))
    b = after.select(F.col(key).alias("key"), *[F.col(c).alias(f"b_{k}") for k, c in aspects.items()], F.lit(1).alias("__b"))
    x = a.join(b, "key", "full")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
    for k in reversed(list(aspects)):
        kind = kind.when(~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), k)
    action = F.coalesce(*[F.when(F.col("change") == k, F.lit(v)) for k, v in ACTION_OF.items()], F.lit("recompute"))
    return x.select("key", kind.alias("change")).where("change is not null").withColumn("action", action)


def early_cutoff(recomputed: DataFrame, previous: DataFrame) -> DataFrame:
    """Nodes (node, digest) whose new output differs from the previous one; the others need not go on."""
    old = previous.select("node", F.col("digest").alias("old"))
    return recomputed.join(old, "node", "left").where(~F.col("digest").eqNullSafe(F.col("old"))).select("node", "digest")


def dependency_index(reads: DataFrame) -> DataFrame:
    """Both directions of dependencies (node, input) in one table: at, other, direction."""
    x = reads.where("node is not null and input is not null").select("node", "input").distinct()
    return x.select(F.col("node").alias("at"), F.col("input").alias("other"), F.lit("reads").alias("direction")).unionByName(x.select(F.col("input").alias("at"), F.col("node").alias("other"), F.lit("read_by").alias("direction")))
