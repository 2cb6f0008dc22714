"""Evaluation of observed against expected facts: outcomes, ratios, deltas between runs and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    """Null where the denominator is 0."""
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def confusion(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn of outcome labels for each group, with precision, recall, F1, F2, F0.5 and false-positive rate."""
    counts = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), *[F.round(f_beta(p, r, b), 6).alias(n) for n, b in (("f1", 1.0), ("f2", 2.0), ("f05", 0.5))], F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"))


def match_outcomes(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key its matches one to one: tp pairs, fn expected rows and fp observed rows left over.

    Only counts meet, so a key with very many rows is one row a task.
    """
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(observed.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("o")))
    n = both.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    return n.select(*keys, F.least("e", "o").alias("tp"), F.greatest(F.col("e") - F.col("o"), F.lit(0)).alias("fn"), F.greatest(F.col("o") - F.col("e"), F.lit(0)).alias("fp"))


def run_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How values changed between two runs: from, to and the number of keys; missing keys have a null side."""
    a, b = before.select(*keys, F.col(value).alias("from_value")), after.select(*keys, F.col(value).alias("to_value"))
    return a.join(b, list(keys), "full").groupBy("from_value", "to_value").agg(F.count(F.lit(1)).alias("cases"))


def gate(measured: Column, warn: float, fail: float) -> Column:
    return F.when(measured.isNull(), "unknown").when(measured > fail, "fail").when(measured > warn, "warn").otherwise("pass")


def budget_gate(measured: Column, baseline: Column, most: float, floor: float) -> Column:
    """fail if the measure exceeds the baseline by the factor and by the absolute floor."""
    return F.when(measured.isNull() | baseline.isNull(), "unknown").when((measured > baseline * most) & (measured > baseline + floor), "fail").otherwise("pass")


def is_subsequence(expected: Column, observed: Column) -> Column:
    """Whether the elements of ``expected`` occur in ``observed`` in their order."""
    at = F.aggregate(observed, F.lit(0), lambda i, x: F.when((i < F.size(expected)) & (x == F.get(expected, i)), i + 1).otherwise(i))
    return at == F.size(expected)
