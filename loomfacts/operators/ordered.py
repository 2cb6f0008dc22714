"""Neighbours in an order within groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, maybe_broadcast


def ordered_neighbours(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds ``prev`` and ``next``: ``value`` of the row before and after it in ``order`` within ``group``.

    A window over the group would read a group with a third of all rows in one task. Here the rows are cut into ranges of
    (group, order), which are of equal size whatever the groups are; the window runs inside each range, and the values at
    the borders of ranges (at most two a range) are put in from the neighbouring ranges. ``order`` should be total;
    at ties any order of the tied rows may be used. Rows with a null group form a group; an empty table stays empty.
    """
    ranged = materialise(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("__p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__p", group).orderBy(*order)
    inside = ranged.withColumn("prev", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w)).withColumn("__first", F.row_number().over(w) == 1).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    rank = F.struct(*order)
    ends = ranged.groupBy(F.col(group).alias("__g"), F.col("__p").alias("__q")).agg(F.min_by(value, rank).alias("lo"), F.max_by(value, rank).alias("hi"))
    # A group lies in several ranges only if it crosses borders, so this has at most two rows a range.
    spans = ends.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("__q", "lo", "hi"))).alias("at")).where(F.size("at") > 1)
    border = spans.select("__g", "at", F.posexplode("at").alias("i", "x")).select(
        "__g", F.col("x.__q").alias("__q"), F.when(F.col("i") > 0, F.get("at", F.col("i") - 1)["hi"]).alias("__before"), F.get("at", F.col("i") + 1)["lo"].alias("__after")
    )
    joined = inside.join(maybe_broadcast(materialise(border, "borders")), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")), "left")
    return joined.withColumn("prev", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("prev"))).withColumn("next", F.when(F.col("__last"), F.col("__after")).otherwise(F.col("next"))).select(*df.columns, "prev", "next")


def ordered_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in ``order`` within ``group``, from 0, as a window over the group would give.

    No group is gathered in one task: rows are cut into ranges of (group, order) of equal size and numbered inside; the
    rows of the same group in earlier ranges are counted and added. Only groups that cross a border need that, so the
    table of offsets has at most two rows a range. Null group values are equal to each other; ties in any order.
    """
    ranged = materialise(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("__p", F.spark_partition_id()), "numbers")
    w = Window.partitionBy("__p", *group).orderBy(*order)
    counts = ranged.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("n"))
    keys = [f"__g{i}" for i in range(len(group))]
    spans = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__q", "n"))).alias("at")).where(F.size("at") > 1)
    at = spans.select(*keys, "at", F.posexplode("at").alias("i", "x"))
    offset = at.select(*keys, F.col("x.__q").alias("__q"), F.aggregate(F.slice("at", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("__before"))
    same = F.col("__p") == F.col("__q")
    for c, k in zip(group, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return ranged.withColumn(name, F.row_number().over(w) - 1).join(maybe_broadcast(offset), same, "left").withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long")).select(*df.columns, name)


def ordered_sums(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before each row in ``order``, 0 for the first.

    Rows are cut into ranges of the order and summed inside; each range begins with what the ranges before it hold, of
    which one number a range comes to the driver.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "sums")
    starts, at = [], 0
    for r in sorted(ranged.groupBy("__p").agg(F.sum(value).alias("s")).collect()):
        starts.append((r["__p"], at))
        at += r["s"] or 0
    offset = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __o long"))  # one row a range
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0))).join(offset, "__p").withColumn(name, F.col(name) + F.col("__o")).drop("__p", "__o")
