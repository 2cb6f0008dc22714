"""What changed between consecutive full snapshots, by comparing Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .ordered import ordered_neighbours

#: A series with more than 1 / HOT_SHARES of all rows is cut into hash ranges; fewer than HOT_SHARES series can be that large.
HOT_SHARES = 256
#: log2 of the number of hash ranges of a hot series.
HOT_BITS = 6
#: log2 of the children of a node below a hash range.
FAN_BITS = 4


def _leaves(name: str, kind: T.DataType) -> list[Column]:
    """The atomic parts of a column; arrays and maps as their JSON."""
    if isinstance(kind, T.StructType):
        return [F.col(name).isNull(), *[x for f in kind for x in _leaves(f"{name}.{f.name}", f.dataType)]]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return [F.to_json(F.col(name))]
    return [F.col(name)]


def content_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64-bit hash of ``columns`` in which a null differs from every value and from nulls in other columns."""
    parts = [x for c in columns for x in _leaves(f"`{c}`", df.schema[c].dataType)]
    mask = F.concat(*[F.when(x.isNull(), F.lit("0")).otherwise(F.lit("1")) for x in parts])
    return F.xxhash64(mask, *parts)


def hash_place(key: Column) -> Column:
    """Place of a key in the hash space; its top bits name the hash range, the next ones the leaf."""
    return F.xxhash64(key, F.lit(7))


def _bits(place: Column, skip: int, take: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(place, skip), 64 - take) if take else F.lit(0).cast("long")


def snapshot_diff(
    rows: DataFrame,
    snapshots: DataFrame,
    content: Sequence[str],
    series: str = "series_id",
    snapshot: str = "snapshot_id",
    key: str = "stable_fingerprint",
    version: str = "ingested_at",
    order: str = "taken_at",
    status: str = "status",
    complete: str = "complete",
    leaf_rows: int = 8,
) -> DataFrame:
    """Rows (series, prev_<snapshot>, snapshot, key, change) between consecutive complete snapshots of each series.

    Of a key's rows in a snapshot the one with the greatest ``version`` holds (null lowest; at a tie of different
    contents the one with the greater content hash). ``change`` is added, removed or changed; a change is any difference
    in ``content``, null being equal to null. Rows with a null key, series or snapshot are left out, repeated rows count
    once; the first complete snapshot of a series gives nothing. Empty tables give no rows. Extra columns are ignored.

    Each snapshot has a tree of digests: leaves are hash ranges of keys, so many that an average snapshot has
    ``leaf_rows`` rows in each, above them nodes of 2**FAN_BITS children up to one root (in a hot series one for each of
    its 2**HOT_BITS hash ranges). A digest is the exclusive or of two 64-bit hashes of the rows below it, which are distinct,
    so it cannot overflow whatever the number of rows; the tree of a pair of snapshots holds the exclusive or of both, zero
    where the two agree, beside the difference of the numbers of rows. The tree is looked at from the top down; rows are
    compared only in leaves that differ.

    Rows are shuffled once, by (series, hash range), and everything after that works on this partitioning.
    """
    spark = rows.sparkSession
    # Lets joins on (s, salt, ...) use the partitioning by (s, salt) on both sides.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    base = rows.where(F.col(key).isNotNull() & F.col(series).isNotNull() & F.col(snapshot).isNotNull())
    snaps = snapshots.where(F.col(status) == complete).select(F.col(series).alias("s"), F.col(snapshot).alias("snap"), F.col(order).alias("o")).where("s is not null and snap is not null").dropDuplicates(["s", "snap"])
    steps = ordered_neighbours(snaps, "s", ["o", "snap"], "snap").where("prev is not null or next is not null").select("s", "snap", "prev", "next")

    # One narrow pass over the rows; the counts of the series are read twice from where they are written.
    per_series = materialise(base.groupBy(F.col(series).alias("s")).agg(F.count(F.lit(1)).alias("n")), "series")
    total = per_series.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in per_series.where(F.col("n") > max(total / HOT_SHARES, 1000)).select("s").collect()]
    average = total / max(1, snaps.count())
    leaf_bits = min(20, max(0, math.ceil(math.log2(max(1.0, average / leaf_rows)))))

    cut = ["s", "salt"] if hot else ["s"]  # a constant column would be folded away, and the partitioning with it
    placed = base.select(F.col(series).alias("s"), F.col(snapshot).alias("snap"), F.col(key).alias("k"), F.col(version).alias("v"), content_hash(rows, content).alias("c"))
    pairs_at = steps
    if hot:
        placed = placed.withColumn("salt", F.when(F.col("s").isin(hot), _bits(hash_place(F.col("k")), 0, HOT_BITS)).otherwise(F.lit(0)).cast("int"))
        pairs_at = steps.withColumn("salt", F.explode(F.when(F.col("s").isin(hot), F.sequence(F.lit(0), F.lit((1 << HOT_BITS) - 1))).otherwise(F.array(F.lit(0)))))
    placed, pairs_at = placed.repartition(*cut), pairs_at.repartition(*cut)
    held = placed.groupBy(*cut, "snap", "k").agg(F.max_by("c", F.struct("v", "c")).alias("c")).withColumn("leaf", _bits(hash_place(F.col("k")), HOT_BITS, leaf_bits).cast("int") if leaf_bits else F.shiftright(F.hash("k"), 31) * 0)
    digests = [F.bit_xor(F.xxhash64("k", "c", F.lit(i))).alias(f"d{i}") for i in (1, 2)]
    leaves = held.groupBy(*cut, "snap", "leaf").agg(*digests, F.count(F.lit(1)).alias("n"))

    # A snapshot is the later one of the pair named by itself, and the earlier one of the pair named by its successor.
    roles = F.explode(F.array(F.struct(F.when(F.col("prev").isNotNull(), F.col("snap")).alias("pair"), F.col("prev").alias("before"), F.lit(1).alias("sign")), F.struct(F.col("next").alias("pair"), F.col("snap").alias("before"), F.lit(-1).alias("sign"))))
    signed = leaves.join(pairs_at, [*cut, "snap"]).select("*", roles.alias("r")).where("r.pair is not null")
    tree = signed.groupBy(*cut, "r.pair", "r.before", "leaf").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum(F.col("n") * F.col("r.sign")).alias("n"))
    for level in range(0, leaf_bits, FAN_BITS):  # top down: only children of differing nodes go on
        node = Window.partitionBy(*cut, "pair", F.shiftright("leaf", leaf_bits - level))
        tree = tree.select("*", *[F.bit_xor(d).over(node).alias(f"up_{d}") for d in ("d1", "d2")], F.sum("n").over(node).alias("up_n")).where("up_d1 != 0 or up_d2 != 0 or up_n != 0").drop("up_d1", "up_d2", "up_n")
    differing = tree.where("d1 != 0 or d2 != 0 or n != 0")
    sides = differing.select(*cut, "leaf", "pair", "before", F.explode(F.array(F.struct(F.col("pair").alias("snap"), F.lit(True).alias("later")), F.struct(F.col("before").alias("snap"), F.lit(False).alias("later")))).alias("x")).select(*cut, "leaf", "pair", "before", "x.snap", "x.later")
    both = held.join(sides, [*cut, "snap", "leaf"]).groupBy(*cut, "pair", "before", "k").agg(F.max(F.when(F.col("later"), F.col("c"))).alias("new"), F.max(F.when(~F.col("later"), F.col("c"))).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(F.col("s").alias(series), F.col("before").alias(f"prev_{snapshot}"), F.col("pair").alias(snapshot), F.col("k").alias(key), change.alias("change")).where("change is not null")
