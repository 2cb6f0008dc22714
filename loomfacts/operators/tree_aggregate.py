"""Per-key results without a hot reducer: multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import input_chunks, materialise

_CHUNK = "__chunk"


def fan_in_rounds(chunks: int, fan_in: int) -> list[int]:
    """Chunk counts after each round: ``chunks`` shrinks by ``fan_in`` until one remains."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    out, n = [], max(1, chunks)
    while n > 1:
        n = -(-n // fan_in)
        out.append(n)
    return out


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    init: dict[str, Column],
    merge: dict[str, Column],
    fan_in: int = 32,
    chunk: Column | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through rounds of bounded fan-in.

    ``init`` makes the state columns from the rows of one chunk, ``merge`` combines states; both map the same names.
    A chunk is an input partition (of a size that spark.sql.files.maxPartitionBytes fixes), or ``chunk``, an integer
    column below ``chunks``. Rows of a chunk are combined where they are read; each round then merges at most
    ``fan_in`` states of a key, so that no task ever receives all partial states of a hot key, however many rows it has.

    Null keys form a group of their own. An empty table gives no rows. Extra columns are ignored.
    """
    if set(init) != set(merge):
        raise ValueError("init and merge must have the same names")
    if chunk is None:
        chunks, chunk = input_chunks(df), F.spark_partition_id()
    states = df.withColumn(_CHUNK, chunk.cast("int"))
    rounds = fan_in_rounds(chunks or 1, fan_in)
    first = rounds[0] if rounds else 1
    # The first round's map side is the local combination of the chunk: one partial state a key and input task.
    states = states.groupBy(*keys, (F.col(_CHUNK) % F.lit(max(1, first))).alias(_CHUNK)).agg(*[c.alias(n) for n, c in init.items()])
    for left in rounds[1:]:
        states = states.groupBy(*keys, (F.col(_CHUNK) % F.lit(left)).alias(_CHUNK)).agg(*[c.alias(n) for n, c in merge.items()])
    return states.drop(_CHUNK)


def key_values(df: DataFrame, columns: Sequence[str], carry: dict[str, Column]) -> DataFrame:
    """One row for each row and each of ``columns``: key_kind, key_value and the columns of ``carry``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key_kind"), F.col(c).cast("string").alias("key_value")) for c in columns]))
    return df.select(pairs.alias("__kv"), *[c.alias(n) for n, c in carry.items()]).select("__kv.key_kind", "__kv.key_value", *carry)


def per_key_results(df: DataFrame, columns: Sequence[str], group: str = "series_id", latest: str = "ingested_at", fan_in: int = 32, buckets: int = 256) -> DataFrame:
    """For each value of each of ``columns``: rows, distinct ``group`` values and the latest ``latest``.

    The first tree has the grain (value, group value), over which even a value with a third of all rows spreads; the
    second tree merges these states by value, with hash buckets of the group value as its chunks. Exact. Null values of
    a key column form a row with a null ``key_value``; a null group value is not counted as a group; an empty table
    gives no rows; repeated rows count.
    """
    kv = key_values(df, columns, {"__g": F.col(group), "__t": F.col(latest)})
    fine = tree_aggregate(kv, ["key_kind", "key_value", "__g"], {"n": F.count(F.lit(1)), "t": F.max("__t")}, {"n": F.sum("n"), "t": F.max("t")}, fan_in)
    return tree_aggregate(
        fine,
        ["key_kind", "key_value"],
        {"row_count": F.sum("n"), "group_count": F.count("__g"), "latest": F.max("t")},
        {"row_count": F.sum("row_count"), "group_count": F.sum("group_count"), "latest": F.max("latest")},
        fan_in,
        F.pmod(F.xxhash64("__g"), F.lit(buckets)),
        buckets,
    )


def heavy_keys(df: DataFrame, columns: Sequence[str], share: float = 0.03, fan_in: int = 32) -> DataFrame:
    """The non-null values of ``columns`` which at least ``share`` of all rows hold: key_kind, key_value, row_count.

    At most 1 / share values a column can qualify. Null values count in the total but are never heavy. Empty table: no rows.
    """
    kv = key_values(df, columns, {})
    counts = materialise(tree_aggregate(kv, ["key_kind", "key_value"], {"row_count": F.count(F.lit(1))}, {"row_count": F.sum("row_count")}, fan_in), "counts")
    # Null values are counted too, so the counts of one column add up to all rows: the table is read once.
    total = counts.where(F.col("key_kind") == columns[0]).agg(F.sum("row_count")).first()[0] or 0
    least = math.ceil(share * total - 1e-9)
    return counts.where(F.col("key_value").isNotNull() & (F.col("row_count") >= F.lit(least)))
