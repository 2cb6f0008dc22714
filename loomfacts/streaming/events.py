"""Event streams: windowed counts with late data, and guard checks that keep state a scope.

Each function takes a streaming (or batch) table of events. ``run_available`` processes all there is by micro-batches and
gives the result as a table, with offsets and state in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """A stream of the Parquet files at ``path`` (a folder or a file)."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path + "*")
    for c, kind in stream.dtypes:
        if kind == "timestamp_ntz":
            stream = stream.withColumn(c, F.col(c).cast("timestamp"))
    return stream


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by tumbling window and type; events later than ``late`` behind the latest one are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


def latest_ids(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once, repeated deliveries within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def missing_guard_stream(events: DataFrame, event: str, guard: str) -> DataFrame:
    """Events of a scope that come before its first guard; the state of a scope is the least guard position seen.

    A guard that arrives after its event was reported cannot take the report back.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        x = pd.concat(list(batches)).sort_values("position", kind="stable")
        guards = x.loc[x["name"] == guard, "position"]
        if len(guards):
            first = int(guards.min()) if first is None else min(first, int(guards.min()))
            state.update((first,))
        open_ = x[(x["name"] == event) & ((first is None) | (x["position"] <= (first if first is not None else 0)))]
        yield pd.DataFrame({"scope": [key[0]] * len(open_), "position": open_["position"].to_numpy()})

    return events.groupBy("scope").applyInPandasWithState(run, "scope long, position long", "first long", "append", GroupStateTimeout.NoTimeout)


def run_available(result: DataFrame, mode: str, latest_by: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is available. With ``latest_by`` the last update of each key is the result.

    Each micro-batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    spark = result.sparkSession
    at = f"{shared_dir(spark)}/loomfacts-stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/b={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    columns = result.columns
    done = spark.read.schema(T.StructType([*result.schema, T.StructField("__batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    if latest_by:
        return done.groupBy(*latest_by).agg(F.max_by(F.struct(*columns), "__batch").alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in columns])
    return done.select(*columns)
