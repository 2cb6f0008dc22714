"""Session helpers: table loading, materialisation in the shared folder, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's size estimate for it is at most this many bytes.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. Timestamps without a zone are read as instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomfacts-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Folders of the tables that are still there.
_TABLES: set[str] = set()


def _remove_all(spark: SparkSession) -> None:
    for path in list(_TABLES):
        _remove(spark, path)
    _TABLES.clear()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of an executor. The files are removed by ``release``, else when the
    driver exits.
    """
    return materialise_counted(df, tag)[0]


def materialise_counted(df: DataFrame, tag: str = "t", **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and ``n``, the number of rows, with other ``metrics``, all taken while the table is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomfacts-{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]).write.mode("overwrite").parquet(path)
    _TABLES.add(path)
    if len(_TABLES) == 1:
        atexit.register(_remove_all, spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_loomfacts_path"] = path
    return out, seen.get


def release(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` gave and that no later plan reads."""
    for t in tables:
        path = t.__dict__.get("_loomfacts_path")
        if path in _TABLES:
            _remove(t.sparkSession, path)
            _TABLES.discard(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a check of the size; beyond it the join shuffles (AQE splits skewed partitions)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def input_chunks(df: DataFrame) -> int:
    """Number of partitions in which ``df`` is read."""
    return int(df._jdf.queryExecution().toRdd().getNumPartitions())
