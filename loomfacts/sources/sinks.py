"""Sinks: JSON and SARIF reports, annotations, text, and tables kept by a key with a manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_annotation
from ..operators.ordered import ordered_sums

REPORT_VERSION = "1"


def json_report(d: DataFrame) -> DataFrame:
    """One JSON document a diagnostic, in a column ``value``; the form that read_report takes."""
    return d.select(F.to_json(F.struct(*d.columns)).alias("value"))


def write_json(d: DataFrame, path: str) -> None:
    """Newline-delimited JSON, written by all tasks at once."""
    json_report(d).write.mode("overwrite").text(path)


def sarif_results(d: DataFrame) -> DataFrame:
    """One SARIF 2.1 result a diagnostic (column value)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    region = F.struct(F.col("text_range.start_line").alias("startLine"), F.col("text_range.start_col").alias("startColumn"), F.col("text_range.end_line").alias("endLine"), F.col("text_range.end_col").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(F.col("stable_fingerprint").alias("stable/v1"))
    return d.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints"))).alias("value"))


def sarif_log(d: DataFrame, most_results: int = 100_000) -> str:
    """A whole SARIF log as text. A log is one document for a viewer, so it is only made of at most ``most_results`` results.

    Larger reports are written with ``sarif_results``, one result a line.
    """
    results = sarif_results(d)
    n = results.count()
    if n > most_results:
        raise ValueError(f"{n} results are too many for one log; write sarif_results instead")
    rows = results.orderBy("rule_id", "value").collect()
    rules = sorted({r["rule_id"] for r in rows if r["rule_id"] is not None})
    run = {"tool": {"driver": {"name": "loomfacts", "rules": [{"id": r} for r in rules]}}, "results": [json.loads(r["value"]) for r in rows]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


def annotations(d: DataFrame) -> DataFrame:
    """Workflow annotations, one a line (column value)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    return d.select(F.concat(F.lit("::"), level, F.lit(" file="), escape_annotation(F.coalesce("file", F.lit(""))), F.lit(",line="), F.coalesce(F.col("text_range.start_line").cast("string"), F.lit("1")), F.lit("::"), escape_annotation(F.coalesce("message", F.lit("")))).alias("value"))


def human_text(d: DataFrame, lines: DataFrame) -> DataFrame:
    """file:line:col severity rule message, the line and carets below the range (column value).

    lines (file, line_no, line) gives the snippets; a diagnostic without one comes without them.
    """
    r = F.col("text_range")
    head = F.format_string("%s:%d:%d %s %s %s", F.coalesce("file", F.lit("-")), r["start_line"], r["start_col"], F.col("severity"), F.coalesce("rule_id", F.lit("-")), F.coalesce("message", F.lit("")))
    x = d.join(lines.select(F.col("file").alias("__f"), "line_no", "line"), (F.col("file") == F.col("__f")) & (r["start_line"] == F.col("line_no")), "left")
    carets = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), r["start_col"] - 1)), F.expr("repeat('^', cast(greatest(1, case when text_range.end_line = text_range.start_line then text_range.end_col - text_range.start_col else length(line) - text_range.start_col + 1 end) as int))"))
    return x.select(F.concat_ws("\n", head, F.col("line"), F.when(F.col("line").isNotNull(), carets)).alias("value"))


def layer_key(name: str, version: str, inputs: dict[str, str]) -> str:
    """The key of a derived table: its name, version and the digests of its inputs."""
    return hashlib.sha256(json.dumps([name, version, sorted(inputs.items())]).encode()).hexdigest()[:32]


def write_layer(df: DataFrame, root: str, name: str, version: str, inputs: dict[str, str]) -> str:
    """Writes a derived table below ``root`` under its key; the manifest comes last, so a broken write is never read."""
    key = layer_key(name, version, inputs)
    at = f"{root.rstrip('/')}/{name}/{key}"
    df.write.mode("overwrite").parquet(f"{at}/data")
    manifest = {"name": name, "version": version, "inputs": inputs, "schema": df.schema.json()}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return key


def read_layer(spark: SparkSession, root: str, name: str, version: str, inputs: dict[str, str]) -> tuple[DataFrame | None, str]:
    """The table of a key and hit, or nothing and why: miss (no such key) or evict (its manifest does not fit)."""
    at = f"{root.rstrip('/')}/{name}/{layer_key(name, version, inputs)}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/manifest/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None, "miss"
    manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    if manifest["version"] != version or manifest["inputs"] != inputs:
        return None, "evict"
    return spark.read.parquet(f"{at}/data"), "hit"


def layer_entries(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The layers below ``root``: name, key, bytes, files, modified (seconds), complete. The listing has a row a layer, no file is read."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = fs_path(root.rstrip("/"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for folder in fs.globStatus(fs_path(f"{root.rstrip('/')}/{name or '*'}/*")) or []:
        path = folder.getPath()
        size = fs.getContentSummary(path)
        rows.append((path.getParent().getName(), path.getName(), size.getLength(), size.getFileCount(), folder.getModificationTime() / 1000.0, fs.exists(fs_path(path, "manifest/_SUCCESS"))))
    return spark.createDataFrame(rows, "name string, key string, bytes long, files long, modified double, complete boolean")


def layer_statistics(entries: DataFrame) -> DataFrame:
    """Of each name: layers, bytes, files, incomplete (without a manifest) and the latest modification."""
    return entries.groupBy("name").agg(F.count(F.lit(1)).alias("layers"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.count_if(~F.col("complete")).alias("incomplete"), F.max("modified").alias("modified"))


def delete_layers(spark: SparkSession, root: str, name: str | None = None, keys: list[str] | None = None) -> int:
    """Deletes the layers of a name (or all), or of the given keys only, and says how many. Nothing outside of ``root`` is touched."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for r in layer_entries(spark, root, name).collect():
        if keys is None or r["key"] in keys:
            path = fs_path(f"{root.rstrip('/')}/{r['name']}/{r['key']}")
            gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


class Demand:
    """Tables on demand, each computed once, with the reads of each recorded; reads may nest ``most_depth`` deep at most."""

    def __init__(self, most_depth: int = 64) -> None:
        self._how: dict[str, Callable[[Demand], DataFrame]] = {}
        self._done: dict[str, DataFrame] = {}
        self._stack: list[str] = []
        self._reads: set[tuple[str, str]] = set()
        self.most_depth = most_depth

    def define(self, name: str, how: Callable[[Demand], DataFrame]) -> None:
        self._how[name] = how
        self.drop(name)

    def read(self, name: str) -> DataFrame:
        if self._stack:
            self._reads.add((self._stack[-1], name))
        if name in self._stack:
            raise RecursionError(f"{name} reads itself: {' > '.join([*self._stack, name])}")
        if len(self._stack) >= self.most_depth:
            raise RecursionError(f"reads are nested deeper than {self.most_depth}")
        if name not in self._done:
            self._stack.append(name)
            try:
                self._done[name] = self._how[name](self)
            finally:
                self._stack.pop()
        return self._done[name]

    def reads(self, spark: SparkSession) -> DataFrame:
        """node, input: what was read for what."""
        return spark.createDataFrame(sorted(self._reads), "node string, input string")

    def drop(self, name: str) -> list[str]:
        """Forgets a table and all that were computed from it; their names."""
        gone, todo = [], [name]
        while todo:
            n = todo.pop()
            if n not in gone:
                gone.append(n)
                self._done.pop(n, None)
                todo += [a for a, b in self._reads if b == n]
        return sorted(gone)


def write_baseline(d: DataFrame, path: str, keys: Sequence[str], ignores: DataFrame | None = None) -> None:
    """Writes the identities of current diagnostics with their numbers of rows as the baseline, and with it the ignore section.

    Without ``ignores`` the ignore section that is there stays as it is (a refresh); with it, it is replaced.
    """
    spark = d.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("message").alias("message")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/active")
    kept = fs_path(f"{path.rstrip('/')}/ignored/_SUCCESS")
    if ignores is not None:
        ignores.write.mode("overwrite").parquet(f"{path.rstrip('/')}/ignored")
    elif not kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kept):
        d.select(*keys).limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/ignored")


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The active and the ignored identities."""
    return spark.read.parquet(f"{path.rstrip('/')}/active"), spark.read.parquet(f"{path.rstrip('/')}/ignored")


def retention(entries: DataFrame, now: float, most_age: float, most_bytes: int) -> DataFrame:
    """Entries (name, bytes, modified) to delete: those older than ``most_age``, then the oldest until the rest fits.

    The bytes of the entries deleted for their age still count against the limit.
    """
    old = F.lit(now) - F.col("modified") > most_age
    marked = entries.withColumn("__old", old).withColumn("__fresh", F.when(~old, F.col("bytes")).otherwise(0))
    total = entries.agg(F.sum("bytes")).first()[0] or 0
    # Bytes of fresh entries before each one in order of time, by ranges: no task gets all entries.
    x = ordered_sums(marked, [F.col("modified"), F.col("name")], "__fresh", "__before").withColumn("over", F.lit(total) - F.col("__before") > most_bytes)
    return x.select("name", "bytes", F.when(F.col("__old"), "age").when(F.col("over"), "size").alias("reason")).where("reason is not null")
