"""Sources: file trees, change sets, manifests, lock files, models, sidecar output and reports."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import in_scope, included
from ..functions.text import posix_path
from ..operators.extract import language

#: Files above this size become reject rows.
MOST_BYTES = 2 << 20


def discover(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = (), scope: list[str] | None = None) -> DataFrame:
    """path, relative_path, length, modified and language of the files below ``root`` that are included, and (if given) in scope.

    Only the listing is read: the content column of the source is pruned. Hidden folders are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").removeprefix("//")
    rel = F.regexp_replace(posix_path(F.col("path")), rf"^(?:file:)?/*{base.lstrip('/')}/", "")
    x = raw.select("path", rel.alias("relative_path"), "length", F.col("modificationTime").alias("modified")).where(included(F.col("relative_path"), list(include), list(exclude)) & ~F.col("relative_path").rlike(r"(^|/)\.[^/]"))
    if scope is not None:
        x = x.where(in_scope(F.col("relative_path"), scope, []))
    return x.withColumn("language", language())


def load_sources(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = (), most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Sources (relative_path, language, source) and rejects: a diagnostic row for each file above ``most_bytes``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = discover(spark, root, include, exclude)
    small = found.where(F.col("length") <= most_bytes).select("path", "relative_path", "language")
    sources = raw.select("path", F.col("content").cast("string").alias("source")).join(small, "path").select("relative_path", "language", "source")
    rejects = found.where(F.col("length") > most_bytes).select(
        F.lit("parser/file-too-large").alias("rule_id"), F.lit("warn").alias("severity"), F.col("relative_path").alias("file"), F.format_string("file has %d bytes, more than %d", "length", F.lit(most_bytes)).alias("message")
    )
    return sources, rejects


def parse_name_status(df: DataFrame, column: str) -> DataFrame:
    """position, status, path and old_path from NUL-separated change lists: a letter, then one path, or two for R and C.

    Each value is one list. Unknown letters are left out with their path.
    """
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("status", T.StringType()), T.StructField("path", T.StringType()), T.StructField("old_path", T.StringType())])))
    def parse(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            parts, out, i = (t or "").split("\0"), [], 0
            while i + 1 < len(parts) and parts[i]:
                letter = parts[i][0]
                two = letter in "RC"
                if i + 1 + two >= len(parts):
                    break
                if letter in "AMDRCT":
                    out.append({"status": letter, "path": parts[i + 1 + two], "old_path": parts[i + 1] if two else None})
                i += 2 + two
            return out

        return texts.map(one)

    return df.select(F.posexplode(parse(F.col(column))).alias("position", "c")).select("position", "c.status", "c.path", "c.old_path")


def parse_hunks(df: DataFrame, column: str) -> DataFrame:
    """path, lo, hi of the new side of each hunk of unified diffs; a hunk of no lines is left out, a missing length is 1."""
    lines = df.select(F.monotonically_increasing_id().alias("d"), F.col(column).alias("t")).select("d", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    w = Window.partitionBy("d").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    x = lines.withColumn("path", F.last(path, ignorenulls=True).over(w)).where(F.col("line").rlike(pattern))
    lo, size = F.regexp_extract("line", pattern, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).cast("int"), F.lit(1))
    return x.select("path", lo.alias("lo"), size.alias("size")).where("size > 0 and path <> '/dev/null'").select("path", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))


def parse_go_mod(df: DataFrame, column: str, key: str) -> DataFrame:
    """Directives of go.mod texts: key, directive (module, go, require, replace, exclude), path, version, target, indirect."""
    lines = df.select(key, F.posexplode(F.split(column, "\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    head = F.regexp_extract("line", r"^(module|go|require|replace|exclude|retract|toolchain)\b", 1)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(r"^\w+ \($"), head).when(F.col("line") == ")", F.lit("-"))
    x = lines.withColumn("block", F.last(mark, ignorenulls=True).over(w)).where("line <> ')' and line <> ''")
    x = x.withColumn("directive", F.when(head != "", head).when(F.col("block") != "-", F.col("block"))).where("directive is not null").where(~F.col("line").rlike(r"\($"))
    body = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s*//.*$", ""), r"^(module|go|require|replace|exclude)\s+", ""))
    parts = F.split(F.regexp_replace(body, r"\s*=>\s*.*$", ""), r"\s+")
    return x.select(key, "directive", F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).alias("version"), F.nullif(F.regexp_extract(body, r"=>\s*(.*)$", 1), F.lit("")).alias("target"), F.col("line").contains("// indirect").alias("indirect"))


def parse_lock(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, package and version of npm lock files (both their forms); other texts give no rows."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("package", T.StringType()), T.StructField("version", T.StringType())])))
    def parse(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            try:
                d = json.loads(t or "")
            except ValueError:
                return []
            if not isinstance(d, dict):
                return []
            flat = {k.rpartition("node_modules/")[2]: v for k, v in (d.get("packages") or {}).items() if k}
            return [{"package": k, "version": str(v.get("version"))} for k, v in ((flat or d.get("dependencies") or {}).items()) if isinstance(v, dict)]

        return texts.map(one)

    return df.select(key, F.explode(parse(F.col(column))).alias("p")).select(key, "p.package", "p.version").distinct()


def read_models(df: DataFrame, column: str, key: str) -> DataFrame:
    """Model facts from TOML texts (tables [[model]] with source, target, kind, evidence): key, number, fields, error."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, number int, source string, target string, kind string, evidence array<string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[column]):
                try:
                    models = tomllib.loads(t or "").get("model", [])
                    rows += [(k, i, str(m.get("source", "")), str(m.get("target", "")), str(m.get("kind", "")), [str(x) for x in m.get("evidence", [])], None) for i, m in enumerate(models)]
                except tomllib.TOMLDecodeError as e:
                    rows.append((k, 0, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "number", "source", "target", "kind", "evidence", "error"])

    return df.select(key, column).mapInPandas(run, schema)


def read_sidecar(spark: SparkSession, path: str, schema: str, protocol: str) -> tuple[DataFrame, DataFrame]:
    """Rows of newline-delimited JSON whose ``protocol`` fits, and the records that do not parse or have another one."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    x = raw.select("value", F.from_json("value", f"protocol string, {schema}").alias("r"), F.try_parse_json("value").isNull().alias("broken"))
    good = ~F.col("broken") & (F.coalesce(F.col("r.protocol"), F.lit("")) == protocol)
    return x.where(good).select("r.*").drop("protocol"), x.where(~good).select("value")


DIAGNOSTIC = "rule_id string, severity string, file string, text_range struct<start_line:int,start_col:int,end_line:int,end_col:int>, message string, help string, evidence array<struct<label:string,value:string>>, stable_fingerprint string"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostics of a JSON report: one object with a list ``diagnostics``, or one diagnostic a line."""
    raw = spark.read.text(path)
    x = raw.select(F.from_json("value", f"diagnostics array<struct<{_ddl(DIAGNOSTIC)}>>")["diagnostics"].alias("many"), F.from_json("value", DIAGNOSTIC).alias("one"))
    return x.select(F.explode(F.coalesce("many", F.array("one"))).alias("d")).where("d.message is not null").select("d.*")


def _ddl(columns: str) -> str:
    depth, out = 0, []
    for ch in columns.replace(", ", ","):
        depth += (ch == "<") - (ch == ">")
        out.append(ch)
    parts, now, depth = [], "", 0
    for ch in "".join(out):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return ",".join(p.replace(" ", ":", 1) for p in [*parts, now])
