"""Facts from source text: packages, imports, functions, types, literals, tests, branches and their metrics.

All of it stays in built-in functions: a source is cut into numbered lines where it is read, and each kind of fact is a
pattern over lines. A line gives at most one fact of a kind (literals and attributes may give several). Facts of a file
delivered twice are dropped after extraction, when rows are narrow, so whole sources are never shuffled. Null sources give
no facts; empty sources give a file row with zero counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname, extension, line_count, non_empty_line_count

# Extensions of the languages.
EXTENSIONS = {"go": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx"}
SCRIPT = ("typescript", "tsx", "javascript", "jsx")

# Patterns in the syntax that Java and RE2 share; group 1 (and 2) are the fact's values.
GO_PACKAGE = r"^package ([A-Za-z_][A-Za-z0-9_]*)"
GO_IMPORT = r'^(?:import\s+|\t)(?:([A-Za-z_.][A-Za-z0-9_]*)\s+)?"([^"\s]+)"\s*$'
GO_FUNC = r"^func (?:\([^)]*\) )?([A-Za-z_][A-Za-z0-9_]*)[\[(]"
GO_TYPE = r"^type ([A-Za-z_][A-Za-z0-9_]*)(?:\[[A-Za-z_][^\]]* [^\]]*\])? (struct|interface|[^\s{]+)"
TS_IMPORT = r"""(?:^import\s.*from\s*|^import\s*|^export\s.*from\s*|require\(|import\()["']([^"'\s]+)["']"""
TS_FUNC = r"^(?:export )?(?:default )?(?:async )?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)|^(?:export )?const ([A-Za-z_$][A-Za-z0-9_$]*) = (?:async )?\([^)]*\)(?:: [^=]+)? =>"
TS_CLASS = r"^(?:export )?(?:default )?(?:abstract )?class ([A-Za-z_$][A-Za-z0-9_$]*)"
STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
JSX_ATTRIBUTE = r'\s([a-zA-Z][a-zA-Z-]*)="([^"]*)"'
CALL = r"([A-Za-z_$][A-Za-z0-9_$.]*)\("
BRANCH = r"^\s*(?:\} else )?(if|switch|select|for|while)\b\s*(.*?)\s*\{\s*$"
DECISION = r"\b(?:if|for|while|case|default|catch)\b|&&|\|\|"
ERROR_TERMS = ("err!=nil", "error", "err==")
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "func", "return", "select", "go", "defer")


def language() -> Column:
    """The language by the path's extension; unknown for others."""
    e = extension(F.col("relative_path"))
    return F.coalesce(*[F.when(e == k, v) for k, v in EXTENSIONS.items()], F.lit("unknown"))


def lines(files: DataFrame) -> DataFrame:
    """id, language, line_no (from 1) and line (without a carriage return at its end) of each line."""
    text = F.regexp_replace("source", "^﻿", "")
    return files.where(F.col("source").isNotNull()).select("id", language().alias("language"), F.posexplode(F.split(text, "\n")).alias("p", "l")).select("id", "language", (F.col("p") + 1).alias("line_no"), F.regexp_replace("l", "\r$", "").alias("line"))


def source_files(files: DataFrame) -> DataFrame:
    return files.select("id", "repo_id", "relative_path", language().alias("language"), dirname(F.col("relative_path")).alias("directory"), "content_hash").dropDuplicates(["id"])


def file_metrics(files: DataFrame) -> DataFrame:
    """Line, non-empty line, byte and function counts of each file with a source."""
    src = F.col("source")
    functions = F.size(F.regexp_extract_all(src, F.lit(rf"(?m){GO_FUNC}|(?m){TS_FUNC}"), F.lit(0)))
    return files.where(src.isNotNull()).select("id", language().alias("language"), line_count(src).alias("line_count"), non_empty_line_count(src).alias("non_empty_line_count"), F.octet_length(src).cast("long").alias("byte_count"), functions.cast("long").alias("function_count")).dropDuplicates(["id"])


def packages(files: DataFrame) -> DataFrame:
    found = lines(files).where((F.col("language") == "go") & F.col("line").rlike(GO_PACKAGE))
    return found.select("id", F.regexp_extract("line", GO_PACKAGE, 1).alias("name"), "line_no").distinct()


def imports(files: DataFrame) -> DataFrame:
    """id, language, line_no, path and (Go) alias of each import; for scripts static, dynamic, required and re-exported ones."""
    x = lines(files)
    go = x.where((F.col("language") == "go") & F.col("line").rlike(GO_IMPORT)).select("id", "language", "line_no", F.regexp_extract("line", GO_IMPORT, 2).alias("path"), F.regexp_extract("line", GO_IMPORT, 1).alias("alias"))
    ts = x.where(F.col("language").isin(*SCRIPT) & F.col("line").rlike(TS_IMPORT)).select("id", "language", "line_no", F.regexp_extract("line", TS_IMPORT, 1).alias("path"), F.lit("").alias("alias"))
    return go.unionByName(ts).distinct()


def functions(files: DataFrame) -> DataFrame:
    """id, language, name, start line, export flag and test flag of each top-level function."""
    x = lines(files)
    go = x.where((F.col("language") == "go") & F.col("line").rlike(GO_FUNC)).withColumn("name", F.regexp_extract("line", GO_FUNC, 1))
    ts = x.where(F.col("language").isin(*SCRIPT) & F.col("line").rlike(TS_FUNC)).withColumn("name", F.coalesce(F.nullif(F.regexp_extract("line", TS_FUNC, 1), F.lit("")), F.regexp_extract("line", TS_FUNC, 2)))
    go = go.withColumn("is_exported", F.col("name").rlike("^[A-Z]")).withColumn("is_test", F.col("name").rlike("^(Test|Benchmark|Fuzz|Example)"))
    ts = ts.withColumn("is_exported", F.col("line").startswith("export ")).withColumn("is_test", F.lit(False))
    return go.unionByName(ts).select("id", "language", "name", "line_no", "is_exported", "is_test").distinct()


def function_metrics(files: DataFrame) -> DataFrame:
    """Lines, decisions and calls of each function: from its first line to the next line that is only its closing bracket.

    The complexity is 1 plus its branch words (default cases too) and boolean operators; calls are counted by name.
    A line belongs to the function that began last in its file.
    """
    from pyspark.sql import Window

    x = lines(files).distinct()
    starts = F.when(F.col("language") == "go", F.col("line").rlike(GO_FUNC)).otherwise(F.col("line").rlike(TS_FUNC))
    w = Window.partitionBy("id").orderBy("line_no")
    numbered = x.where(F.col("language") != "unknown").withColumn("f", F.sum(starts.cast("int")).over(w)).where("f > 0")
    within = Window.partitionBy("id", "f").orderBy("line_no")
    closed = F.sum(F.col("line").rlike(r"^[})]").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    body = numbered.withColumn("closed", F.coalesce(closed, F.lit(0))).where("closed = 0")
    decisions = F.size(F.regexp_extract_all("line", F.lit(DECISION), F.lit(0)))
    calls = F.size(F.filter(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)), lambda c: ~c.isin(*NOT_CALLS)))
    first = F.min_by("line", "line_no")
    name = F.coalesce(F.nullif(F.regexp_extract(first, GO_FUNC, 1), F.lit("")), F.nullif(F.regexp_extract(first, TS_FUNC, 1), F.lit("")), F.regexp_extract(first, TS_FUNC, 2))
    return body.groupBy("id", "f").agg(name.alias("name"), F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("line_count"), F.sum(F.octet_length("line") + 1).alias("byte_count"), (1 + F.sum(decisions)).alias("cyclomatic_complexity"), F.sum(calls).alias("calls")).drop("f")


def call_names(files: DataFrame) -> DataFrame:
    """id, line_no, position and callee of each syntactic call, declarations left out."""
    x = lines(files).where((F.col("language") != "unknown") & ~F.col("line").rlike(rf"{GO_FUNC}|{TS_FUNC}") & ~F.col("line").rlike(r"^\s*(//|\*|/\*)"))
    return x.select("id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("position", "callee")).where(~F.col("callee").isin(*NOT_CALLS)).distinct()


def go_types(files: DataFrame) -> DataFrame:
    """Top-level type declarations of Go: kind struct, interface, alias or named."""
    found = lines(files).where((F.col("language") == "go") & F.col("line").rlike(GO_TYPE))
    kind = F.regexp_extract("line", GO_TYPE, 2)
    return found.select("id", "line_no", F.regexp_extract("line", GO_TYPE, 1).alias("name"), F.when(kind.isin("struct", "interface"), kind).when(kind == "=", "alias").otherwise("named").alias("kind")).distinct()


def ts_classes(files: DataFrame) -> DataFrame:
    found = lines(files).where(F.col("language").isin(*SCRIPT) & F.col("line").rlike(TS_CLASS))
    return found.select("id", "line_no", F.regexp_extract("line", TS_CLASS, 1).alias("name"), F.col("line").startswith("export ").alias("is_exported"), F.col("line").rlike(r"extends (React\.)?(Pure)?Component").alias("is_component_like")).distinct()


def ts_components(files: DataFrame) -> DataFrame:
    """Functions of tsx and jsx files whose name begins with a capital."""
    return functions(files).where(F.col("language").isin("tsx", "jsx") & F.col("name").rlike("^[A-Z]")).select("id", "name", "line_no")


def string_literals(files: DataFrame) -> DataFrame:
    """Double-quoted literals, those of import lines left out."""
    x = lines(files).where((F.col("language") != "unknown") & ~F.col("line").rlike(rf"{GO_IMPORT}|{TS_IMPORT}") & ~F.col("line").rlike(r"^\s*(//|\*|/\*)"))
    return x.select("id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(STRING), F.lit(1))).alias("position", "value")).distinct()


def jsx_attributes(files: DataFrame) -> DataFrame:
    x = lines(files).where(F.col("language").isin("tsx", "jsx") & F.col("line").rlike(r"^\s*<"))
    found = x.select("id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(JSX_ATTRIBUTE), F.lit(0))).alias("position", "a"))
    return found.select("id", "line_no", "position", F.regexp_extract("a", JSX_ATTRIBUTE, 1).alias("name"), F.regexp_extract("a", JSX_ATTRIBUTE, 2).alias("value")).distinct()


def branch_obligations(files: DataFrame) -> DataFrame:
    """Branches with their condition text and whether they are an error path (by the condition without spaces)."""
    found = lines(files).where((F.col("language") != "unknown") & F.col("line").rlike(BRANCH))
    condition = F.regexp_extract("line", BRANCH, 2)
    plain = F.regexp_replace(F.lower(condition), r"\s", "")
    error = F.lit(False)
    for t in ERROR_TERMS:
        error = error | F.contains(plain, F.lit(t))
    return found.select("id", "line_no", F.regexp_extract("line", BRANCH, 1).alias("kind"), condition.alias("condition"), error.alias("is_error_path")).distinct()


def test_files(files: DataFrame) -> DataFrame:
    """Files that are tests by their name."""
    return source_files(files).where(F.col("relative_path").rlike(r"_test\.go$|\.(test|spec)\.[cm]?[jt]sx?$"))


def related_tests(files: DataFrame) -> DataFrame:
    """For each Go file that is no test, the Go tests of its directory and repository."""
    x = source_files(files).where(F.col("language") == "go")
    is_test = F.col("relative_path").rlike(r"_test\.go$")
    tests = x.where(is_test).select("repo_id", "directory", F.col("id").alias("test_id"))
    return x.where(~is_test).select("id", "repo_id", "directory").join(tests, ["repo_id", "directory"]).select("id", "test_id")


#: Extensions of scripts in the order in which they are probed, and those that one written in an import may stand for. Fixed values.
PROBED = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
STANDS_FOR = {"js": ("ts", "tsx"), "jsx": ("tsx",), "mjs": ("mts",), "cjs": ("cts",)}


def normalised(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; null if it leads above the root."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(F.array(F.lit("!"), F.lit("!")))).otherwise(F.concat(a, F.array(x)))
    # The first element only keeps the array from being empty; a second "!" marks a path that led above the root.
    parts = F.aggregate(F.split(path, "/"), F.array(F.lit("")), lambda a, x: F.when(F.element_at(a, 1) == "!", a).otherwise(step(a, x)))
    return F.when(F.element_at(parts, 1) != "!", F.array_join(F.slice(parts, 2, F.size(parts)), "/"))


def resolved_imports(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """The status of each import: dynamic, resolved (with target), external, setup_missing or unresolved.

    A relative path is taken from the directory of its file, ``.`` and ``..`` segments being resolved; one that leads out
    of the repository is unresolved. Probed in order: the path itself, the path with each extension, the source that an
    extension in it stands for (``./a.js`` for a.ts), and an index file of the folder; the first that names a file of the repository
    wins. ``aliases`` (prefix to folder, as a set-up file gives them) make a path relative to the root of the repository; ``@app/``
    without such an entry is setup_missing. A Go path is external if it names a package of the standard library or another
    host; a script path without a dot before it is a package, hence external.
    """
    at = source_files(files).select("id", "repo_id", "directory")
    i = imports(files).join(at, "id")
    relative = F.col("path").startswith(".") & (F.col("language") != "go")
    base = F.when(relative, F.concat_ws("/", F.nullif(F.col("directory"), F.lit("")), F.col("path")))
    for prefix, folder in (aliases or {}).items():
        base = F.when(F.col("path").startswith(prefix), F.concat(F.lit(folder), F.substring("path", len(prefix) + 1, 4096))).otherwise(base)
    i = i.withColumn("__base", normalised(base))
    b, ext = F.col("__base"), F.regexp_extract("__base", r"\.([a-z]+)$", 1)
    stem = F.regexp_replace("__base", r"\.[a-z]+$", "")
    own = [F.when(ext.isin(*PROBED), b)] + [F.concat(b, F.lit("." + e)) for e in PROBED]
    other = [F.when(ext == e, F.concat(stem, F.lit("." + x))) for e, xs in STANDS_FOR.items() for x in xs]
    index = [F.concat_ws("/", F.nullif(b, F.lit("")), F.lit("index." + e)) for e in PROBED]
    candidates = i.where("__base is not null").select("id", "line_no", "path", "repo_id", F.posexplode(F.array(*own, *other, *index)).alias("priority", "candidate")).where("candidate is not null")
    targets = source_files(files).select("repo_id", F.col("relative_path").alias("candidate"), F.col("id").alias("target"))
    hits = candidates.join(targets, ["repo_id", "candidate"]).groupBy("id", "line_no", "path").agg(F.min_by("target", F.struct("priority", "target")).alias("target"))
    status = (
        F.when(F.col("path").contains("${"), "dynamic").when(F.col("target").isNotNull(), "resolved").when(F.col("__base").isNotNull() | F.col("path").startswith("."), "unresolved").when(F.col("path").startswith("@app/"), "setup_missing").otherwise("external")
    )
    return i.join(hits, ["id", "line_no", "path"], "left").select("id", "line_no", "path", "target", status.alias("status"))
