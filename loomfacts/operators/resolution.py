"""Resolution ladders and builders: tiered call edges, call targets, requirements, path pairs, dense ids, graph text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dirname
from ..session import materialise
from .extract import lines


def tiered_edges(refined: DataFrame, sites: DataFrame, names: DataFrame) -> DataFrame:
    """Refined edges if there are any at all, else call sites, else syntactic names; tier says which.

    The test is on the whole table, not by row, and is made once. All three have the columns caller, callee, status and
    precision; syntactic names come out as heuristic findings of syntax precision.
    """
    if not refined.isEmpty():
        return refined.select("caller", "callee", "status", "precision", F.lit("refined").alias("tier"))
    if not sites.isEmpty():
        return sites.select("caller", "callee", "status", "precision", F.lit("site").alias("tier"))
    return names.select("caller", "callee", F.lit("heuristic").alias("status"), F.lit("syntax").alias("precision"), F.lit("name").alias("tier"))


def call_targets(calls: DataFrame, symbols: DataFrame, builtins: Sequence[str] = ()) -> DataFrame:
    """For each call (id, line_no, position, callee) its target and why: status, algorithm, target file, candidates.

    Resolved: one symbol of the name in the same file (lexical), else one in all (import_binding); a capital after new
    would be a constructor. Ambiguous: several and none of them in the file. Unresolved with the reason dynamic (a dotted
    name), builtin or not_found.
    """
    local = symbols.groupBy(F.col("id"), F.col("name").alias("callee")).agg(F.lit(True).alias("here"))
    known = symbols.groupBy(F.col("name").alias("callee")).agg(F.count_distinct("id").alias("candidates"), F.min("id").alias("first"))
    x = calls.join(local, ["id", "callee"], "left").join(known, "callee", "left")
    here = F.coalesce(F.col("here"), F.lit(False))
    status = F.when(here | (F.col("candidates") == 1), "resolved").when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")
    algorithm = F.when(here, "lexical").when(F.col("candidates") == 1, "import_binding")
    reason = F.when(status != "unresolved", F.lit(None)).when(F.col("callee").isin(*builtins) if builtins else F.lit(False), "builtin").when(F.col("callee").contains("."), "dynamic").otherwise("not_found")
    return x.select("id", "line_no", "position", "callee", status.alias("status"), algorithm.alias("algorithm"), F.when(here, F.col("id")).when(F.col("candidates") == 1, F.col("first")).alias("target"), F.coalesce("candidates", F.lit(0)).alias("candidates"), reason.alias("reason"))


#: First that holds wins. Fixed order.
REQUIREMENT_LADDER = ("outside_workspace", "duplicate", "dynamic", "setup_missing", "unsupported", "ambiguous", "unresolved", "undeclared", "resolved")


def requirement_status(flags: dict[str, Column]) -> Column:
    """The first rung of the ladder whose flag holds; resolved if none does. Null flags do not hold."""
    out = F.lit("resolved")
    for rung in reversed(REQUIREMENT_LADDER[:-1]):
        if rung in flags:
            out = F.when(F.coalesce(flags[rung], F.lit(False)), rung).otherwise(out)
    return out


def strongest_status(status: Column, precision: Column) -> Column:
    """A resolved edge of exact or set-up aware precision counts as exact; other statuses stay."""
    return F.when((status == "resolved") & precision.isin("exact", "setup_aware"), "exact").otherwise(status)


def paired_paths(files: DataFrame, left: str, right: str, path: str = "relative_path", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of paths that fit two patterns with the same captured context (group 1): *keys, context, left, right.

    An equi-join on the context; a path is not its own partner.
    """
    p = F.col(path)
    a = files.where(p.rlike(left)).select(*keys, F.regexp_extract(p, left, 1).alias("context"), p.alias("left")).distinct()
    b = files.where(p.rlike(right)).select(*keys, F.regexp_extract(p, right, 1).alias("context"), p.alias("right")).distinct()
    return a.join(b, [*keys, "context"]).where(F.col("left") != F.col("right"))


def dominance_holds(pairs: DataFrame, relation: DataFrame) -> DataFrame:
    """Adds holds to pairs (function, candidate, event): whether the candidate block dominates the event's.

    True for equal or unknown blocks, and if the function has no relation at all; otherwise by the relation
    (function, block, other), which may be reduced, but must be transitive.
    """
    have = relation.select("function").distinct().withColumn("__any", F.lit(True))
    hit = relation.select("function", F.col("block").alias("candidate"), F.col("other").alias("event"), F.lit(True).alias("__hit")).distinct()
    x = pairs.join(have, "function", "left").join(hit, ["function", "candidate", "event"], "left")
    return x.select(*pairs.columns, (F.col("candidate").isNull() | F.col("event").isNull() | (F.col("candidate") == F.col("event")) | F.col("__any").isNull() | F.col("__hit").isNotNull()).alias("holds"))


def interprocedural_edges(intra: DataFrame, calls: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """Edges of the interprocedural graph: src, dst, kind (intra, call, return, call_to_return), site.

    intra (src, dst); calls (site, at, after, callee): the node of the call, the node after it; entries and exits
    (function, node) of callees. Calls without a known callee have only the call_to_return edge.
    """
    into = calls.join(entries.select(F.col("function").alias("callee"), F.col("node").alias("dst")), "callee").select(F.col("at").alias("src"), "dst", F.lit("call").alias("kind"), "site")
    back = calls.join(exits.select(F.col("function").alias("callee"), F.col("node").alias("src")), "callee").select("src", F.col("after").alias("dst"), F.lit("return").alias("kind"), "site")
    over = calls.select(F.col("at").alias("src"), F.col("after").alias("dst"), F.lit("call_to_return").alias("kind"), "site").distinct()
    none = F.lit(None).cast(dict(calls.dtypes)["site"])
    return intra.select("src", "dst", F.lit("intra").alias("kind"), none.alias("site")).unionByName(into).unionByName(back).unionByName(over)


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """Adds the rank of each row's ``key`` among the distinct keys, from 0; rows with a null key have none.

    A window over all keys would run in one task. Here the keys are sorted into ranges, ranked inside each, and each
    range begins where the ones before it end: only one count a range comes to the driver.
    """
    spark = df.sparkSession
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    ranged = materialise(keys.repartitionByRange("__k").withColumn("__p", F.spark_partition_id()), "ids")
    counts = sorted((r["__p"], r["count"]) for r in ranged.groupBy("__p").count().collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offset = F.broadcast(spark.createDataFrame(starts, "__p int, __o long"))  # one row a range
    inside = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__k")) - 1).join(offset, "__p")
    return df.join(inside.select(F.col("__k").alias(key), (F.col("__r") + F.col("__o")).alias(name)), key, "left")


def dot_lines(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """One line of graph text for each edge (column value); quotes and backslashes are escaped."""
    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))

    return edges.select(F.concat(F.lit("  "), quoted(source), F.lit(" -> "), quoted(target), F.lit(";")).alias("value"))


ASSERTION = r"\b(?:t|b|tb)\.(?:Error|Errorf|Fatal|Fatalf|Fail|FailNow)\(|\b(?:assert|require)\.[A-Z]\w*\(|\bexpect\("
SUBTEST = r"\bt\.Run\(|\b(?:it|test)\("
TABLE_ROW = r"^\s*\{.*\},\s*$"


def test_facts(files: DataFrame) -> DataFrame:
    """For each test file its assertions, subtests and rows of tables: id, assertion_count, subtest_count, table_rows."""
    name = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    x = lines(files.where(name.rlike(r"_test\.go$|\.(test|spec)\.[cm]?[jt]sx?$")))

    def hits(pattern: str) -> Column:
        return F.size(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))

    each = x.groupBy("id", "line_no").agg(F.first("line").alias("line"))  # a file delivered twice counts once
    return each.groupBy("id").agg(F.sum(hits(ASSERTION)).alias("assertion_count"), F.sum(hits(SUBTEST)).alias("subtest_count"), F.count_if(F.col("line").rlike(TABLE_ROW)).alias("table_rows"))


def neighbours_in_directory(files: DataFrame) -> DataFrame:
    """Number of files of each repository and directory."""
    return files.select("repo_id", dirname(F.col("relative_path")).alias("directory"), "relative_path").distinct().groupBy("repo_id", "directory").agg(F.count(F.lit(1)).alias("files"))
