"""Diagnostics as rows: order, duplicates, occurrences, baselines, change gates, ignore directives and summaries.

A diagnostics table has rule_id, severity, file, text_range, message, help, evidence and stable_fingerprint; other columns
are carried or ignored. Nulls: a null rule, file or fingerprint is a value of its own in groups and orders (nulls first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import SEVERITY_RANK, any_glob, rank, selects
from ..session import maybe_broadcast
from .ordered import ordered_numbers

#: Sorted first within a position: diagnostics about capabilities.
CAPABILITY_PREFIX = "core/"


def report_order() -> list[Column]:
    """File, line, column, capability rules first, rule, message, fingerprint."""
    r = F.col("text_range")
    return [F.col("file").asc_nulls_first(), r["start_line"].asc_nulls_first(), r["start_col"].asc_nulls_first(), F.when(F.col("rule_id").startswith(CAPABILITY_PREFIX), 0).otherwise(1), F.col("rule_id").asc_nulls_first(), F.col("message").asc_nulls_first(), F.col("stable_fingerprint").asc_nulls_first()]


def dedupe(d: DataFrame, keys: Sequence[str] = ("stable_fingerprint",), tie: Sequence[Column] = ()) -> DataFrame:
    """Of the rows with equal ``keys`` the first in report order; rows with a null key are all kept.

    ``min_by`` instead of a row number keeps the partial aggregation before the shuffle, so a hot fingerprint costs one
    row a task.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = F.col("text_range")
    first = F.struct("file", r["start_line"], r["start_col"], F.when(F.col("rule_id").startswith(CAPABILITY_PREFIX), 0).otherwise(1), "rule_id", "message", *tie)
    firsts = d.where(known).groupBy(*keys).agg(F.min_by(F.struct(*d.columns), first).alias("x")).select("x.*")
    return firsts.unionByName(d.where(~known))


def occurrences(d: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Adds occurrence: 0 for the first row of a rule, file and fingerprint in order of its range, and so on."""
    r = F.col("text_range")
    return ordered_numbers(d, ["rule_id", "file", "stable_fingerprint"], [r["start_line"], r["start_col"], r["end_line"], r["end_col"], *[F.col(t) for t in tie]], "occurrence")


def filter_report(d: DataFrame, selector: str) -> DataFrame:
    """Rows of the selected rules; parser rows and rows with capability evidence always stay."""
    capability = F.coalesce(F.exists("evidence", lambda e: e["label"] == "capability"), F.lit(False))
    return d.where(selects(F.lit(selector), F.col("rule_id")) | F.col("rule_id").startswith("parser/") | capability)


def check_stats(d: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone and in total, in one pass: dimension, value, diagnostics."""
    kinds = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in dimensions], F.lit("total"))
    sets = [[F.col(c)] for c in dimensions] + [[]]
    out = d.groupingSets(sets, *[F.col(c) for c in dimensions]).agg(kinds.alias("dimension"), F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in dimensions]).alias("value"), F.count(F.lit(1)).alias("diagnostics"))
    return out.select("dimension", "value", "diagnostics")


def rule_summary(d: DataFrame) -> DataFrame:
    """For each rule its rows by severity and in all, the gravest severity and the number of files."""
    severity = rank(F.col("severity"), SEVERITY_RANK)
    return d.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITY_RANK], F.max(severity).alias("gravest"), F.count_distinct("file").alias("files"))


def example_per_rule(d: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The first row of each rule in report order."""
    r = F.col("text_range")
    key = F.struct("file", r["start_line"], r["start_col"], "message", *tie)
    return d.where("file is not null").groupBy("rule_id").agg(F.min_by(F.struct("file", r["start_line"].alias("line"), "message"), key).alias("x")).select("rule_id", "x.file", "x.line", "x.message")


def identity_groups(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multiplicity of each identity, and the least message that stands for it."""
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("multiplicity"), F.min("message").alias("message"))


def worst_of(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gravest severity of each group."""
    return d.groupBy(*keys).agg(F.max_by("severity", rank(F.col("severity"), SEVERITY_RANK)).alias("severity"), F.count(F.lit(1)).alias("diagnostics"))


def baseline_status(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identities as new, existing or fixed, with their number of rows on each side.

    One aggregation over both sides; a hot identity is one row a task and side before the shuffle.
    """
    now = current.select(*keys, F.lit(1).alias("now"), F.lit(0).alias("before"))
    both = now.unionByName(baseline.select(*keys, F.lit(0).alias("now"), F.lit(1).alias("before")))
    merged = both.groupBy(*keys).agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    return merged.withColumn("status", F.when(F.col("before") == 0, "new").when(F.col("now") == 0, "fixed").otherwise("existing"))


def match_baseline(current: DataFrame, baseline: DataFrame, exact: Sequence[str], relocated: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pairs current rows with baseline rows one to one: phase exact, then phase relocated.

    Exact: the n-th row of an identity meets the n-th row of the baseline. Relocated: a key left over exactly once on
    both sides. Every current row comes out once, with phase null if it is new. Keys must not be null.
    """
    a, b = (ordered_numbers(d, exact, [F.col(c) for c in order], "__n") for d in (current, baseline))
    hit = a.join(b.select(*exact, "__n"), [*exact, "__n"], "left_semi").withColumn("phase", F.lit("exact"))
    rest, left = a.join(b.select(*exact, "__n"), [*exact, "__n"], "left_anti"), b.join(a.select(*exact, "__n"), [*exact, "__n"], "left_anti")
    once = rest.groupBy(*relocated).count().where("count = 1").join(left.groupBy(*relocated).count().where("count = 1"), list(relocated)).select(*relocated, F.lit("relocated").alias("phase"))
    return hit.unionByName(rest.join(once, list(relocated), "left")).drop("__n")


def change_gate(d: DataFrame, changes: DataFrame, whole_file: bool = False) -> DataFrame:
    """Diagnostics that touch a changed range (path, lo, hi): closed intervals overlap; with ``whole_file`` the path suffices.

    Ranges of a path are merged first, so that a path with very many ranges has few rows; the range test follows the
    equi-join on the path. A deleted file has no ranges, hence only the whole-file mode keeps its rows.
    """
    if whole_file:
        return d.join(maybe_broadcast(changes.select(F.col("path").alias("file")).distinct()), "file", "left_semi")
    c = maybe_broadcast(merge_ranges(changes).alias("c"))
    r = F.col("d.text_range")
    return d.alias("d").join(c, (F.col("d.file") == F.col("c.path")) & (r["start_line"] <= F.col("c.hi")) & (F.col("c.lo") <= F.greatest(r["start_line"], r["end_line"])), "left_semi")


def merge_ranges(changes: DataFrame) -> DataFrame:
    """Overlapping or adjacent closed ranges of a path as one."""
    w = Window.partitionBy("path").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = changes.where("lo is not null and hi is not null and lo <= hi").withColumn("new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1)))
    return marked.withColumn("g", F.sum("new").over(w)).groupBy("path", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


# Ignore directives: // prefix-ignore-<kind> selectors -- reason
DIRECTIVE = r"^\s*(?://|/\*|\*|#)\s*([a-z]+)-ignore-(next-line|line|file|start|end)\s+([^\s].*?)\s*(?:--\s*(.*?))?\s*(?:\*/)?$"


def directives(lines: DataFrame, prefix: str) -> DataFrame:
    """Directives in lines (file, line_no, line): kind, selector (one row each), reason and the lines they cover.

    next-line covers the line after, line its own, file all; start covers the lines up to the matching end of the same
    selectors (nesting counts). status: malformed (no selector), unmatched (a start or end alone), missing_reason, ok.
    """
    found = lines.where(F.col("line").rlike(DIRECTIVE) & (F.regexp_extract("line", DIRECTIVE, 1) == prefix))
    x = found.select("file", "line_no", F.regexp_extract("line", DIRECTIVE, 2).alias("kind"), F.regexp_extract("line", DIRECTIVE, 3).alias("selectors"), F.nullif(F.regexp_extract("line", DIRECTIVE, 4), F.lit("")).alias("reason"))
    w = Window.partitionBy("file", "selectors").orderBy("line_no")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    depth = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("depth", F.when(F.col("kind") == "start", depth).when(F.col("kind") == "end", depth + 1))
    pair = Window.partitionBy("file", "selectors", "depth", F.col("kind").isin("start", "end")).orderBy("line_no")
    end = F.when((F.lead("kind").over(pair) == "end") & (F.col("kind") == "start"), F.lead("line_no").over(pair))
    closes = (F.lag("kind").over(pair) == "start") & (F.col("kind") == "end")
    x = x.withColumn("end", end).withColumn("closes", F.coalesce(closes, F.lit(False)))
    lo = F.when(F.col("kind") == "next-line", F.col("line_no") + 1).when(F.col("kind") == "line", F.col("line_no")).when(F.col("kind") == "file", 1).when(F.col("end").isNotNull(), F.col("line_no") + 1)
    hi = F.when(F.col("kind") == "next-line", F.col("line_no") + 1).when(F.col("kind") == "line", F.col("line_no")).when(F.col("kind") == "file", 2147483647).when(F.col("end").isNotNull(), F.col("end") - 1)
    unmatched = (F.col("kind").isin("start") & F.col("end").isNull()) | ((F.col("kind") == "end") & ~F.col("closes"))
    status = F.when(F.trim("selectors").isin("", "--"), "malformed").when(unmatched, "unmatched").when(F.col("reason").isNull() & (F.col("kind") != "end"), "missing_reason").otherwise("ok")
    return x.select("file", "line_no", "kind", F.explode(F.split("selectors", r"\s*,\s*")).alias("selector"), "reason", lo.alias("lo"), hi.alias("hi"), status.alias("status"))


def suppress(d: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Kept diagnostics, and suppressed ones with the line of the first directive that covers and selects them."""
    active = maybe_broadcast(found.where("lo is not null").select(F.col("file").alias("f"), "line_no", "selector", "lo", "hi"))
    line = F.col("text_range")["start_line"]
    hit = d.join(active, (F.col("file") == F.col("f")) & line.between(F.col("lo"), F.col("hi")) & selects(F.col("selector"), F.col("rule_id")))
    by = hit.groupBy(key).agg(F.min("line_no").alias("directive_line"))
    return d.join(by, key, "left_anti"), d.join(by, key)


def scope_filter(d: DataFrame, files: list[str], exclude: list[str]) -> DataFrame:
    return d.where(any_glob(F.col("file"), files) & ~any_glob(F.col("file"), exclude))


def exit_status(d: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: diagnostics and exit code (1 if any is at least ``fail_on``), before any limit of what is shown."""
    return d.agg(F.count(F.lit(1)).alias("diagnostics"), F.coalesce(F.max((rank(F.col("severity"), SEVERITY_RANK) >= SEVERITY_RANK[fail_on]).cast("int")), F.lit(0)).alias("exit_code"))


def referential_gaps(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Key values of ``child`` without a row in ``parent``, and how many rows have them; nulls do not refer to anything."""
    have = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(have, key, "left_anti")


def invalid_spans(d: DataFrame) -> DataFrame:
    """Rows whose range ends before it starts or has a position below 1."""
    r = F.col("text_range")
    wrong = (r["end_line"] < r["start_line"]) | ((r["end_line"] == r["start_line"]) & (r["end_col"] < r["start_col"])) | (r["start_line"] < 1) | (r["start_col"] < 1)
    return d.where(r.isNull() | wrong)


def top_k(d: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, their rank, and on the last of them whether more were cut off.

    Each task keeps at most k rows of a group before the shuffle (Spark's group limit below the window), and the sizes of
    groups come from an aggregation, so that a hot group is gathered nowhere. Rows with a null group form a group.
    """
    first = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
    sizes = d.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    joined = first.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn("truncated", (F.col("rank") == k) & (F.col("__n") > k)).drop("__n", "__g")


def ignore_rollups(found: DataFrame, suppressed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the directives do: by selector, by file, and in all.

    found are ``directives``, suppressed the second table of ``suppress``. By selector: directives, active (ok or without a reason),
    unused (active, but covering nothing that was suppressed), suppressed, files. By file: suppressed. In all: directives by
    status, unused and suppressed.
    """
    used = suppressed.groupBy(F.col("file").alias("f"), F.col("directive_line").alias("line_no")).agg(F.count(F.lit(1)).alias("hits"))
    active = F.col("status").isin("ok", "missing_reason") & (F.col("kind") != "end")
    x = found.join(used, (F.col("file") == F.col("f")) & (found["line_no"] == used["line_no"]), "left").select(found["*"], F.coalesce("hits", F.lit(0)).alias("hits"), active.alias("active"))
    counts = [F.count(F.lit(1)).alias("directives"), F.count_if("active").alias("active"), F.count_if(F.col("active") & (F.col("hits") == 0)).alias("unused"), F.sum("hits").alias("suppressed")]
    by_selector = x.groupBy("selector").agg(*counts, F.count_distinct("file").alias("files"))
    by_file = suppressed.groupBy("file").agg(F.count(F.lit(1)).alias("suppressed"))
    return by_selector, by_file, x.groupBy("status").agg(*counts)
