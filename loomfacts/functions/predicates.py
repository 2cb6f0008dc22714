"""Predicates and rank tables as columns: globs, scopes, selectors, call names, precision and confidence floors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, last_segment

# Order of the labels of precision, confidence, severity and resolution status.
PRECISION_RANK = {"exact": 5, "setup_aware": 4, "syntax": 3, "conservative": 2, "heuristic": 1, "unknown": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
SEVERITY_RANK = {"info": 0, "warn": 1, "error": 2}
ALWAYS_REPORTED = ("unknown", "budget_exceeded", "unsupported")
LOGGER_SUFFIXES = ("log", "info", "warn", "error")
HTTP_SOURCES = ("path_param", "query_string", "request_body", "request_header", "form_body")


def rank(c: Column, table: dict[str, int]) -> Column:
    """The rank of a label; null for a label that is not in the table."""
    out = F.lit(None).cast("int")
    for label, r in table.items():
        out = F.when(c == label, r).otherwise(out)
    return out


def glob_regex(pattern: str) -> str | None:
    """A regular expression for a glob: ``*`` and ``?`` stay within a segment, ``**`` crosses them, [..] and {a,b} as usual.

    None for an invalid pattern (an unclosed bracket or brace).
    """
    out, i, n, depth = "", 0, len(pattern), 0
    while i < n:
        c = pattern[i]
        if c == "*":
            if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
                continue
            if pattern.startswith("**", i):
                out, i = out + ".*", i + 2
                continue
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            e = pattern.find("]", i + 2)
            if e < 0:
                return None
            body = pattern[i + 1 : e]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", e + 1
            continue
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return None if depth else f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether the path, or the path with ./ before it, fits the glob; an invalid glob is searched as text without its stars."""
    r = glob_regex(pattern)
    if r is None:
        return F.contains(path, F.lit(pattern.strip("*")))
    return path.rlike(r) | F.concat(F.lit("./"), path).rlike(r)


def any_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches_glob(path, p)
    return out


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """An include pattern fits and no exclude pattern does."""
    return any_glob(path, include) & ~any_glob(path, exclude)


def in_scope(path: Column, files: list[str], allow_files: list[str], allow: list[str] | None = None) -> Column:
    """Files is empty or fits, no allow pattern fits, and (if ``allow`` is given) the path is none of its entries."""
    out = (any_glob(path, files) if files else F.lit(True)) & ~any_glob(path, allow_files)
    return out if allow is None else out & ~path.isin(allow) if allow else out


def selects(selector: Column, rule: Column) -> Column:
    """``*`` selects every rule, ``prefix/*`` the rules of a prefix, anything else the rule of that name."""
    return (selector == "*") | (selector.endswith("/*") & rule.startswith(F.regexp_replace(selector, r"\*$", ""))) | (selector == rule)


def names_call(callee: Column, target: str) -> Column:
    """The callee is the target, or its last dotted segment is."""
    return (callee == target) | (last_segment(callee) == target)


def names_preferred(semantic: Column, syntactic: Column, targets: list[str]) -> Column:
    """Semantic names decide if there are any, otherwise the syntactic ones; exact membership."""
    return F.coalesce(F.arrays_overlap(F.when(F.size(semantic) > 0, semantic).otherwise(syntactic), F.array(*[F.lit(t) for t in targets])), F.lit(False))


def is_logger(callee: Column, names: list[str] = ()) -> Column:
    low = ascii_lower(callee)
    return low.isin(*[n.lower() for n in names] or ["log"]) | low.rlike(r"\.(" + "|".join(LOGGER_SUFFIXES) + r")$")


def is_http_source(kind: Column) -> Column:
    return kind.isin(*HTTP_SOURCES)


def passes_floor(status: Column, precision: Column, least: str) -> Column:
    """Results of unknown, unsupported or budget status always pass; others need the precision."""
    return status.isin(*ALWAYS_REPORTED) | (rank(precision, PRECISION_RANK) >= PRECISION_RANK[least])


def edge_passes(status: Column, precision: Column, confidence: Column, least_precision: str, least_confidence: str) -> Column:
    return (rank(confidence, CONFIDENCE_RANK) >= CONFIDENCE_RANK[least_confidence]) & ((rank(precision, PRECISION_RANK) >= PRECISION_RANK[least_precision]) | (status != "resolved"))


def weakest(labels: Column, table: dict[str, int]) -> Column:
    """The least rank of an array of labels."""
    return F.array_min(F.transform(labels, lambda x: rank(x, table)))
