"""Scalar functions on text, as columns of built-in functions wherever these can express them."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Offset basis and prime of 64-bit FNV-1a, and the bytes put between parts.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SEPARATOR_KEY, SEPARATOR_FINGERPRINT = 0xFE, 0xFF


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def contains_any_folded(c: Column, values: list[str]) -> Column:
    """Whether the text holds one of ``values``, without regard to ASCII case. False for an empty list; null text gives null."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(ascii_lower(c), F.lit(v.translate(str.maketrans(UPPER, LOWER))))
    return out


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def dirname(c: Column) -> Column:
    """The path up to its last slash; empty for a bare name."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def last_segment(c: Column, separator: str = ".") -> Column:
    return F.element_at(F.split(c, re.escape(separator)), -1)


def capture_between(c: Column, prefix: str, infix: str) -> Column:
    """The one path segment between ``prefix`` and ``infix``; null if the text has no such form."""
    pattern = f"^{re.escape(prefix)}([^/]+){re.escape(infix)}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def import_package_name(c: Column) -> Column:
    """The npm package of an import path: its first segment, or the first two of a scoped one."""
    return F.when(c.startswith("@"), F.regexp_extract(c, r"^(@[^/]+/[^/]+|@[^/]*)", 1)).otherwise(F.regexp_extract(c, r"^([^/]*)", 1))


def unquote(c: Column) -> Column:
    """A string literal without its quotes; escapes of quotes and backslashes are undone in interpreted strings."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    plain = F.regexp_replace(inner, r"\\([\"'\\\\])", "$1")
    first = F.substring(c, 1, 1)
    return F.when(F.length(c) < 2, c).when(first == "`", inner).when(first.isin('"', "'"), plain).otherwise(c)


def escape_annotation(c: Column) -> Column:
    """Percent signs and line ends as %25, %0D and %0A."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def line_count(c: Column) -> Column:
    """Lines of a text: one more than its line ends if anything follows the last of them; 0 for an empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when(c.endswith("\n"), 0).otherwise(1)).cast("long")


def non_empty_line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"[\t\r\f ]+", ""))) > 0)).cast("long")


def span_lines(start: Column, end: Column) -> Column:
    """Lines from ``start`` to ``end``, both counted; 0 if the end lies before the start."""
    return F.when(end < start, 0).otherwise(end - start + 1)


def words(c: Column) -> Column:
    """The distinct identifier words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))


@F.pandas_udf(T.LongType())
def byte_offset(line: pd.Series, column: pd.Series) -> pd.Series:
    """The byte offset in UTF-8 of a column counted in code points from 1; a column beyond the end gives the length."""
    return pd.Series([None if x is None or pd.isna(c) else len(x[: max(0, int(c) - 1)].encode("utf-8")) for x, c in zip(line, column)], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_top_level(text: pd.Series) -> pd.Series:
    """Parts between commas outside brackets and quotes, trimmed; empty parts are kept, an empty text has none."""
    return text.map(lambda t: None if t is None else _split_top_level(t))


def _split_top_level(t: str) -> list[str]:
    if not t.strip():
        return []
    parts, depth, quote, now, skip = [], 0, "", [], False
    for ch in t:
        if skip:
            skip = False
        elif quote:
            skip = ch == "\\" and quote != "`"
            quote = "" if ch == quote else quote
        elif ch in "\"'`":
            quote = ch
        elif ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth = max(0, depth - 1)
        elif ch == "," and not depth:
            parts.append("".join(now).strip())
            now = []
            continue
        now.append(ch)
    return [*parts, "".join(now).strip()]


def fnv64(parts: list[str | None], separator: int) -> str:
    """16 hex digits of FNV-1a over the parts, each followed by the separator byte; a null part counts as empty."""
    h = FNV_BASIS
    for p in parts:
        for b in (p or "").encode("utf-8"):
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        h = ((h ^ separator) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def _fnv_many(rows: list[bytes]) -> list[str]:
    """FNV-1a of many byte strings at once, one numpy step for each byte position."""
    if not rows:
        return []
    length = np.array([len(r) for r in rows])
    order = np.argsort(-length, kind="stable")
    h = np.full(len(rows), FNV_BASIS, np.uint64)
    data = np.zeros((len(rows), int(length.max())), np.uint8)
    for i, r in enumerate(rows):
        data[i, : len(r)] = np.frombuffer(r, np.uint8)
    sizes = -np.sort(-length)
    data = data[order]
    prime = np.uint64(FNV_PRIME)
    with np.errstate(over="ignore"):
        for j in range(data.shape[1]):
            n = int(np.searchsorted(-sizes, -j, side="left"))
            h[:n] = (h[:n] ^ data[:n, j]) * prime
    out = np.empty(len(rows), object)
    out[order] = [f"{int(x):016x}" for x in h]
    return list(out)


@cache
def _fnv_udf(separator: int):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def run(parts: pd.Series) -> pd.Series:
        end = bytes([separator])
        return pd.Series(_fnv_many([b"".join((p or "").encode("utf-8") + end for p in x) for x in parts]), index=parts.index, dtype=object)

    return run


def fingerprint(*parts: Column) -> Column:
    return _fnv_udf(SEPARATOR_FINGERPRINT)(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def stable_key(*parts: Column) -> Column:
    return _fnv_udf(SEPARATOR_KEY)(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def salted_fingerprint(base: Column, occurrence: Column) -> Column:
    """The fingerprint of the n-th occurrence: the base itself for n = 0."""
    return F.when(occurrence == 0, base).otherwise(fingerprint(base, occurrence))
