"""Source files that are no valid text of their language."""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_chunks
from .grammars import parser
from .lexers import LexError, fast_go, fast_js, lex_go, lex_js

# Extensions of the languages.
EXTENSIONS = {"go": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx"}
LANGUAGES = ("go", "typescript", "tsx", "javascript", "jsx")
#: Calls of rules inside each other (some 15 a level of nesting), at first and at most; the latter need about 1 GB.
FRAMES, MOST_FRAMES = 50_000, 3_000_000
_MARKER = re.compile(r"(?m)^[ \t]*(?:<{7}|={7}|>{7}|\|{7})(?:[ \t].*)?$")
_CUT = re.compile(r"(?i)^\s*(?:\[truncated\b|<snip\b|\.\.\.\s*\d+\s+more\b)")


@dataclass(frozen=True)
class Failure:
    """Where and why a text does not parse: offset in code points, the token found there, and the cause."""

    at: int
    found: str
    cause: str


def _lex(source: str, language: str) -> tuple:
    return lex_go(source) if language == "go" else lex_js(source, language in ("tsx", "jsx"))


def parses(source: str, language: str) -> bool:
    try:
        kinds, texts, newlines, _, partner = _lex(source, language)
    except LexError:
        return False
    return parser(language, False)(kinds, texts, newlines, partner)[0] >= 0


def check(source: str, language: str, explain: bool = True) -> Failure | None:
    """None if ``source`` is a text of ``language`` from its first to its last token, else its furthest failure.

    Without ``explain`` place and cause of a failure are left open, which saves a second parse. Rules call each other as
    deep as the text nests; the room for that is doubled until it suffices. Only a text that nests so deep that
    MOST_FRAMES do not (some 200,000 levels; compilers give up long before) counts as one that does not parse, with the cause too_deep.
    """
    limit = FRAMES
    while True:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), limit))
        try:
            return _check(source, language, explain)
        except RecursionError:
            if limit >= MOST_FRAMES:
                return Failure(0, "", "too_deep")
            limit = min(limit * 4, MOST_FRAMES)


def _check(source: str, language: str, explain: bool) -> Failure | None:
    try:
        jsx = language in ("tsx", "jsx")
        quick = fast_go(source) if language == "go" else fast_js(source, jsx) or lex_js(source, jsx, fast=True)
        if quick and parser(language, False)(*quick[:3], quick[-1])[0] >= 0:
            return None
    except LexError:
        pass
    if not explain:
        return None if parses(source, language) else Failure(0, "", "")
    try:
        kinds, texts, newlines, starts, partner = _lex(source, language)
    except LexError as e:
        return Failure(e.at, source[e.at : e.at + 1], _cause(source, language, e.at, e.cause))
    if parser(language, False)(kinds, texts, newlines, partner)[0] >= 0:
        return None
    _, far = parser(language, True)(kinds, texts, newlines, partner)
    far = min(far, len(starts) - 1)
    return Failure(starts[far], kinds[far], _cause(source, language, starts[far], "unexpected end" if kinds[far] == "EOF" else "unexpected token"))


def _cause(source: str, language: str, at: int, plain: str) -> str:
    """What damaged the text: conflict_marker, cut_notice, truncated, wrong_language, else the plain cause."""
    line = source.rfind("\n", 0, at) + 1
    before = source.rfind("\n", 0, max(0, line - 1)) + 1
    end = source.find("\n", at)
    here = source[line : end if end >= 0 else len(source)]
    if _MARKER.search(here) or _MARKER.search(source[before:line]):
        return "conflict_marker"
    if _CUT.match(here):
        return "cut_notice"
    if plain == "unexpected end" or (plain.startswith("unterminated") and end < 0):
        return "truncated"
    for other in LANGUAGES:
        if other != language and (other != "jsx" or language != "javascript") and parses(source, other):
            return "wrong_language"
    return "other_language_or_form" if not source[:at].strip() else plain.replace(" ", "_")


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        gc.disable()  # a parse leaves no cycles; collecting would only walk the tables of lines again and again
        try:
            ok = [check(source, language, explain=False) is None for source, language in zip(b["source"], b["language"])]
        finally:
            gc.enable()
        yield pd.DataFrame({"id": b["id"], "repo_id": b["repo_id"], "language": b["language"], "ok": ok})


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: dict[str, list] = {"ok": [], "fail_at": [], "fail_line": [], "fail_found": [], "cause": []}
        for source, language in zip(b["source"], b["language"]):
            f = check(source, language)
            out["ok"].append(f is None)
            out["fail_at"].append(None if f is None else f.at)
            out["fail_line"].append(None if f is None else source.count("\n", 0, f.at) + 1)
            out["fail_found"].append(None if f is None else f.found)
            out["cause"].append(None if f is None else f.cause)
        yield pd.DataFrame({"id": b["id"], "repo_id": b["repo_id"], "language": b["language"], **{k: pd.Series(v, dtype="Int64" if k in ("fail_at", "fail_line") else object, index=b.index) for k, v in out.items()}})


def spread(df: DataFrame) -> DataFrame:
    """More partitions where a scan has too few for work that is mostly computing."""
    want = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if input_chunks(df) >= want else df.repartition(want)


def effective_language() -> F.Column:
    """``language``, or where it is null that of the path's extension."""
    ext = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z]+)$", 1))
    by_path = F.coalesce(*[F.when(ext == e, F.lit(v)) for e, v in EXTENSIONS.items()])
    return F.coalesce(F.lower(F.trim("language")), by_path)


def parse_files(files: DataFrame, explain: bool = True) -> DataFrame:
    """One row for each row of ``files`` whose language has a grammar: id, repo_id, language, ok, fail_at, fail_line, fail_found, cause.

    A file is ok if a packrat parse by the grammar of its language consumes it whole; else the furthest failure (offset
    in code points, line from 1, kind of the token found) and its cause are given. Null sources and other languages give
    no row; an empty source is a valid JavaScript or TypeScript text and no valid Go text; repeated rows give repeated
    rows. Extra columns are ignored. Without ``explain`` the columns after ok are left out. Each row is parsed where it is read: nothing is gathered by key.
    """
    todo = files.select("id", "repo_id", effective_language().alias("language"), "source").where(F.col("source").isNotNull() & F.col("language").isin(*LANGUAGES))
    schema = "id long, repo_id string, language string, ok boolean"
    if not explain:
        return spread(todo).mapInPandas(_verdicts, schema)
    return spread(todo).mapInPandas(_checked, f"{schema}, fail_at long, fail_line long, fail_found string, cause string")


def failing_files(files: DataFrame, explain: bool = True) -> DataFrame:
    """One row for each id that does not parse."""
    return parse_files(files, explain).where(~F.col("ok")).dropDuplicates(["id"])


def failure_rates(files: DataFrame) -> DataFrame:
    """Rates for each repository and language: files, failed, failure_rate; each id counts once."""
    once = parse_files(files, explain=False).groupBy("id").agg(F.first("repo_id").alias("repo_id"), F.first("language").alias("language"), F.bool_and("ok").alias("ok"))
    return once.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg((~F.col("ok")).cast("double")), 6).alias("failure_rate"))
