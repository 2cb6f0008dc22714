"""Source files that nobody wrote by hand in their repository: generated, minified, third-party and data files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, maybe_broadcast
from .parse_check import spread

#: Tokens of a k-gram, k-grams of a window: a run of GRAM + WINDOW - 1 equal tokens always shares a fingerprint.
GRAM, WINDOW = 24, 24
#: The same for the stream with names and literals normalized, where short runs recur by chance in code written by hand.
NAMELESS_GRAM, NAMELESS_WINDOW = 64, 32
#: How far back a name is told from others: a renamed run of LOOK_BACK tokens more than that always shares a fingerprint.
LOOK_BACK = 64
#: Least tokens for the whole stream of a file with few fingerprints to be one: `package main` recurs everywhere.
WHOLE_TOKENS = 12
#: A fingerprint recurs widely if it occurs in this many repositories, not all of one owner.
MIN_REPOS = 3
#: Share of a file's fingerprints that must recur widely, and their least number, for the file to be a vendored copy.
MIN_SHARE, MIN_PRINTS = 0.8, 3
#: Share of a file that must be literal data, and its least size in characters, for the file to be a data dump.
DATA_SHARE, DATA_CHARS = 0.8, 500
#: Code characters a line, and share of white space, of minified code.
MINIFIED_LINE, MINIFIED_SPACE = 120, 0.08
#: Share of the 6-grams without digits that repeat, and the least number of statements, in code written by a program.
REPEAT_SHARE, REPEAT_LINES = 0.75, 6

# Directories and file names by which tools and package managers put files.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|external|third_party|third-party|3rdparty|bower_components|node_modules|Godeps|deps)/")
_GENERATED_PATH = re.compile(r"(?:^|/)__generated__/|(?:\.(?:gen|generated|pb|g)|_gen|_generated|\.pb\.gw)\.[A-Za-z]+$|(?:^|/)zz_generated")
_MINIFIED_PATH = re.compile(r"[.-](?:min|bundle)\.[cm]?js$")
# How the head of a file says that a program wrote it. Each must begin a line of the leading comments.
_GENERATED_HEAD = re.compile(
    r"""(?im)^[\W_]*(?:
    code\ generated\b | auto[- ]?generated\b | @generated\b | <auto-?generated
    | (?:this|the)\ (?:file|code|source)\ (?:was|is|has\ been)\ (?:automatically\ |auto-?)?(?:generated|produced|created\ by\ a\ tool)
    | (?:automatically\ )?generated\ (?:by|from|with|using)\b | do\ not\ (?:edit|modify)\b(?!\ locally) | built\ by\ .{1,80}(?:manual\ edits|overwritten)
    | (?:diese\ datei|dieser\ code)\b.{0,40}(?:automatisch\ |maschinell\ )?(?:erzeugt|generiert)
    | (?:ce\ fichier|ce\ code)\b.{0,40}(?:g[ée]n[ée]r[ée])
    | (?:este\ archivo|este\ fichero|este\ arquivo|este\ c[óo]digo)\b.{0,40}(?:generado|gerado)
    | .{0,30}(?:自動生成|自动生成|自動的に生成)
    )""",
    re.X,
)
_COPIED_HEAD = re.compile(r"(?im)^[\W_]*(?:copied|vendored|imported|taken|forked)\ from\ \S+\ (?:v|version\ )?\d")
_LIBRARY_HEAD = re.compile(r"(?im)^[\W_]*(?:@license\s+(?!SPDX)(?P<a>[\w@/.-]+)\s+v?\d|(?P<b>[\w@/.-]+)\s+v?\d+\.\d+(?:\.\d+)*\s*(?:\||$|-))")
_HOLDER = re.compile(r"(?i)(?:copyright|\(c\)|©)[\s(c)©]*(?:\d{4}(?:\s*[-–,]\s*(?:\d{4}|present))*,?\s*)?(?:by\s+)?(?P<name>[^\n.|<(]*[^\W\d_][^\n.|<(]*)")

_CODE = re.compile(r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\W\d]\w*|\d[\w.]*|[^\s\w])""")
_CODE_WITHOUT_BLOCKS = re.compile(_CODE.pattern.replace(r"/\*(?:[^*]|\*(?!/))*\*/|", ""))
_TOKEN = re.compile(r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*(?:`|\Z)|[^\W\d]\w*|\d[\w.]*|[^\s\w]""")
_HIDDEN = re.compile(r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*(?:`|\Z))""")
_NUMBERED = re.compile(r"[A-Za-z_]\d")
_DIGITS = re.compile(r"\d+")
_KEY = re.compile(r"""(?:"[^"\n]*"|[A-Za-z_]\w*)\s*:(?![:=])""")
_DATUM = re.compile(r"""(?:[\s\[\]{}(),;+\-&]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[+-]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|\b(?:true|false|null|nil|undefined)\b)+""")


_LEADING = re.compile(r"\s*(?:#![^\n]*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[\"']use strict[\"'];?)")


def leading_comments(source: str) -> str:
    """The comments before the first token of code, without what opens them; directive strings do not end them."""
    at, out = 0, []
    text = source.lstrip("\ufeff")
    while True:
        m = _LEADING.match(text, at)
        if not m:
            return "\n".join(out)
        out.append(m.group().strip())
        at = m.end()


def trailing_comments(source: str) -> str:
    """The comments after the last token of code, where tools put their notice now and then.

    A comment on the line of the last token is not one of them unless it is a block.
    """
    last = source.rstrip()
    if not last.endswith("*/") and not last[last.rfind("\n") + 1 :].lstrip().startswith("//"):
        return ""
    first = end = None  # the first comment after the last token, and the end of that token
    for m in _TOKEN.finditer(source):
        if not m.group().startswith(("//", "/*")):
            first, end = None, m.end()
        elif first is None and (m.group().startswith("/*") or end is None or "\n" in source[end : m.start()]):
            first = m.start()
    return source[first:] if first is not None else ""


def _plain(name: str) -> str:
    return re.sub(r"[^\w]+", " ", re.sub(r"(?i)\b(?:all rights reserved|inc|ltd|llc|gmbh|the)\b", " ", name)).strip().casefold()


def head_signals(source: str, owner: str | None) -> tuple[bool, bool]:
    """Whether the leading or trailing comments say that a program wrote the file, or that others than the owner did."""
    head = leading_comments(source) + "\n" + trailing_comments(source)
    if not head.strip():
        return False, False
    generated = bool(_GENERATED_HEAD.search(head))
    holders = [_plain(m["name"]) for m in _HOLDER.finditer(head)]
    own = _plain(owner) if owner else None
    if own is not None and any(h and own not in h and h not in own for h in holders):
        return generated, True
    foreign = bool(_COPIED_HEAD.search(head)) or bool(_LIBRARY_HEAD.search(head)) and not (own and any(own in h for h in holders))
    return generated, foreign


def code_tokens(source: str) -> list[str]:
    """The tokens without comments. A comment or string that is never closed is none: its tokens count."""
    closed = source.rfind("*/") + 2  # behind it no comment that opens is closed
    if closed < 2:
        return list(filter(None, _CODE_WITHOUT_BLOCKS.findall(source)))
    tokens, at = [], 0
    for m in _CODE.finditer(source, 0) if closed < len(source) and "/*" in source[closed:] else ():
        if m.start() >= closed:
            break
        at = m.end()
        if m[1]:
            tokens.append(m[1])
    else:
        if at == 0:
            return list(filter(None, _CODE.findall(source)))
    return tokens + list(filter(None, _CODE_WITHOUT_BLOCKS.findall(source, at)))


# Words of the languages, which are no names.
_WORDS = frozenset(
    "async await break case catch chan class const continue debugger default defer delete do else enum export extends fallthrough false finally for func function go goto if implements import in instanceof interface let map new nil null package private protected public range return select static struct super switch this throw true try type typeof undefined var void while with yield".split()
)
#: What a token is, in the two low bits of its code.
_NAME, _STRING, _DIGIT, _OTHER = range(4)


def _kind(t: str) -> int:
    c = t[0]
    return _STRING if c in "\"'`" else _DIGIT if c.isdigit() else _NAME if (c == "_" or c.isalpha()) and t not in _WORDS else _OTHER


class _Codes(dict):
    """A 32-bit code of each token above its kind."""

    def __missing__(self, t: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[t] = code = zlib.crc32(t.encode("utf-8", "replace")) << 2 | _kind(t)
        return code


class _PlainCodes(dict):
    """Codes of tokens without their digits, all strings being one."""

    def __missing__(self, t: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[t] = code = zlib.crc32((_DIGITS.sub("#", t) if t[0] not in "\"'`" else '"').encode("utf-8", "replace"))
        return code


_CODES, _PLAIN = _Codes(), _PlainCodes()


def is_minified(source: str) -> bool:
    """Code squeezed into long lines with hardly any white space."""
    if max(map(len, source.split("\n"))) <= MINIFIED_LINE:
        return False
    bare = _HIDDEN.sub(lambda m: '""' if m[1] else "", source)
    lines = [x for x in bare.split("\n") if x.strip()]
    code = "\n".join(x for x in lines if len(x) > MINIFIED_LINE)
    if len(code) < 300 or len(code) < 0.6 * sum(map(len, lines)):
        return False
    words = len(re.findall(r"[^\W\d]\w*", code))
    return sum(map(str.isspace, code)) / len(code) < MINIFIED_SPACE and words > len(code) / 40


class _Data(dict):
    """For each line of at most 200 characters whether it consists of literals only."""

    def __missing__(self, x: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[x] = is_data = bool(_DATUM.fullmatch(_KEY.sub(" ", x)))
        return is_data


_DATA = _Data()


def data_share(source: str) -> tuple[float, int]:
    """Share and number of the non-blank characters which belong to lines or strings of literals only."""
    total = data = 0
    for line in source.split("\n"):
        x = line.strip()
        n = len(x)
        if not n or x.startswith("//"):
            continue
        total += n
        if n <= 200:
            data += n * _DATA[x]
        elif _DATUM.fullmatch(_KEY.sub(" ", x)):
            data += n
        else:
            longest = max((m.group() for m in _DATUM.finditer(x)), key=len, default="")
            if longest.count(" ") <= 0.05 * len(longest) or sum(map(str.isdigit, longest)) >= 0.1 * len(longest):  # no prose
                data += len(longest)
    return (data / total if total else 0.0), data


def repeated_share(source: str, tokens: list[str]) -> tuple[float, int]:
    """Share of the 6-grams of tokens (without digits) that occur before in the same file, and the number of numbered names.

    Names may differ in their numbers only: a program that writes numbered declarations repeats itself from the second on.
    """
    if len(tokens) < 40:
        return 0.0, 0
    numbered = len(_NUMBERED.findall(source))
    if numbered < REPEAT_LINES:
        return 0.0, numbered
    codes = np.fromiter(map(_PLAIN.__getitem__, tokens), np.uint64, len(tokens))
    grams = sliding_window_view(codes, 6) @ (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 7, dtype=np.uint64))
    return 1 - len(np.unique(grams)) / len(grams), numbered


#: Which stream a fingerprint is of, in its two low bits.
EXACT, NAMELESS, WHOLE = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_DOT = zlib.crc32(b".") << 2 | _OTHER


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k codes from each place on, for all k-grams of the array: differences of prefix sums."""
    n = len(codes)
    powers = np.full(n, _BASE, np.uint64)
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes) * np.cumprod(powers))])
    return _mixed((sums[k:] - sums[:-k]) * np.cumprod(inverse)[: n - k + 1])


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours, by windows of doubled width."""
    width = 1
    while 2 * width <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == window else np.minimum(x[: len(x) - (window - width)], x[window - width :])


def _winnowed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, window: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Files and fingerprints of all files at once; file i has the codes from starts[i] to ends[i].

    A file with fewer k-grams than a window has the least of them.
    """
    none = np.empty(0, np.int64)
    if len(codes) < k:
        return none, none
    grams = _grams(codes, k)
    grams = grams & ~np.uint64(3) | np.uint64(kind)
    counts = np.maximum(ends - starts - k + 1, 0)
    files, prints = [], []
    few = np.flatnonzero((counts > 0) & (counts < window))
    if len(few):
        at = np.stack([starts[few], starts[few] + counts[few]], axis=1).ravel()
        files.append(few)
        prints.append(np.minimum.reduceat(np.append(grams, ~np.uint64(0)), at)[::2])
    if len(grams) >= window:
        low = _least(grams, window)
        many = np.flatnonzero(counts >= window)
        each = counts[many] - window + 1
        place = np.repeat(starts[many] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if len(many) else none
        owner, value = np.repeat(many, each), low[place]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        files.append(owner[new])
        prints.append(value[new])
    return (np.concatenate(files), np.concatenate(prints).view(np.int64)) if files else (none, none)


def _nameless(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes in which a name is the distance to its last place, if near, so that renaming does not change them.

    All strings are one and all numbers are one. Names after a dot are kept: members of libraries stay as they are when
    a copy is renamed.
    """
    kind = codes & np.uint64(3)
    member = np.zeros(len(codes), bool)
    member[1:] = codes[:-1] == _DOT
    names = np.flatnonzero((kind == _NAME) & ~member)
    key = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[names] << np.uint64(34) | codes[names]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at = names[order]
    back = np.zeros(len(codes), np.uint64)
    back[at[1:][same]] = (at[1:] - at[:-1])[same]
    back[back > LOOK_BACK] = 0
    out = np.where(kind == _OTHER, codes, kind)
    out[names] = back[names] << np.uint64(2)
    return np.where(member & (kind == _NAME), codes, out)


def fingerprints(token_lists: list[list[str]]) -> list[np.ndarray]:
    """For each file its distinct winnowed fingerprints, of the token stream as it stands and with names and literals normalized.

    A file with fewer than MIN_PRINTS of the first has the hash of its whole stream besides; one of fewer than
    WHOLE_TOKENS tokens has none at all. All files are worked on as one array.
    """
    sizes = np.array([len(t) if len(t) >= WHOLE_TOKENS else 0 for t in token_lists], np.int64)
    n = int(sizes.sum())
    if not n:
        return [np.empty(0, np.int64) for _ in token_lists]
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(t for t in token_lists if len(t) >= WHOLE_TOKENS)), np.uint64, n)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found = [_winnowed(codes, starts, ends, GRAM, WINDOW, EXACT), _winnowed(_nameless(codes, starts, sizes), starts, ends, NAMELESS_GRAM, NAMELESS_WINDOW, NAMELESS)]
    files, prints = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((prints, files))
    files, prints = files[order], prints[order]
    new = np.ones(len(files), bool)
    new[1:] = (files[1:] != files[:-1]) | (prints[1:] != prints[:-1])
    files, prints = files[new], prints[new]
    exact = np.bincount(files[prints & 3 == EXACT], minlength=len(sizes))
    short = np.flatnonzero((exact < MIN_PRINTS) & (sizes > 0))
    out = np.split(prints, np.searchsorted(files, np.arange(1, len(sizes))))
    if len(short):
        whole = _whole(codes, starts[sizes > 0], sizes)
        for i in short:
            out[i] = np.append(out[i], whole[i])
    return out


def _whole(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of the whole stream of each file."""
    there = sizes[sizes > 0]
    place = np.arange(len(codes)) - np.repeat(starts, there)
    powers = np.cumprod(np.full(int(there.max()), _BASE, np.uint64))
    sums = np.add.reduceat(_mixed(codes) * powers[place], starts) + there.astype(np.uint64)
    out = np.zeros(len(sizes), np.int64)
    out[sizes > 0] = (_mixed(sums) & ~np.uint64(3) | np.uint64(WHOLE)).view(np.int64)
    return out


def _signals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows, streams = [], []
        for i, repo, owner, path, source in zip(b["id"], b["repo_id"], b["owner"], b["relative_path"], b["source"]):
            path = path or ""
            generated, foreign = bool(_GENERATED_PATH.search(path)), bool(_VENDOR_DIR.search(path))
            minified, data, tokens = bool(_MINIFIED_PATH.search(path)), False, []
            if source:
                by_head = head_signals(source, owner)
                generated, foreign = generated or by_head[0], foreign or by_head[1]
                tokens = code_tokens(source)
                if not minified:
                    minified = is_minified(source)
                share, size = data_share(source)
                data = share >= DATA_SHARE and size >= DATA_CHARS
                if not generated and not data:
                    again, lines = repeated_share(source, tokens)
                    generated = again >= REPEAT_SHARE and lines >= REPEAT_LINES
            rows.append((i, repo, owner, generated, minified, foreign, data))
            streams.append(tokens)
        out = pd.DataFrame(rows, columns=["id", "repo_id", "owner", "generated", "minified", "third_party", "data"])
        out["prints"] = fingerprints(streams)
        yield out


def file_signals(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row for each row of ``files``: what path, head and text of the file itself say, and its fingerprints."""
    owners = repositories.select("repo_id", F.col("owner")).dropDuplicates(["repo_id"])
    todo = spread(files.select("id", "repo_id", "relative_path", "source")).join(maybe_broadcast(owners), "repo_id", "left")
    schema = "id long, repo_id string, owner string, generated boolean, minified boolean, third_party boolean, data boolean, prints array<long>"
    return todo.mapInPandas(_signals, schema)


def not_handwritten(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row for each id that is generated, minified, third_party or data: id, these four flags, copied and copied_share.

    The token stream of each file (no comments, no white space) is fingerprinted by winnowing, as it stands and with
    names and literals normalized. A fingerprint recurs widely if repositories of more than one owner and at least
    MIN_REPOS in all hold it; a file is a vendored copy if at least MIN_SHARE of its fingerprints of either stream do, or
    the hash of its whole stream where it is short. copied_share is the greatest of these shares, copied whether they
    suffice. Whatever is a file's own evidence (path, leading comments, squeezed code, literal data, numbered repetition)
    comes from the same pass over its tokens. Null sources are judged by their path; a repository without owner takes no
    copyright line as foreign; repeated rows count once; an empty table gives no rows; extra columns are ignored.

    Most fingerprints are held by one owner only. These are left out first, by the least and the greatest owner of each,
    which is aggregated before the shuffle, so that neither a fingerprint of very many files gathers in a task nor are
    the others moved again.
    """
    found = materialise(file_signals(files, repositories), "signals")
    prints = found.select("id", F.xxhash64("repo_id").alias("r"), F.when(F.col("owner").isNotNull(), F.xxhash64("owner")).alias("o"), F.explode("prints").alias("p"))
    shared = materialise(prints.groupBy("p").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where("lo <> hi").select("p"), "shared")
    mine = materialise(prints.select("id", "r", "p").join(maybe_broadcast(shared), "p", "left_semi"), "prints")
    wide = materialise(mine.select("p", "r").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= MIN_REPOS).select("p"), "wide")
    kinds = {"exact": EXACT, "nameless": NAMELESS, "whole": WHOLE}
    of_kind = lambda k: lambda p: p.bitwiseAND(F.lit(3)) == k
    hits = mine.join(maybe_broadcast(wide), "p", "left_semi").select("id", "p").distinct().groupBy("id").agg(*[F.count_if(of_kind(k)(F.col("p"))).alias(f"hits_{c}") for c, k in kinds.items()])
    flags = ["generated", "minified", "third_party", "data"]
    sizes = [F.max(F.size(F.filter("prints", of_kind(k)))).alias(f"n_{c}") for c, k in kinds.items()]
    each = found.groupBy("id").agg(*[F.bool_or(f).alias(f) for f in flags], *sizes)
    judged = each.join(hits, "id", "left")
    share = {c: F.when(F.col(f"n_{c}") > 0, F.coalesce(F.col(f"hits_{c}") / F.col(f"n_{c}"), F.lit(0.0))).otherwise(0.0) for c in kinds}
    copied = (share["whole"] >= 1) | ((F.col("n_exact") >= MIN_PRINTS) & (share["exact"] >= MIN_SHARE)) | ((F.col("n_nameless") >= MIN_PRINTS) & (share["nameless"] >= MIN_SHARE))
    judged = judged.withColumn("copied_share", F.round(F.greatest(*share.values()), 6)).withColumn("copied", copied)
    return judged.withColumn("third_party", F.col("third_party") | F.col("copied")).where("generated or minified or third_party or data").select("id", *flags, "copied", "copied_share")
