"""Encoding of texts by a byte-level BPE vocabulary, shared prefixes of distinct words being encoded once."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse_check import spread

#: Default place of the vocabulary files; they are never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept from one batch to the next; beyond it the table starts anew.
KEEP_WORDS = 400_000
#: Characters of one trie; larger batches make several.
TRIE_CHARS = 8_000_000


class PrefixEncoder:
    """Encodes words in order of their bytes, which is a depth-first walk of the trie of these words.

    The state of a trie node is the last token of the encoding of its prefix. The encoding of a prefix is that of a
    shorter prefix and one token more, so the states along the path give the encoding of each word; the states of the
    prefix that a word shares with the one before it are kept, not computed again. A token can be the last one if its
    bytes end the prefix and it stays apart from the last token of the rest when the two are merged by rank.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Encoding by merging the adjacent pair of least rank again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _apart(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            known = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[key] = known
        return known

    def _whole(self, t: int) -> bool:
        known = self.alone.get(t)
        if known is None:
            known = self.merge(self.bytes_of[t]) == [t]
            self.alone[t] = known
        return known

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of ``words``, which must be in ascending order."""
        ranks, longest, last, before = self.ranks, self.longest, [0], b""
        for w in words:
            n, shared, most = len(w), 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for begin in range(max(0, end - longest), end):
                    t = ranks.get(w[begin:end])
                    if t is not None and (self._apart(last[begin], t) if begin else self._whole(t)):
                        last.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out, end = [], n
            while end:
                out.append(last[end])
                end -= len(self.bytes_of[last[end]])
            out.reverse()
            before = w
            yield out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODERS: dict[str, tuple[PrefixEncoder, dict[str, list[int]]]] = {}


def encode_texts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[list[int]]:
    """Ids of each text, without special tokens; text that looks like one is plain text. Null and empty texts: []."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = (PrefixEncoder(load_ranks(vocabulary)), {})
    encoder, known = _ENCODERS[vocabulary]
    split = regex.compile(PATTERN).findall
    pieces = [split(t) if t else [] for t in texts]
    new = {w for p in pieces for w in p}
    if len(known) > KEEP_WORDS:
        known.clear()
    if len(encoder.pairs) > 4 * KEEP_WORDS:
        encoder.pairs.clear()
    todo = sorted((w.encode("utf-8"), w) for w in new if w not in known)
    for (_, w), ids in zip(todo, encoder.encode_sorted([b for b, _ in todo])):
        known[w] = ids
    out = []
    for p in pieces:
        ids: list[int] = []
        for w in p:
            ids += known[w]
        out.append(ids)
    return out


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= TRIE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` and ids (array<int>) of each row: the encoding of ``text`` by the vocabulary file.

    Distinct words of a batch form one trie where the rows are read; nothing is shuffled or broadcast, whatever the
    number of distinct words. Null and empty texts have the empty list; very long texts and runs are encoded whole;
    repeated rows give repeated rows; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            ids = [x for part in _chunks(texts) for x in encode_texts(part, vocabulary)]
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(carry))], lists], names=[*carry, "ids"])

    todo = spread(documents.select(*carry, text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema[: len(carry)])
    return todo.mapInArrow(run, f"{schema}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and n_tokens of each row."""
    return encode(documents, vocabulary, carry).withColumn("n_tokens", F.size("ids").cast("long")).drop("ids")
