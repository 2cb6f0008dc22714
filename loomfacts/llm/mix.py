"""Mixing sources to target weights: exact quotas, capped repeats, shards of the same composition."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, maybe_broadcast
from .encode import VOCABULARY, token_counts

#: log2 of the children of a node in the search for the place where a source's partial pass ends.
STEP_BITS = 10
#: Bits of the place of a text in the random order of its source.
PLACE_BITS = 50
#: Blocks into which each pass over a source is cut.
BLOCKS = 256


@dataclass(frozen=True)
class Quota:
    """Use of a source: whole passes, then a partial pass over the texts placed before ``stop``."""

    tokens: int
    passes: int
    rest: int


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, Quota]:
    """Tokens to take of each source.

    Without ``total`` the mix is the largest one in which every available source has exactly its share of all tokens
    and no text is used more often than allowed. With ``total`` a source that cannot reach its share gives all it may.
    Targets of sources that do not occur, or may not be used, cannot be reached; the others keep their proportions.
    """
    usable = {s: (w, m) for s, (w, m) in targets.items() if w > 0 and m > 0 and sizes.get(s, 0) > 0}
    weight = sum(w for w, _ in usable.values())
    if not usable:
        return {}
    reach = min(m * sizes[s] * weight / w for s, (w, m) in usable.items())
    goal = reach if total is None else total
    out = {}
    for s, (w, m) in usable.items():
        tokens = min(int(goal * w / weight), m * sizes[s])
        out[s] = Quota(tokens, tokens // sizes[s], tokens % sizes[s])
    return out


def split_blocks(blocks: dict[str, int], shards: int, seed: int) -> list[dict[str, int]]:
    """Blocks of each source for each shard, by a tree that halves the shards.

    At each node the blocks of all its sources lie in one urn, of which the left half gets its part of the whole number,
    drawn without replacement: the numbers by source are one draw of the multivariate hypergeometric distribution. No
    block is lost or used twice, the shards have equally many blocks (up to one), and what a shard holds of each source
    is as random as a shuffle of all blocks would make it.
    """
    rng = np.random.default_rng(seed)
    names = sorted(blocks)
    out: list[dict[str, int]] = [{} for _ in range(shards)]

    def deal(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = {s: int(n) for s, n in zip(names, have)}
            return
        mid = (lo + hi) // 2
        draws = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, draws, method="marginals")
        deal(lo, mid, left)
        deal(mid, hi, have - left)

    deal(0, shards, np.array([blocks[s] for s in names], np.int64))
    return out


def _place(seed: int) -> Column:
    """Place of a text in the random order of its source: PLACE_BITS bits of a hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - PLACE_BITS)


def _stops(sized: DataFrame, rests: dict[str, int]) -> dict[str, int]:
    """For each source the least place before which texts of at least its rest of tokens lie.

    The search goes down a tree of hash ranges: each level sums the tokens of 2**STEP_BITS children of one node a
    source, so the driver gets at most that many rows a source, whatever the number of texts.
    """
    low = dict.fromkeys(rests, 0)
    need = dict(rests)
    for depth in range(STEP_BITS, PLACE_BITS + 1, STEP_BITS):
        open_ = {s for s in rests if need[s] > 0}
        if not open_:
            break
        width = PLACE_BITS - depth
        inside = F.lit(False)
        for s in open_:
            inside = inside | ((F.col("source") == s) & (F.col("place") >= low[s]) & (F.col("place") < low[s] + (1 << (width + STEP_BITS))))
        sums = sized.where(inside).groupBy("source", F.shiftright("place", width).alias("node")).agg(F.sum("n_tokens").alias("n")).collect()
        by: dict[str, list[tuple[int, int]]] = {s: [] for s in open_}
        for r in sums:
            by[r["source"]].append((r["node"], r["n"]))
        for s, nodes in by.items():
            for node, n in sorted(nodes):
                if need[s] <= n:
                    low[s] = node << width
                    break
                need[s] -= n
    return {s: low[s] + 1 if rests[s] > 0 else 0 for s in rests}


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int = 16, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: doc_id, source, copy (from 1), n_tokens, shard, position (order within the shard). Report: one row for each
    source of ``targets`` with target_share, max_repeats, available_tokens, mixed_tokens, mixed_texts, reached_share.

    A text counts once however many documents repeat it (the one whose source allows the fewest repeats, then of the
    least id, stands for it), so no text is used more than its source's ``max_repeats`` times. Shares are reached up to
    one text a source. Null, empty and unlisted texts or sources, and targets of zero, are not used; a null share or
    repeat counts as zero. An empty table gives an empty mix and shares of zero. Texts of one source, however large,
    stay spread: they are only summed, compared with a place, and dealt to shards by block.
    """
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).collect() if r["source"] is not None}
    spark = documents.sparkSession
    chosen = documents.select("doc_id", "source", "text").where(F.col("source").isin(sorted(wanted)) & (F.length("text") > 0)) if wanted else documents.select("doc_id", "source", "text").limit(0)
    counted = token_counts(chosen.withColumn("h", F.md5("text")), vocabulary, ("doc_id", "source", "h"))
    order = F.coalesce(*[F.when(F.col("source") == s, F.lit(m)) for s, (_, m) in wanted.items()], F.lit(0)) if wanted else F.lit(0)
    sized = materialise(
        counted.groupBy("h").agg(F.min(F.struct(order.alias("m"), "doc_id", "source", "n_tokens")).alias("x")).select("x.doc_id", "x.source", "x.n_tokens").where("n_tokens > 0").withColumn("place", _place(seed)),
        "sized",
    )
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a target
    plan = quotas(sizes, wanted, total)
    stops = _stops(sized, {s: q.rest for s, q in plan.items()})
    passes = F.coalesce(*[F.when(F.col("source") == s, F.lit(q.passes) + (F.col("place") < stops[s]).cast("int")) for s, q in plan.items()], F.lit(0)) if plan else F.lit(0)
    copies = sized.withColumn("copies", passes).where("copies > 0").select("doc_id", "source", "n_tokens", "place", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

    # Blocks: hash ranges of a pass over a source, in random order; the partial pass has blocks of its own, as wide as its range.
    rng = random.Random(seed)
    dealt: list[tuple[str, int, int, int]] = []
    names = sorted(plan)
    order_of = {s: rng.sample([(c, b) for c in range(1, plan[s].passes + 2) for b in range(BLOCKS) if c <= plan[s].passes or plan[s].rest > 0], k=BLOCKS * (plan[s].passes + (plan[s].rest > 0))) for s in names}
    at = dict.fromkeys(names, 0)
    for shard, have in enumerate(split_blocks({s: len(order_of[s]) for s in names}, shards, seed)):
        for s, n in have.items():
            dealt += [(s, c, b, shard) for c, b in order_of[s][at[s] : at[s] + n]]
            at[s] += n
    shards_of = spark.createDataFrame(dealt, "source string, copy int, block int, shard int")
    block = F.coalesce(*[F.when(F.col("source") == s, F.when(F.col("copy") <= q.passes, F.shiftright(F.col("place"), PLACE_BITS - BLOCKS.bit_length() + 1)).otherwise(F.floor(F.col("place") * F.lit(BLOCKS / max(1, stops[s]))))) for s, q in plan.items()], F.lit(0)) if plan else F.lit(0)
    placed = copies.withColumn("block", F.least(block.cast("int"), F.lit(BLOCKS - 1))).join(maybe_broadcast(shards_of), ["source", "copy", "block"])
    mixed = placed.select("doc_id", "source", "copy", "n_tokens", "shard", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("position"))

    sums = copies.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_texts"))
    listed = spark.createDataFrame([(s, w, m, sizes.get(s, 0)) for s, (w, m) in sorted(wanted.items())], "source string, target_share double, max_repeats int, available_tokens long")
    whole = copies.agg(F.sum("n_tokens")).first()[0] or 0
    report = listed.join(sums, "source", "left").na.fill(0, ["mixed_tokens", "mixed_texts"]).withColumn("reached_share", F.round(F.col("mixed_tokens") / F.lit(max(1, whole)), 6))
    return mixed, report


def write_shards(mixed: DataFrame, documents: DataFrame, path: str) -> None:
    """Writes the mix with its texts, one folder a shard, each file in random order."""
    full = mixed.join(documents.select("doc_id", "text"), "doc_id")
    full.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
