"""Language-model scoring: a log-frequency Bloom filter of n-gram counts, broadcast and probed level by level."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table
from tidemark.llm.tokens import Powers, mixed, signed, slices, word_hashes

BLOCK_BITS = 1 << 18
BITS_PER_TOKEN = 4
PROBES = 4
WEIGHT = 0.25
MAX_BROADCAST = 256 << 20
# Text that a worker holds as arrays at a time: while it counts, and while it also holds a share.
COUNTED_BYTES, PROBED_BYTES = 2 << 20, 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
PAIR, LEVEL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
UNI, BI = np.uint64(1), np.uint64(2)


def training(doc_id: Column | str) -> Column:
    """All but a seventh, by crc32 of the id as text (null: empty)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 != 2


def sequences(texts: list[bytes], known: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by the end token, and where each begins (one more: the end)."""
    words, ends = word_hashes([t.lower() for t in texts], known)
    return np.insert(words, ends[1:], END), ends + np.arange(len(ends))


def grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token and of each token with the one before; a text's first token follows the end token."""
    before = np.r_[END, tokens[:-1]] if len(tokens) else tokens
    return mixed(tokens * PAIR + UNI), mixed(mixed(before * PAIR + BI) + tokens * LEVEL)


def token_counts(train: DataFrame) -> DataFrame:
    """``token, n``: exact counts, added up in each slice, each task, then by shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for _, texts in slices(batch, max_bytes=COUNTED_BYTES):
                tokens, n = np.unique(sequences(texts, known)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(n)], ["token", "n"])

    return train.select("text").mapInArrow(scan, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def spots(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    """Bit within the block for one of the probes of a level."""
    h = mixed(keys + np.uint64(level * int(LEVEL) % (1 << 64)))
    return (h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(BLOCK_BITS - 1)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return keys >> np.uint64(64 - blocks.bit_length() + 1) if blocks > 1 else np.zeros(len(keys), np.uint64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2(n))."""
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def filter_blocks(train: DataFrame, blocks: int) -> DataFrame:
    """``block, bits``: the Bloom filter, a power of two of blocks, each built by the task that gets its n-grams.

    A slice of the corpus sends one row a block, with the keys and counts that
    fall into it, so the shuffle carries distinct n-grams of slices in packed
    form. In a block the counts are added, and a key of level q is entered as
    (key, 1) to (key, q). A frequent n-gram is one entry a slice.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for _, texts in slices(batch, max_bytes=COUNTED_BYTES):
                keys, n = np.unique(np.concatenate(grams(sequences(texts, known)[0])), return_counts=True)
                block, first = np.unique(block_of(keys, blocks), return_index=True)
                last = np.r_[first[1:], len(keys)]
                n = n.astype(np.uint32)
                pieces = [(keys[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int64)), pa.array([k for k, _ in pieces], pa.binary()), pa.array([c for _, c in pieces], pa.binary())],
                    ["block", "keys", "counts"],
                )

    def build(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32)
        keys, at = np.unique(keys, return_inverse=True)
        level = levels_of(np.bincount(at, weights=counts))
        bits = np.zeros(BLOCK_BITS, bool)
        for j in range(1, int(level.max()) + 1):
            reach = keys[level >= j]
            for probe in range(PROBES):
                bits[spots(reach, j, probe)] = True
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    packed = train.select("text").mapInArrow(scan, "block long, keys binary, counts binary")
    return packed.groupBy("block").applyInArrow(build, "block long, bits binary")


class Filter:
    """Some blocks of the filter, from ``first`` on, in memory."""

    def __init__(self, bits: np.ndarray, first: int, blocks: int):
        self.bits, self.first, self.blocks = bits, first, blocks

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, found by asking for one level after another; 0 for keys of other blocks."""
        out = np.zeros(len(keys), np.uint8)
        block = block_of(keys, self.blocks).astype(np.int64) - self.first
        here = np.flatnonzero((block >= 0) & (block < len(self.bits) * 8 // BLOCK_BITS))
        level = 0
        while len(here):
            level += 1
            for probe in range(PROBES):
                spot = spots(keys[here], level, probe).astype(np.int64) + block[here] * BLOCK_BITS
                here = here[(self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0]
            out[here] = level
        return out


def blocks_for(tokens: int) -> int:
    """Blocks, a power of two, that give the n-grams of so many tokens a few bits each."""
    return 1 << max(0, math.ceil(math.log2(max(1, tokens * BITS_PER_TOKEN / BLOCK_BITS))))


def chunk_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over each text; every text has a token at least."""
    return np.add.reduceat(values, ends[:-1]) if len(ends) > 1 else values[:0]


def expected(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: 1, then the geometric middle of [2^(q-1), 2^q)."""
    return np.where(levels > 1, np.exp2(levels.astype(float) - 0.5), levels)


def log_probabilities(single: np.ndarray, pair: np.ndarray, ends: np.ndarray, total: int, distinct: int, weight: float) -> np.ndarray:
    """log10 of each token's probability: the pair's share of its first token, mixed with the token's own add-one share."""
    alone = (expected(single) + 1) / (total + distinct + 1)
    first = np.zeros(len(single), bool)
    first[ends[:-1]] = True
    last = np.repeat(ends[1:] - 1, np.diff(ends))
    context = expected(np.where(first, single[last], np.r_[single[:1], single[:-1]]))
    seen = np.minimum(expected(pair), context) / np.maximum(context, 1)
    return np.log10(np.where(context > 0, weight * seen + (1 - weight) * alone, alone))


def score(docs: DataFrame, weight: float = WEIGHT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Training documents are those of ``training``; their n-grams go into the
    filter whole. Exact token counts (for the base score) and filter are read by
    shares of at most ``max_broadcast`` bytes, one scan of the texts a share:
    base sums add up, and the levels found so far travel with the text. So what
    a worker holds is bounded, while counts and filter grow with the corpus.
    The filter never misses a count; it raises a level with a chance of a few in
    a hundred. A null text is empty and has the end token only; a null id counts
    as empty text for the choice of training rows. Repeated rows score alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = rows.where(training("doc_id"))
    counts = saved(token_counts(train), "token-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    blocks = blocks_for(total)
    bloom = saved(filter_blocks(train, blocks), "filter")
    shares = max(1, -(-distinct * 16 // max_broadcast), -(-blocks * BLOCK_BITS // 8 // max_broadcast))
    per = -(-blocks // shares)
    unit = math.log10(total + distinct + 1)
    state = rows.select("*", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("logs"), F.lit(b"").alias("levels"))
    for share in range(shares):
        mine = counts.where(F.pmod("token", F.lit(shares)) == share).toArrow()
        token = mine.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        bits = np.zeros(per * BLOCK_BITS // 8, np.uint8)
        size = BLOCK_BITS // 8
        for block, found in bloom.where(F.col("block").between(share * per, share * per + per - 1)).toLocalIterator():
            bits[(block - share * per) * size : (block - share * per + 1) * size] = np.frombuffer(found, np.uint8)
        sent = spark.sparkContext.broadcast((token[order], mine.column("n").to_numpy()[order], bits, share * per))
        state = state.mapInArrow(
            probing(sent, blocks, total, distinct, weight),
            "doc_id long, text string, n_known long, logs double, levels binary, n_tokens long, score double",
        )
        if share < shares - 1:
            state = saved(state.drop("n_tokens", "score"), "levels")
    return state.select(
        "doc_id",
        (~training("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * unit).alias("base_score"),
        "score",
    )


def probing(sent, blocks: int, total: int, distinct: int, weight: float):
    """Adds one share of counts and filter to what the rows carry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        token, n, bits, first = sent.value
        bloom = Filter(bits, first, blocks)
        for batch in batches:
            for part, texts in slices(batch, max_bytes=PROBED_BYTES):
                tokens, ends = sequences(texts, known)
                each, at = np.unique(tokens, return_inverse=True)
                place = np.minimum(np.searchsorted(token, each), max(0, len(token) - 1))
                count = np.where(token[place] == each, n[place], 0) if len(token) else np.zeros(len(each), np.int64)
                keys, where = np.unique(np.concatenate(grams(tokens)), return_inverse=True)
                found = bloom.levels(keys)[where].reshape(2, -1)
                before = part.column("levels").to_pylist()
                if any(before):
                    earlier = [np.frombuffer(b, np.uint8).reshape(2, -1) for b in before]
                    found = np.maximum(found, np.concatenate(earlier, axis=1))
                logs = log_probabilities(found[0], found[1], ends, total, distinct, weight)
                levels = [found[:, a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text"),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64)[at], ends[:-1]) + part.column("n_known").to_numpy()),
                        pa.array(np.add.reduceat(np.log10(count + 1.0)[at], ends[:-1]) + part.column("logs").to_numpy()),
                        pa.array(levels, pa.binary()),
                        pa.array(np.diff(ends)),
                        pa.array(np.add.reduceat(logs, ends[:-1])),
                    ],
                    ["doc_id", "text", "n_known", "logs", "levels", "n_tokens", "score"],
                )

    return scan


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of each document."""
    return score(table(spark, sf_dir, "documents"))
