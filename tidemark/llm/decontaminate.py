"""Benchmark decontamination: spaced seeds find places, a verified overlap around them decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, in_bitmap, query, saved, table, unused
from tidemark.llm.tokens import LOWER, WordHashes, hashed, signed, slices, windows, within

# Fixed masks: 1 counts, 0 is ignored. A hit needs the words at the ones only. k changed words cut a stretch of
# n >= 5k words into k + 1 runs, so one run has four words unless n <= 4k + 3. From 13 words on that leaves three
# changes in 15 words, in runs of three, which the second mask meets. Shorter items have to match as a whole; what the
# two masks miss of them has masks of its own, looked for only if there are items of that length.
MASKS = ("1111", "1110111")
SHORT_MASKS = {5: ("11101", "11011", "10111"), 6: ("111011", "110111"), 10: ("1110110111",)}
SPAN = max(map(len, (*MASKS, *(m for short in SHORT_MASKS.values() for m in short))))
MIN_WORDS = 5
MIN_OVERLAP = 13
SIMILARITY = 0.8
MARK_BITS = 1 << 27
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def normal_words(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.translate(LOWER, PUNCTUATION).split()


def seeds(words: np.ndarray, ends: np.ndarray, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all masked windows, and of those for items of each length in ``short``."""
    found = []
    for mask in (*MASKS, *(m for n in short for m in SHORT_MASKS.get(n, ()))):
        h = windows(words, tuple(i for i, c in enumerate(mask) if c == "1"), int(mask, 2))
        starts = np.arange(len(h))
        inside = within(ends, starts, len(mask))
        found.append((h[inside], starts[inside]))
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, words``: distinct word sequences of at least ``MIN_WORDS``, each under its smallest id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part, texts in slices(batch):
                words = [signed(hashed([normal_words(t)], known)[0]) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").cast(pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"]
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        read, "item_id long, words array<long>"
    )
    return rows.where(F.size("words") >= MIN_WORDS).groupBy("words").agg(F.min("item_id").alias("item_id"))


def item_seeds(items: DataFrame) -> DataFrame:
    """``hash, item_id, place``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                array = np.array(words, np.int64).view(np.uint64)
                h, at = seeds(array, np.array([0, len(array)]), (len(array),))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), pa.array([item] * len(h), pa.int64()), pa.array(at.astype(np.int32))],
                    ["hash", "item_id", "place"],
                )

    return items.mapInArrow(cut, "hash long, item_id long, place int")


def marked_parts(docs: DataFrame, marks: np.ndarray, short: tuple[int, ...], margin: int) -> DataFrame:
    """``doc_id, part, words, hashes, places``: the stretches of documents around seeds that are in the bitmap.

    Hits closer than twice the margin share a part; a part reaches ``margin``
    words beyond them, the length of the longest item, so that no overlap is cut.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in slices(batch):
                words, ends = hashed([normal_words(t) for t in texts], known)
                h, at = seeds(words, ends, short)
                hit = in_bitmap(sent.value, h)
                h, at = h[hit], at[hit]
                if not len(h):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                text = np.searchsorted(ends, at, "right") - 1
                first = np.flatnonzero(np.r_[True, (np.diff(at) > 2 * margin) | (np.diff(text) > 0)])
                last = np.r_[first[1:], len(at)]
                ids = part.column("doc_id").to_pylist()
                rows = []
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    of = int(text[a])
                    low = max(int(ends[of]), int(at[a]) - margin)
                    high = min(int(ends[of + 1]), int(at[b - 1]) + SPAN + margin)
                    rows.append((ids[of], number, int(low - ends[of]), signed(words[low:high]), signed(h[a:b]), (at[a:b] - low).astype(np.int32)))
                    number += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "part", "begins", "words", "hashes", "places"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, part long, begins long, words array<long>, hashes array<long>, places array<int>"
    )


def longest_overlap(a: np.ndarray, b: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int]:
    """On one diagonal (a[i] beside b[i - shift]): start in a, length and equal words of the longest stretch of which
    ``similarity`` are equal; of several, the first with most equal words. Length 0 if there is none.
    """
    low, high = max(0, shift), min(len(a), len(b) + shift)
    equal = np.r_[0, np.cumsum(a[low:high] == b[low - shift : high - shift])]
    # A stretch qualifies if its sum of (equal - similarity) is not below 0, but for rounding.
    total = equal - similarity * np.arange(len(equal))
    lowest = np.minimum.accumulate(total)
    start = np.minimum(np.searchsorted(-lowest, -(total + 1e-9)), np.arange(len(equal)))
    length = np.arange(len(equal)) - start
    same = equal - equal[start]
    end = int(np.lexsort((-same, -length))[0])
    return low + int(start[end]), int(length[end]), int(same[end])


def overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY, mark_bits: int = MARK_BITS) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id, item_id, doc_start, length, equal``.

    An overlap is a stretch of ``min_overlap`` words or more (or the whole item,
    if shorter), word beside word, of which ``similarity`` are equal. Words are
    compared without punctuation and case. Items of equal words count once, under
    the smallest id; items under ``MIN_WORDS`` words are no evidence and are left
    out. With the default thresholds, or stricter ones, every overlap has a seed.

    The training side meets the test side first as a bitmap of fixed size, so
    only stretches that hit it leave the scan; the join with the test hashes is
    exact. A larger benchmark fills the bitmap and costs more rows in the join,
    never results. Null texts, and empty tables, have no overlaps. Repeated rows
    of a document give one row; lengths are those of the longest overlap.
    """
    items = saved(items_of(benchmark), "items")
    tests = saved(item_seeds(items), "item-seeds")
    longest = items.agg(F.max(F.size("words"))).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    short = tuple(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n").isin(*SHORT_MASKS)).distinct().collect())
    parts = saved(marked_parts(docs, bitmap(tests.select("hash"), mark_bits), short, longest), "parts")
    hits = parts.select("part", F.explode(F.arrays_zip("hashes", "places")).alias("hit"))
    on_diagonal = (
        hits.join(tests, F.col("hit.hashes") == F.col("hash"))
        .select("part", "item_id", (F.col("hit.places") - F.col("place")).alias("shift"))
        .distinct()
    )
    beside = on_diagonal.join(parts.select("doc_id", "part", "begins", F.col("words").alias("doc_words")), "part").join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                doc, item = (np.asarray(batch.column(c)[r].values) for c in ("doc_words", "words"))
                start, length, equal = longest_overlap(doc, item, batch.column("shift")[r].as_py(), similarity)
                if length >= min(min_overlap, len(item)):
                    rows.append((batch.column("doc_id")[r].as_py(), batch.column("item_id")[r].as_py(), batch.column("begins")[r].as_py() + start, length, equal))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "doc_start", "length", "equal"])

    found = beside.select("doc_id", "item_id", "begins", "shift", "doc_words", "words").mapInArrow(verify, RESULT)
    best = F.max(F.struct("length", "equal", (-F.col("doc_start")).alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("doc_start"), "best.length", "best.equal"
    )


RESULT = "doc_id long, item_id long, doc_start long, length long, equal long"


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item; all columns stay. Rows go by their text, whatever shares their id."""
    (leak,) = unused(docs, "leak")
    row = F.xxhash64(F.lit("row"), "text")
    leaks = overlaps(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, row == F.col(leak), "left_anti")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verified overlaps of documents with benchmark items."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
