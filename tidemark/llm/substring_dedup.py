"""Substring deduplication: winnowed anchors seed repeats, which are extended both ways and removed but for the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, in_bitmap, query, saved, table
from tidemark.llm.tokens import BASE, Powers, mixed, signed, slices, windows, within, word_hashes

MIN_WORDS = 20
MARK_BITS = 1 << 28
STEP = np.uint64(BASE)
BACK = np.uint64(pow(BASE, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """Hashes of any range of words, from prefix sums: equal words give equal hashes wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(STEP, n)[:n], out=self.sums[1:])
        self.back = powers(BACK, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def first_windows(words: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, Ranges]:
    """Starts of all windows of ``length`` words, and whether each is the first of its words in its text."""
    starts = np.arange(max(0, len(words) - length + 1))
    starts = starts[within(ends, starts, length)]
    ranges = Ranges(words)
    text = np.searchsorted(ends, starts, "right").astype(np.uint64)
    first = np.zeros(len(starts), bool)
    first[np.unique(mixed(ranges.of(starts, starts + length) ^ text * STEP), return_index=True)[1]] = True
    return starts, first, ranges


def anchored(words: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Ranges]:
    """Runs of windows with the same anchor: anchor hash, its place, first and last window; and range hashes.

    A window's anchor is the smallest hash among its runs of half the length
    (the leftmost, if equal). It depends on the window's words only, so equal
    windows have equal anchors at the same place in them. Windows that repeat an
    earlier one of their own text are left out; each text settles them itself.
    """
    span = length // 2
    grams = windows(words, range(span))
    starts, fresh, ranges = first_windows(words, ends, length)
    starts = starts[fresh]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, ranges
    among = np.lib.stride_tricks.sliding_window_view(grams, length - span + 1)
    place = starts + among[starts].argmin(axis=1)
    new = np.r_[True, (np.diff(place) > 0) | (np.diff(starts) > 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return grams[place[first]], place[first], starts[first], starts[last], ranges


def read_words(batch: pa.RecordBatch, known: Powers) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, texts in slices(batch):
        yield part, *word_hashes(texts, known)


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Column ``anchor``: those found twice or more, counted in each task before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for _, words, ends in read_words(batch, known):
                anchors, n = np.unique(anchored(words, ends, length)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchors)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    counted = docs.select("text").mapInArrow(scan, "anchor long, n int")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("anchor")


def seeded_runs(docs: DataFrame, marks: np.ndarray, length: int) -> DataFrame:
    """Runs whose anchor is in the bitmap, with what extends them both ways.

    ``anchor``, ``extent`` (hash of all words of the run's windows, which settles
    where the anchor lies in them), ``n`` windows, and the place: ``doc_id,
    row`` (hash of the text), ``start``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for part, words, ends in read_words(batch, known):
                anchors, place, first, last, ranges = anchored(words, ends, length)
                hit = in_bitmap(sent.value, anchors)
                if not hit.any():
                    continue
                anchors, place, first, last = anchors[hit], place[hit], first[hit], last[hit]
                text = np.searchsorted(ends, first, "right") - 1
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchors)),
                        pa.array(signed(ranges.of(first, last + length))),
                        pa.array((last - first + 1).astype(np.int32)),
                        part.column("doc_id").take(take),
                        part.column("row").take(take),
                        pa.array((first - ends[text]).astype(np.int32)),
                    ],
                    ["anchor", "extent", "n", "doc_id", "row", "start"],
                )

    return docs.mapInArrow(scan, "anchor long, extent long, n int, doc_id long, row int, start int")


def windows_of(docs: DataFrame, marks: np.ndarray, length: int) -> DataFrame:
    """Each window of the runs whose ``row ^ anchor`` is in the bitmap: ``anchor, window`` (its hash) and the place."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for part, words, ends in read_words(batch, known):
                anchors, place, first, last, ranges = anchored(words, ends, length)
                text = np.searchsorted(ends, first, "right") - 1
                row = part.column("row").cast(pa.int64()).to_numpy().view(np.uint64)[text]
                hit = in_bitmap(sent.value, anchors ^ row)
                if not hit.any():
                    continue
                n = (last - first + 1)[hit]
                each = np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text = np.repeat(text[hit], n)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.repeat(anchors[hit], n))),
                        pa.array(signed(ranges.of(each, each + length))),
                        part.column("doc_id").take(take),
                        part.column("row").take(take),
                        pa.array((each - ends[text]).astype(np.int32)),
                    ],
                    ["anchor", "window", "doc_id", "row", "start"],
                )

    return docs.mapInArrow(scan, "anchor long, window long, doc_id long, row int, start int")


def not_first(first: str = "first") -> Column:
    place = F.col(first)
    return ~(
        F.col("doc_id").eqNullSafe(place.doc_id) & (F.col("start") == place.start) & (F.col("row") == place.row)
    )


def repeats(docs: DataFrame, length: int = MIN_WORDS, mark_bits: int = MARK_BITS) -> DataFrame:
    """``doc_id, row, begin, end``: word ranges all of whose windows start earlier, too.

    ``docs`` has ``doc_id, text`` and ``row``, a hash of the text that tells rows
    of one doc_id apart. Runs of one anchor that agree in their whole extent are
    a class; all but its first member repeat it whole, so one partial aggregate
    and a join on the class settle them, without pairs among copies. The first
    members of classes that share an anchor may agree in part; their windows are
    read from the texts and compared, again by the earliest of equal ones.

    The two bitmaps, of repeated anchors and of those first members, have a fixed
    size. More than they can tell apart let more runs through to the exact
    steps; results are the same.
    """
    marks = bitmap(repeated_anchors(docs, length), mark_bits)
    runs = saved(seeded_runs(docs, marks, length), "runs")
    same, place = ["anchor", "extent"], F.struct("doc_id", "start", "row")
    classes = saved(runs.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("size")), "classes")
    copies = (
        runs.select(*same, "n", "doc_id", "row", "start")
        .join(classes.where("size > 1").select(*same, "first"), same)
        .where(not_first())
        .select("doc_id", "row", F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).alias("end"))
    )
    shared = classes.groupBy("anchor").count().where("count > 1").select("anchor")
    leaders = classes.join(shared, "anchor", "left_semi").select(F.col("first.row").cast("long").bitwiseXOR(F.col("anchor")).alias("mark"))
    leaders = saved(windows_of(docs, bitmap(leaders, mark_bits), length), "leaders")
    key = ["anchor", "window"]
    earliest = leaders.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1")
    partly = (
        leaders.join(earliest.drop("size"), key)
        .where(not_first())
        .select("doc_id", "row", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    )
    return copies.unionByName(partly)


def without_repeats(docs: DataFrame, length: int = MIN_WORDS, mark_bits: int = MARK_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each document without the words of repeated passages.

    A word goes if a window of ``length`` words over it also starts earlier: in
    a document with a smaller id, or before it in the same one. Windows are
    those of the input. Kept words are joined by one space. Null and blank texts
    have no words; a null id counts as smaller than any. Rows that share an id
    but not the text are taken in the order of a hash of the text; rows equal in
    both are the same place and neither repeats the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("row"))
    gone = (
        repeats(rows, length, mark_bits)
        .groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row"))
        .agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    )
    gone = saved(gone, "gone")
    # texts that lose nothing to other texts need no join, so they are not shuffled
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("of", "of_row")), mark_bits))
    named = rows.withColumn("name", F.xxhash64("doc_id", "row"))

    def marked(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(sent.value, batch.column("name").to_numpy()) == wanted))

    hit = named.mapInArrow(lambda batches: marked(batches, True), named.schema)
    joined = hit.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for batch in batches:
            for part, texts in slices(batch):
                words, ends = word_hashes(texts, known)
                starts, first, _ = first_windows(words, ends, length)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, starts[~first], 1)
                np.add.at(depth, starts[~first] + length, -1)
                for at, begin, end in zip(ends.tolist(), part.column("begins").to_pylist(), part.column("ends").to_pylist(), strict=False):
                    if begin:
                        np.add.at(depth, np.array(begin) + at, 1)
                        np.add.at(depth, np.array(end) + at, -1)
                stays = np.cumsum(depth[:-1]) == 0
                kept, removed = [], []
                for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    left, of = np.flatnonzero(stays[a:b]), text.split()
                    removed.append(b - a - len(left))
                    kept.append(b" ".join([of[i] for i in left.tolist()] if removed[-1] else of))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "text"],
                )

    none = F.lit(None).cast("array<int>")
    kind = "doc_id long, n_words long, n_removed long, text string"
    met = joined.select("doc_id", "text", F.col("gone.begin").cast("array<int>").alias("begins"), F.col("gone.end").cast("array<int>").alias("ends"))
    rest = named.select("doc_id", "text", none.alias("begins"), none.alias("ends"), "name")
    return met.mapInArrow(cut, kind).unionByName(rest.mapInArrow(lambda batches: cut(marked(batches, False)), kind))


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)
), f AS (
    SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1
), g AS (
    SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) AS r(j)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1),
        lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op9_substring_dedup", SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, how many repeat, and a digest of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
