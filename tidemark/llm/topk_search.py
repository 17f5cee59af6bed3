"""Exact top-k by inner product: an impact-ordered index, read score at a time until a proof stops it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table

SCALE = 256
TOP = 5
QUERY_STEP = 50
# Rows of a shard, of a stored piece of it, queries of a block: they bound a task's memory, whatever the input.
SHARD_ROWS, PIECE_ROWS, BLOCK_QUERIES = 1 << 16, 1024, 64
# Impacts are kept as so many levels; bounds are tried after every few of them.
LEVELS, TRIED_EVERY = 16, 4
# As soon as no more rows than this can be among the best, they are rescored.
MEMBERS = 64
# A vector with a component beyond this takes no part: a sum of products would not fit 64 bits.
LARGEST = 1 << 24
NO_ID = np.iinfo(np.int64).min

VECTORS, NORMS, SEGMENT, QUERIES_KIND = range(4)
STORED = pa.schema(
    [("shard", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("dim", pa.int32()), ("impact", pa.int64()), ("ids", pa.binary()), ("body", pa.binary())]
)
STORED_TYPE = "shard long, kind int, seq long, dim int, impact long, ids binary, body binary"
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_TYPE = "query_row long, query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` with components floor(256 * x); vectors that are null or hold null, non-finite or huge components are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE <= LARGEST))
    whole = F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))
    return rows.where(F.col("x").isNotNull() & sound).select("vec_id", whole.alias("v"))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and padded vectors of at most ``size`` rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def matrix() -> tuple[np.ndarray, np.ndarray]:
        width = max(1, *(int(n.max(initial=0)) for _, n, _ in held))
        ids = np.concatenate([i for i, _, _ in held])
        out = np.zeros((len(ids), width), np.int32)
        out[np.arange(width) < np.concatenate([n for _, n, _ in held])[:, None]] = np.concatenate([v for _, _, v in held])
        return ids, out

    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(at, PIECE_ROWS)
            ids, lists = part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), part.column("v")
            at_part = 0
            while at_part < part.num_rows:
                take = min(size - rows, part.num_rows - at_part)
                some = lists.slice(at_part, take)
                lengths = np.diff(some.offsets.to_numpy())
                held.append((ids[at_part : at_part + take], lengths, some.flatten().to_numpy(zero_copy_only=False)))
                rows, at_part = rows + take, at_part + take
                if rows == size:
                    yield matrix()
                    held, rows = [], 0
    if rows:
        yield matrix()


def _stored(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STORED.types, strict=True)], schema=STORED)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: the vectors in pieces, posting segments by falling impact, and what each level leaves of every vector's norm."""
    part = TaskContext.get().partitionId()
    for k, (ids, v) in enumerate(_gathered(batches, SHARD_ROWS)):
        shard = part << 24 | k
        for seq, at in enumerate(range(0, len(ids), PIECE_ROWS)):
            yield _stored([(shard, VECTORS, seq, v.shape[1], 0, ids[at : at + PIECE_ROWS].tobytes(), v[at : at + PIECE_ROWS].tobytes())])
        width = int(np.abs(v).max(initial=0)) // LEVELS + 1
        level = np.abs(v) // width
        rest, seq = v.astype(np.float64), 0
        for step in range(LEVELS - 1, 0, -1):
            impact = step * width + width // 2
            segments = []
            for sign in (1, -1):
                row, dim = np.nonzero((level == step) & (np.sign(v) == sign))
                order = np.argsort(dim, kind="stable")
                cuts = np.searchsorted(dim[order], np.arange(v.shape[1] + 1))
                rest[row, dim] -= sign * impact
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    own = np.sort(row[order[cuts[d] : cuts[d + 1]]]).astype(np.int32)
                    segments.append((shard, SEGMENT, seq, d, sign * impact, own.tobytes(), b""))
                    seq += 1
            segments.append((shard, NORMS, LEVELS - 1 - step, 0, seq, b"", np.sqrt((rest * rest).sum(1)).tobytes()))
            yield _stored(segments)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, (ids, v) in enumerate(_gathered(batches, BLOCK_QUERIES)):
        yield _stored([(0, QUERIES_KIND, part << 24 | k, v.shape[1], 0, ids.tobytes(), v.tobytes())])


class Shard:
    """One shard as it is read: vectors, posting segments by falling impact, norms of the rests."""

    def __init__(self) -> None:
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.segments: list[tuple[int, int, np.ndarray]] = []
        self.stops: list[tuple[int, np.ndarray]] = []

    def add(self, kind: int, dim: int, impact: int, ids: bytes, body: bytes) -> None:
        if kind == VECTORS:
            self.pieces.append((np.frombuffer(ids, np.int64), np.frombuffer(body, np.int32).reshape(-1, dim)))
        elif kind == NORMS:
            self.stops.append((impact, np.frombuffer(body, np.float64)))
        else:
            self.segments.append((dim, impact, np.frombuffer(ids, np.int32)))

    def close(self) -> None:
        self.ids = np.concatenate([i for i, _ in self.pieces])
        self.v = np.concatenate([v for _, v in self.pieces]).astype(np.int64)
        self.pieces = []

    def best(self, asked: np.ndarray, q: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place in the block, and ids and scores of its ``top`` rows in this shard.

        Segments add a query's weight times their impact to all their rows. What
        they leave out of a row is at most the query's norm times the norm of the
        rest of its vector. Once few rows can reach the ``top``-th best lower
        bound, or all segments are read, those rows are scored exactly: no other
        row can be among the best.
        """
        width = max(q.shape[1], self.v.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1]))).astype(np.int64)
        v = np.pad(self.v, ((0, 0), (0, width - self.v.shape[1]))) if width > self.v.shape[1] else self.v
        active, sums, at = np.arange(len(q)), np.zeros((len(v), len(q)), np.int64), 0
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        for k, (until, rests) in enumerate(self.stops):
            weights = q[active]
            for dim, impact, rows in self.segments[at:until]:
                sums[rows] += weights[:, dim] * impact
            at, last = until, k + 1 == len(self.stops)
            if not last and (k + 1) % TRIED_EVERY:
                continue
            slack = rests[:, None] * norm[active] * (1 + 1e-9) + np.abs(sums) * 1e-12 + 1
            low, high = sums - slack, sums + slack
            own = self.ids[:, None] == asked[active]
            low[own] = high[own] = -np.inf
            kth = np.partition(low, -top, axis=0)[-top] if len(v) > top else np.full(len(active), -np.inf)
            can = (high >= kth) & ~own
            done = last | (can.sum(0) <= max(MEMBERS, top))
            for j in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(can[:, j])
                scores, ids = v[rows] @ q[active[j]], self.ids[rows]
                order = np.lexsort((ids, ids == NO_ID, -scores))[:top]
                yield int(active[j]), ids[order], scores[order]
            active, sums = active[~done], sums[:, ~done]
            if not len(active):
                return


def _searched(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shard come in order: its vectors, norms, segments, then one block of queries after another."""
    now, shard, closed = None, Shard(), False
    for batch in batches:
        out: list[tuple] = []
        for row in range(batch.num_rows):
            at, kind, seq, dim, impact, ids, body = (c[row].as_py() for c in batch.columns)
            if at != now:
                now, shard, closed = at, Shard(), False
            if kind != QUERIES_KIND:
                shard.add(kind, dim, impact, ids, body)
                continue
            if not closed:
                shard.close()
                closed = True
            asked = np.frombuffer(ids, np.int64)
            for j, found, scores in shard.best(asked, np.frombuffer(body, np.int32).reshape(-1, dim), top):
                name = seq * BLOCK_QUERIES + j
                out.extend((name, int(asked[j]), None if f == NO_ID else f, s) for f, s in zip(found.tolist(), scores.tolist(), strict=True))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.types, strict=True)], schema=FOUND)


def index(vectors: DataFrame) -> DataFrame:
    """The stored index of ``vec_id, v`` rows: every row is in one shard of at most ``SHARD_ROWS``."""
    return saved(vectors.mapInArrow(_indexed, STORED_TYPE), "topk-index")


def top_k(stored: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the rows with the largest inner products for each query row (``vec_id, v``).

    Ties go to the smaller vec_id, null last. Rows that have the query's vec_id
    are its own and left out; a repeated query row is answered each time, a
    repeated row found each time. Missing components count as 0.

    Blocks of queries are sent to each shard, and a task reads one shard and
    then block after block. A query's best of each shard are few rows, cut
    again by rank before they are shuffled.
    """
    shards = stored.agg(F.array_sort(F.collect_set("shard")).alias("s")).scalar()
    blocks = saved(queries.mapInArrow(_blocks, STORED_TYPE), "topk-queries")
    sent = blocks.withColumn("shard", F.explode(shards)).select(*stored.columns)
    # a number of its own, so that small shards are not put into one task
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored.unionByName(sent).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "seq")
    found = dealt.mapInArrow(lambda batches: _searched(batches, top), FOUND_TYPE)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS row FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, q.row, c.vec_id,
        coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)::BIGINT)), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id, row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op13_topk_search", SQL)
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all rows for every row whose id is divisible by 50."""
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(index(vectors), vectors.where(F.col("vec_id") % QUERY_STEP == 0))
