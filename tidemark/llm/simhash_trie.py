"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join of their binary trie."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table, text_key, unused
from tidemark.llm.graph import components
from tidemark.llm.tokens import slices

SHINGLE = 3
MAX_DIFFERENT = 2
MIN_DEPTH, DEEPER = 6, 6
NODE_SIZE, MAX_GROUP = 1 << 15, 1 << 17
FRONTIER = 1 << 18
DIRECT_PAIRS = 64
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words; of all words if they are fewer; none without a word."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [hashed(joined, 42)]
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return [hashed(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes. Eight counters of a byte run in each word, 255 hashes at a time."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    blocks = np.zeros((-(-len(h) // 255), 255), np.uint64)
    blocks.ravel()[: len(h)] = h
    counts = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = ((blocks >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long), and what ``key`` names of ``text_key``; without a word fp is zero."""
    names = ["doc_id", *key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                fp = np.fromiter((majority(shingle_hashes(t, shingle)) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(text_key()[c].alias(c) for c in key), "text")
    return rows.mapInArrow(scan, ", ".join(f"{c} long" for c in (*names, "fp")))


class Forest:
    """Union-find over array positions, joined many links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.root(u), self.root(v)
            apart = u != v
            u, v = np.minimum(u, v)[apart], np.maximum(u, v)[apart]
            np.minimum.at(self.parent, v, u)


def trie_links(values: np.ndarray, left: tuple[int, int], right: tuple[int, int], depth: int, budget: int, forest: Forest) -> None:
    """Joins in ``forest`` all positions whose values differ in at most ``budget`` bits in all.

    ``values`` are sorted; ``left`` and ``right`` are the ranges of two trie
    nodes at ``depth``, or the same one twice. Pairs of nodes go down together:
    equal bits keep the errors, different ones add one, and a pair over the
    budget or without leaves is pruned. Small pairs are compared leaf by leaf.
    The frontier goes depth first in bounded pieces.
    """
    spent = int(values[left[0]] >> np.uint64(64 - depth) ^ values[right[0]] >> np.uint64(64 - depth)).bit_count() if depth else 0
    first = np.array([[*left, *right, spent]], np.int64)
    stack = [(depth, first)]
    while stack:
        depth, pairs = stack.pop()
        al, ah, bl, bh, err = pairs.T
        small = (ah - al) * (bh - bl) <= DIRECT_PAIRS if depth < 64 else np.ones(len(pairs), bool)
        if small.any():
            compare(values, pairs[small], budget, forest)
            al, ah, bl, bh, err = pairs[~small].T
        if not len(al):
            continue
        bit = np.uint64(63 - depth)
        am, bm = (np.searchsorted(values, ((values[x] >> bit) | np.uint64(1)) << bit) for x in (al, bl))
        same = al == bl
        children = np.concatenate(
            [
                np.stack([al, am, bl, bm, err], 1),
                np.stack([am, ah, bm, bh, err], 1),
                np.stack([al, am, bm, bh, err + 1], 1),
                np.stack([am, ah, bl, bm, err + 1], 1)[~same],
            ]
        )
        children = children[
            (children[:, 4] <= budget) & (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
        ]
        for k in range(0, len(children), FRONTIER):
            stack.append((depth + 1, children[k : k + FRONTIER]))


def compare(values: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Leaf by leaf."""
    al, ah, bl, bh, _ = pairs.T
    wide = bh - bl
    count = (ah - al) * wide
    of = np.repeat(np.arange(len(pairs)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    i, j = al[of] + k // wide[of], bl[of] + k % wide[of]
    near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
    forest.join(i[near], j[near])


def flips(depth: int, budget: int) -> list[int]:
    """All patterns of ``depth`` bits with at most ``budget`` set."""
    return [sum(1 << b for b in bits) for k in range(budget + 1) for bits in itertools.combinations(range(depth), k)]


def node(fp: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def split(rows: DataFrame, depth: int, deeper: int, budget: int) -> DataFrame:
    """Rows (a, b, fp) of node pairs, carried ``deeper`` levels down to all pairs within the budget.

    ``fp`` lies below node a or b; the partner's side of its own path may differ
    by as many more bits as are left.
    """
    to = depth + deeper
    own = node("fp", to)
    mine = F.col("a") == node("fp", depth)
    other = F.when(mine, F.col("b")).otherwise(F.col("a"))
    left = F.lit(budget) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    choices = F.element_at(F.array(*(F.array(*(F.lit(x) for x in flips(deeper, k))) for k in range(budget + 1))), left + 1)
    path = F.col("fp_own").bitwiseAND((1 << deeper) - 1)
    partner = F.shiftleft(F.col("other"), deeper).bitwiseOR(path.bitwiseXOR(F.col("flip")))
    moved = rows.select("fp", own.alias("fp_own"), other.alias("other"), F.explode(choices.cast("array<bigint>")).alias("flip"))
    return moved.select(F.least("fp_own", partner).alias("a"), F.greatest("fp_own", partner).alias("b"), "fp")


def solve(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links (u, v) that span what each node pair connects; at most one for each of its values."""

    def walk(group: pa.Table) -> pa.Table:
        values = np.unique(group.column("fp").to_numpy().view(np.uint64))
        nodes = values >> np.uint64(64 - depth)
        cut = int(np.searchsorted(nodes, nodes[0], "right"))
        low, high = (0, cut), (cut, len(values))
        forest = Forest(len(values))
        paired = group.column("a")[0].as_py() != group.column("b")[0].as_py()
        if not paired:
            trie_links(values, low, low, depth, budget, forest)
        elif cut < len(values):
            trie_links(values, low, high, depth, budget, forest)
        root = forest.root(np.arange(len(values)))
        tied = root != np.arange(len(values))
        v = values.view(np.int64)
        return pa.table({"u": v[tied], "v": v[root[tied]]})

    return rows.groupBy("a", "b").applyInArrow(walk, "u long, v long")


def links(distinct: DataFrame, budget: int = MAX_DIFFERENT, node_size: int = NODE_SIZE, max_group: int = MAX_GROUP) -> DataFrame:
    """Spanning links between fingerprints (column ``fp``, all different) within ``budget`` bits.

    The top of the trie is walked by Spark: every value takes part in the pairs
    of nodes, ``depth`` levels down, that are within the budget of each other;
    the rest of the walk is a task for each pair. Depth follows the number of
    values. Pairs that still hold more than ``max_group`` values, a dense cloud
    of near copies, go down further levels, and only they.
    """
    n = distinct.count()
    depth = max(MIN_DEPTH, math.ceil(math.log2(max(1, n / node_size))))
    zero = F.lit(0).cast("long")
    rows = split(distinct.select(zero.alias("a"), zero.alias("b"), "fp"), 0, depth, budget)
    out = None
    crowded = distinct.groupBy(node("fp", depth).alias("node")).count().where(F.col("count") > max_group // 2)
    while depth <= 64 - DEEPER and not crowded.isEmpty():
        heavy = saved(rows.groupBy("a", "b").count().where(F.col("count") > max_group).select("a", "b"), "heavy")
        done = solve(rows.join(heavy, ["a", "b"], "left_anti"), depth, budget)
        out = done if out is None else out.unionByName(done)
        rows = saved(split(rows.join(heavy, ["a", "b"], "left_semi"), depth, DEEPER, budget), "nodes")
        depth += DEEPER
        crowded = rows.groupBy("a", "b").count().where(F.col("count") > max_group)
    done = solve(rows, depth, budget)
    return done if out is None else out.unionByName(done)


def rooted(docs: DataFrame, budget: int, shingle: int, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` and ``key`` of the documents, and ``fp, first, root`` of their different fingerprints: the least id and what links lead to."""
    found = saved(fingerprints(docs, shingle, key), "fingerprints")
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tied = components(links(distinct.select("fp"), budget))
    joined = distinct.join(tied, F.col("fp") == F.col("node"), "left")
    return found, saved(joined.select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")


def near_duplicates(
    docs: DataFrame, budget: int = MAX_DIFFERENT, shingle: int = SHINGLE, key: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, fp, component_id``, and ``key``: the smallest doc_id that links within ``budget`` bits lead to.

    Equal fingerprints become one node before the join, so a group of copies of
    any size is one value. Null, empty and blank texts have fingerprint zero and
    are linked like others. Rows that share a doc_id keep their own fingerprints;
    a null doc_id never names a component unless all ids in it are null.
    """
    found, roots = rooted(docs, budget, shingle, key)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id", *key)


def linked_texts(docs: DataFrame, budget: int = MAX_DIFFERENT, shingle: int = SHINGLE) -> DataFrame:
    """``h, g, root`` of the different texts; links within ``budget`` bits lead from each to its root."""
    found, roots = rooted(docs, budget, shingle, tuple(text_key()))
    return found.select("h", "g", "fp").distinct().join(roots, "fp").select("h", "g", "root")


def one_of_each(docs: DataFrame, budget: int = MAX_DIFFERENT, shingle: int = SHINGLE) -> DataFrame:
    """The documents with the smallest id of their component; all columns stay.

    Rows that share a doc_id, or have none, are told apart by their text: each
    goes or stays by its own component. Documents with null ids stay only if
    their component has no other id.
    """
    of, h, g = unused(docs, "gone", "h_gone", "g_gone")
    key = text_key()
    known = near_duplicates(docs, budget, shingle, tuple(key))
    others = known.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    others = others.select(F.col("doc_id").alias(of), F.col("h").alias(h), F.col("g").alias(g)).distinct()
    same = (key["h"] == F.col(h)) & (key["g"] == F.col(g)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of))
    return docs.join(others, same, "left_anti")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")
