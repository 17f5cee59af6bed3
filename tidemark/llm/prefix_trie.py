"""Conversation prefix trie by ROLLUP: every shared beginning of conversations, counted once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, query, saved, table, words
from tidemark.operators.ordering import BUCKET, bucketed, row_numbers, running

# Turn columns of a block. A turn is copied once for each level of its block, so narrow blocks move fewer bytes.
WIDTH = 4
# Conversations of a family start with turns of the family's first one.
FAMILY, SHARED = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, place, h, g, words`` for each turn of each conversation, ``place`` counted from 1.

    Turns go by number (null first), then role, then text. A repeated row is a
    turn of its own. A null role or text is empty. Rows without a conv_id belong
    to no conversation and are left out. ``h, g`` are 128 bits of role and text.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("m"),
        F.xxhash64("role", "text").alias("h"),
        F.xxhash64("text", "role", F.lit(1)).alias("g"),
        F.size(words(F.col("text"))).alias("words"),
    )
    return row_numbers(narrow, ["conv_id"], ["turn", "role", "m"], "place").select("conv_id", "place", "h", "g", "words")


def family_starts(rows: DataFrame) -> DataFrame:
    """Each conversation with its start replaced by that of its family's first conversation.

    Conversation c takes the first h turns of conversation c - c % 20 in place of
    its own first h, h being crc32 of its number modulo 4. All of them if the
    other is shorter, none if it is absent. A conversation without turns keeps
    one row with ``place`` 0.
    """
    sizes = rows.groupBy("conv_id").agg(F.max("place").alias("n"))
    share = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    convs = sizes.select("conv_id", share.alias("share"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    first = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    taken = convs.join(first, "first", "left").withColumn("taken", F.least("share", F.coalesce("first_n", F.lit(0))))
    starts = rows.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "first")
    given = (
        taken.select("conv_id", "first", F.explode(F.sequence(F.lit(0), F.col("taken"))).alias("place"))
        .join(starts, ["first", "place"], "left")
        .select("conv_id", "place", "h", "g", "words")
    )
    own = rows.join(taken.select("conv_id", "share", "taken"), "conv_id").where(F.col("place") > F.col("share"))
    return given.unionByName(own.select("conv_id", (F.col("place") - F.col("share") + F.col("taken")).alias("place"), "h", "g", "words"))


def _salted(part: str, h: Column | str, g: Column | str, place: Column) -> Column:
    """What a turn at a place adds to the name of a node; names are the exclusive-or along the path."""
    return F.xxhash64(h, g, place.cast("long"), F.lit(part))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """``conv_id, block, a, b, before, t1..``: runs of ``width`` turns under the node that the run before ended in.

    ``a, b`` name that node by 128 bits, ``before`` counts the words up to it. Every
    conversation has a block 0, also without turns. The running values are taken
    over buckets of blocks, so that a conversation of any length is many tasks.
    """
    block = F.greatest(F.floor((F.col("place") - 1) / width), F.lit(0))
    rows = rows.select("*", block.alias("block"), *[F.when(F.col("place") > 0, _salted(p, "h", "g", F.col("place"))).alias(f"own_{p}") for p in "ab"])
    at = lambda i, c: F.max(F.when((F.col("place") - 1) % width == i, F.col(c))).alias(f"{c}{i + 1}")
    flat = rows.groupBy("conv_id", "block").agg(
        F.max("place").alias("last"),
        *[at(i, c) for i in range(width) for c in ("h", "g", "words")],
        *[F.coalesce(F.bit_xor(f"own_{p}"), F.lit(0)).alias(f"own_{p}") for p in "ab"],
        F.coalesce(F.sum("words"), F.lit(0)).alias("own_words"),
    )
    turn = lambda i: F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("h", "g", "words")])
    wide = flat.select(
        "conv_id",
        "block",
        "last",
        *[F.when(F.col(f"h{i}").isNotNull(), turn(i)).alias(f"t{i}") for i in range(1, width + 1)],
        "own_a",
        "own_b",
        "own_words",
    )
    folds = {p: (F.bit_xor, _xor, F.col(f"own_{p}")) for p in "ab"}
    folds["before"] = (F.sum, lambda x, y: x + y, F.col("own_words"))
    return running(saved(wide, "trie-blocks"), ["conv_id"], ["block"], folds).fillna(0, ["a", "b", "before"])


def rolled_up(rows: DataFrame, width: int, values: str) -> DataFrame:
    """One row per node: ``a, b`` its name, ``up_a, up_b`` its parent's, ``depth``, ``words`` of its last text, ``above`` of
    the texts before it, and the aggregates ``values``.

    One ROLLUP over the turn columns under the block's node; ``grouping_id`` tells the level. Level 0 is the node that
    the block before ended in, and counts only for the root.
    """
    turns = [f"t{i + 1}" for i in range(width)]
    groups = ["block", "a", "b", "before"]
    listed = ", ".join(turns)
    nodes = rows.sparkSession.sql(
        f"""SELECT {", ".join(groups)}, {listed}, {width} - bit_count(grouping_id()) AS level, {values}
            FROM {{rows}} GROUP BY {", ".join(groups)}, ROLLUP({listed})""",
        rows=rows,
    )
    last, name, above = F.lit(None).cast("struct<h:bigint,g:bigint,words:int>"), {p: F.col(p) for p in "ab"}, F.col("before")
    parent = dict(name)
    for i in range(width):
        reached, t = F.col("level") > i, F.col(f"t{i + 1}")
        place = F.col("block") * width + i + 1
        above = F.when(reached & last.isNotNull(), above + last["words"]).otherwise(above)
        last = F.when(reached, t).otherwise(last)
        parent = {p: F.when(reached, name[p]).otherwise(parent[p]) for p in "ab"}
        name = {p: F.when(reached & t.isNotNull(), _xor(name[p], _salted(p, t["h"], t["g"], place))).otherwise(name[p]) for p in "ab"}
    depth = F.col("block") * width + F.col("level")
    kept = nodes.where(((F.col("level") > 0) & last.isNotNull()) | ((F.col("level") == 0) & (F.col("block") == 0)))
    carried = [c for c in nodes.columns if c not in (*groups, *turns, "level")]
    return kept.select(
        *[name[p].alias(f"n{p}") for p in "ab"],
        *[F.when(F.col("level") > 0, parent[p]).alias(f"up_{p}") for p in "ab"],
        depth.cast("long").alias("depth"),
        F.coalesce(last["words"], F.lit(0)).cast("long").alias("words"),
        above.cast("long").alias("above"),
        *carried,
    ).withColumnsRenamed({"na": "a", "nb": "b"})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come one after another in order."""
    now, digest = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "piece")], strict=True):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"]
        )
    if now is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], ["a", "b", "ends_sha256"]
        )


def end_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of each node (``a, b``) in which conversations (``conv_id``) end.

    Numbers are joined bucket by bucket, so that a node with a third of all
    conversations is joined by many tasks; a digest is sequential by nature, so
    its task then reads that node's pieces in order, one at a time.
    """
    pieces = (
        bucketed(ends, ["a", "b"], ["conv_id"])
        .groupBy("a", "b", BUCKET)
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    )
    dealt = pieces.repartition("a", "b").sortWithinPartitions("a", "b", BUCKET).select("a", "b", "piece")
    return dealt.mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of ``conv_id, place, h, g, words`` rows (place 0: a conversation without turns).

    ``a, b, up_a, up_b, depth, conv_id, n_convs, n_leaves, saved_words``, and the digest ``ends_sha256`` of the
    conversations that end in the node (null: none).

    Both rollups fold values of conversations, never lists. The smallest member of
    a node stands for it, and stands for all deeper nodes on its path as well. So
    a conversation's words in nodes that others stand for are those it shares,
    and what a subtree saves is the sum of these over its members, less those
    before the node. A leaf counts for its smallest member.
    """
    wide = saved(blocks(conversations, width), "trie-paths")
    size = wide.groupBy("conv_id").agg(
        F.max("last").alias("n"), F.sum("own_words").alias("total"), *[F.bit_xor(f"own_{p}").alias(f"end_{p}") for p in "ab"]
    )
    size = saved(size, "trie-sizes")
    members = wide.join(size.select("conv_id", "n"), "conv_id")
    nodes = rolled_up(members, width, "min(conv_id) AS conv_id, max(n) AS deepest")
    stood = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("stood_words"), F.max((F.col("depth") == F.col("deepest")).cast("int")).alias("leaf")
    )
    valued = size.join(stood, "conv_id", "left").select(
        "conv_id", (F.col("total") - F.coalesce("stood_words", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    values = """min(conv_id) AS conv_id, min_by(shared, conv_id) AS least_shared, count(*) AS n_convs,
                sum(leaf) AS n_leaves, sum(shared) AS all_shared"""
    full = rolled_up(wide.join(valued, "conv_id"), width, values)
    spared = F.col("all_shared") - F.col("least_shared") - (F.col("n_convs") - 1) * F.col("above")
    ends = end_digests(size.select(F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id"))
    return full.select(
        "a", "b", "up_a", "up_b", "depth", "conv_id", "n_convs", "n_leaves", spared.alias("saved_words")
    ).join(ends, ["a", "b"], "left")


def with_kin(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id`` and ``n_children``."""
    kids = nodes.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(kids, ["a", "b"], "left")
        .join(parents, ["up_a", "up_b"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    )


SQL = rf"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS first, {crc32_sql("conv_id::VARCHAR")} % 4 AS share
    FROM (SELECT DISTINCT conv_id FROM t) i
), r AS (
    SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = c.first AND place <= share
    UNION ALL
    SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > share
), path AS (
    SELECT c.conv_id, coalesce(list([role, text] ORDER BY own, place) FILTER (role IS NOT NULL), []) AS path
    FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), step AS (
    SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM path
), node AS (
    SELECT depth, path[1:depth] AS at, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(path)) AS deepest,
        CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path[depth][2]), '[^\x20\x09-\x0D]+')) END AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
    FROM step GROUP BY depth, path[1:depth]
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
    count(*) FILTER (u.depth = n.depth + 1) AS n_children, count(*) FILTER (u.depth = u.deepest) AS n_leaves,
    sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN node u ON u.at[1:n.depth] = n.at AND u.depth >= n.depth
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.at = n.at[1:n.depth - 1]
GROUP BY n.conv_id, n.depth, p.conv_id, n.n_convs, n.ends_sha256, n.at
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations, families joined."""
    turns = saved(turn_rows(table(spark, sf_dir, "conversations")), "trie-turns")
    nodes = saved(prefix_trie(family_starts(turns)), "trie-nodes")
    return with_kin(nodes).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved_words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
