"""Mixing sources to target weights: whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table, unused, words

MAX_REPEATS = 3


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size, weight`` in code-point order of the sources, null last.

    The rank is a partition's offset plus the place within it, so a corpus with
    a source per web host needs no global window: only the row counts of the
    sorted partitions meet in one task.
    """
    place = F.monotonically_increasing_id()
    ordered = saved(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .orderBy(F.col("source").asc_nulls_last())
        .withColumn("place", place),
        "sources",
    )
    ordered = ordered.withColumn("part", F.shiftright("place", 33)).withColumn(
        "place", F.col("place").bitwiseAND((1 << 33) - 1)
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    slot = F.col("offset") + F.col("place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (slot % len(weights) + 1).cast("int"))
    return ordered.join(offsets, "part").select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target``: a share of all sizes by weight, at most ``max_repeats`` times the source.

    What a full source cannot take is shared again by weight among the others.
    Each turn is one aggregate over the sources; the level only rises, so it
    ends after as many turns as there are sources at the limit, at most.
    """
    full = F.col("source_size") * max_repeats
    remaining, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    remaining, weight = remaining or 0, weight or 1
    total = remaining

    def above(left: int, among: int) -> Column:
        return full.cast("double") * float(among) < F.col("weight").cast("double") * float(left)

    while True:
        taken, among = sources.agg(
            F.sum(F.when(above(remaining, weight), full).otherwise(0)),
            F.sum(F.when(above(remaining, weight), 0).otherwise(F.col("weight"))),
        ).first()
        if taken is None or not among or (total - taken, among) == (remaining, weight):
            break
        remaining, weight = total - taken, among
    share = F.col("weight").cast("double") * float(remaining) / float(weight)
    return sources.withColumn("target", F.when(above(remaining, weight), full.cast("double")).otherwise(share))


def draw(seed: int, *by: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    return saved(docs.select(*keep, F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")


def rates(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """``of`` (the source), ``source_size``, ``target`` and ``rate``."""
    sources = saved(targets(ranked_sources(sizes, weights), max_repeats), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"))


def copies(rate: str, seed: int) -> Column:
    return F.floor(rate) + (draw(seed, "doc_id", "source") < F.col(rate) - F.floor(rate)).cast("long")


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies``.

    ``size`` is the number of words. A source's rate is its target over its
    size; a document is taken ``floor(rate)`` times, and once more with the
    fraction as probability. The draw hashes seed, document and source, so runs
    agree and a repeated row is drawn like the first. A null text has size 0; a
    null source is a source of its own; in an empty table nothing is taken.
    """
    sizes = sized(docs, "doc_id", "source")
    return (
        sizes.join(rates(sizes, weights, max_repeats), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies("rate", seed))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The documents, each as many times as ``mix_plan`` says; all columns stay, whatever their names.

    Only the rate of each source is joined to the documents, so their texts are
    shuffled only if the sources are too many to broadcast.
    """
    of, rate, turn = unused(docs, "of", "rate", "turn")
    known = rates(sized(docs, "source"), weights, max_repeats).select(F.col("of").alias(of), F.col("rate").alias(rate))
    return (
        docs.join(known, F.col("source").eqNullSafe(F.col(of)))
        .withColumn(turn, copies(rate, seed))
        .where(F.col(turn) > 0)
        .withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(turn))))
        .select(*docs.columns)
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
    FROM d GROUP BY source
), w AS (
    SELECT source, source_size, ((k - 1) % 3 + 1)::BIGINT AS weight FROM s
), o AS (
    SELECT *, row_number() OVER r AS k, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
        coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
    FROM w WINDOW r AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), level AS (
    SELECT (total - taken)::DOUBLE AS rest, (weights - gone)::DOUBLE AS among FROM o
    WHERE 3 * source_size * (weights - gone) >= weight * (total - taken) ORDER BY k LIMIT 1
), t AS (
    SELECT source, source_size,
        CASE WHEN 3 * source_size::DOUBLE * among < weight::DOUBLE * rest THEN (3 * source_size)::DOUBLE
             ELSE weight::DOUBLE * rest / among END AS target
    FROM w, level
)
SELECT doc_id, size, source_size, target,
    size * (floor(rate) + CASE WHEN ('0x' || md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' ||
        coalesce(source, ''))[1:13])::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


@query("op3_mixing", SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
