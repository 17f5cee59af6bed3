"""Compaction and retention as jobs: from table to table, or as versions of one table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import grain_length, period, truncated
from tidemark.operators.chunks import compact
from tidemark.operators.retention import apply_retention, decided_action
from tidemark.sources.snapshots import END, commit, entries, rewrite
from tidemark.sources.tables import read_datasource, table_path, write_datasource
from tidemark.spec import CHUNK, MAX_ROWS_PER_SEGMENT, Metric, Rule


def _other_path(root: str, name: str, target: str) -> str:
    if table_path(root, target) == table_path(root, name):
        raise ValueError("a job must not overwrite the table it reads")
    return target


def compact_datasource(
    spark: SparkSession,
    root: str,
    name: str,
    target: str,
    grain: str,
    dims: Iterable[str] = (),
    metrics: Iterable[Metric] = (),
    query_granularity: str | None = None,
    skip_offset: str | None = None,
    current_grain: str | None = None,
    partial: bool = True,
    max_rows: int = MAX_ROWS_PER_SEGMENT,
) -> str:
    """Write the compacted table below another name; gives its path.

    A failed run leaves the table that is read untouched. Running it again, with
    another grain as well, replaces the target as a whole.
    """
    target = _other_path(root, name, target)
    rows = read_datasource(spark, root, name)
    merged = compact(
        rows, grain, dims, metrics, query_granularity, skip_offset, current_grain=current_grain, partial=partial
    )
    return write_datasource(merged, root, target, "whole", max_rows)


def retain_datasource(
    spark: SparkSession,
    root: str,
    name: str,
    target: str,
    rules: Sequence[Rule],
    as_of: str,
    grain: str,
    max_rows: int = MAX_ROWS_PER_SEGMENT,
) -> str:
    """Write the chunks that no rule drops below another name; gives its path.

    Files of dropped chunks are not read. The target is replaced as a whole, so
    that chunks which an earlier run kept go when the rules now drop them.
    """
    target = _other_path(root, name, target)
    kept = apply_retention(read_datasource(spark, root, name), rules, as_of, grain)
    return write_datasource(kept.where(F.col(CHUNK).isNotNull()), root, target, "whole", max_rows)


def compact_table(
    spark: SparkSession,
    root: str,
    name: str,
    grain: str,
    dims: Iterable[str] = (),
    metrics: Iterable[Metric] = (),
    query_granularity: str | None = None,
    skip_offset: str | None = None,
    partial: bool = True,
    max_rows: int = MAX_ROWS_PER_SEGMENT,
) -> int | None:
    """Merge a table's chunks into chunks of ``grain`` as a new version; nothing if there is nothing to merge.

    Only what is not merged yet is read: chunks that are one entry of that grain
    stay, and so a second run changes nothing. With ``skip_offset`` chunks that
    would end later than the latest end less the offset stay as well. A chunk
    longer than ``grain`` is cut.
    """
    found = entries(spark, root, name)
    target = truncated(F.col("start"), grain)
    done = (target == F.col("start")) & (F.timestamp_seconds("c") == F.col("start")) & (F.timestamp_seconds("e") == F.col("end"))
    done = done & (F.col("end") == F.col("start") + grain_length(grain))
    state = found.select("*", target.alias("target"), done.alias("done"))
    # the last moment that an entry's rows can come to lie in, after the merge
    reach = truncated(F.col("end") - F.expr("INTERVAL 1 MICROSECOND"), grain) + grain_length(grain)
    ready = state.groupBy("target").agg(F.count(F.lit(1)).alias("k"), F.every("done").alias("all_done"), F.max(reach).alias("reach"))
    ready = ready.where((F.col("k") > 1) | ~F.col("all_done"))
    if skip_offset is not None:
        ready = ready.where(F.col("reach") <= found.agg(F.max("end").alias("latest")).scalar() - period(skip_offset))
    chosen = state.join(ready.select("target"), "target", "left_semi").select(*found.columns)

    def merged(rows: DataFrame) -> DataFrame:
        return compact(rows.drop(END), grain, dims, metrics, query_granularity, partial=partial)

    return rewrite(spark, root, name, chosen, merged, grain, max_rows)


def retain_table(spark: SparkSession, root: str, name: str, rules: Sequence[Rule], as_of: str) -> int:
    """Drop the chunks that the rules drop as a new version. No row is read or written, and each chunk is judged by its own end."""

    def kept(found: DataFrame) -> DataFrame:
        bounds = found.withColumn(CHUNK, F.col("start"))
        return bounds.where(decided_action(rules, F.col("end"), as_of) != "drop").drop(CHUNK)

    return commit(spark, root, name, kept)
