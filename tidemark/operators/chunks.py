"""Time chunks: merging, re-cutting, bounding and summing up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import grain_length, period
from tidemark.operators.ordering import row_numbers
from tidemark.operators.rollup import merge_rollup, rollup
from tidemark.operators.shape import assign_chunk, truncate_time
from tidemark.spec import CHUNK, MAX_ROWS_PER_SEGMENT, SEGMENT, TIME, Metric


def _merged(
    df: DataFrame, grain: str, dims: list[str], metrics: list[Metric], query_granularity: str | None, partial: bool
) -> DataFrame:
    if metrics:
        fold = merge_rollup if partial else rollup
        df = fold(df.drop(CHUNK), dims, metrics, query_granularity)
    else:
        df = truncate_time(df.drop(CHUNK), query_granularity)
    return assign_chunk(df, grain)


def compact(
    df: DataFrame,
    grain: str,
    dims: Iterable[str] = (),
    metrics: Iterable[Metric] = (),
    query_granularity: str | None = None,
    skip_offset: str | None = None,
    current_grain: str | None = None,
    partial: bool = True,
) -> DataFrame:
    """Chunks of ``df`` merged into chunks of ``grain``.

    With metrics, rows of equal time and dimensions become one; ``partial``
    says whether they hold partial metrics or raw values. With
    ``skip_offset``, chunks that end later than the latest chunk end minus the
    offset stay as they are; ``current_grain`` is the grain they have now.
    The result is for a new path: a job must not overwrite what it reads.
    """
    dims, metrics = list(dims), list(metrics)
    if skip_offset is None:
        return _merged(df, grain, dims, metrics, query_granularity, partial)
    if current_grain is None:
        raise ValueError("skip_offset needs the current grain")
    end = F.col(CHUNK) + grain_length(current_grain)
    # one value, worked out first and then part of both scans' partition filters
    latest = df.agg(F.max(F.col(CHUNK)).alias("latest")).scalar() + grain_length(current_grain)
    settled = end <= latest - period(skip_offset)
    done = _merged(df.where(settled), grain, dims, metrics, query_granularity, partial)
    rest = df.where(~settled)
    return done.unionByName(rest.select(*done.columns))


def assign_segment(
    df: DataFrame, order: Iterable[str], max_rows: int = MAX_ROWS_PER_SEGMENT, buckets: int | None = None
) -> DataFrame:
    """Number the segments of each chunk, each of at most ``max_rows`` rows.

    Rows go in the order of time, then ``order``. A chunk of any size is
    numbered by as many tasks as it has buckets, see ``ordering``.
    """
    numbered = row_numbers(df, [CHUNK], [TIME, *order], "__rn", buckets)
    return numbered.withColumn(SEGMENT, F.expr(f"(__rn - 1) div {int(max_rows)}")).drop("__rn")


def chunk_summary(df: DataFrame, max_rows: int = MAX_ROWS_PER_SEGMENT) -> DataFrame:
    """Rows, time bounds and segments per chunk."""
    return df.groupBy(CHUNK).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(TIME).alias("min_time"),
        F.max(TIME).alias("max_time"),
        F.ceil(F.count(F.lit(1)) / max_rows).cast("bigint").alias("segments"),
    )
