"""Time-chunked tables on Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import grain_length, in_intervals, stamp
from tidemark.spec import CHUNK, TIME, parse_interval


# The longest chunk there is.
LONGEST = "year"


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_datasource(
    df: DataFrame,
    root: str,
    name: str,
    mode: str = "replace",
    max_rows: int | None = None,
    extra_partitions: Iterable[str] = (),
) -> str:
    """Write rows that carry ``__chunk`` below ``root/name``.

    ``replace`` replaces just the chunks that the rows touch, ``append`` adds
    to them, ``whole`` replaces the table. Rows are rebalanced on the chunk: small chunks share a task and a
    chunk that holds much of the table is split over many, which needs AQE.
    """
    if mode not in ("replace", "append", "whole"):
        raise ValueError(f"unknown write mode: {mode!r}")
    parts = [CHUNK, *extra_partitions]
    path = table_path(root, name)
    writer = df.hint("rebalance", *[F.col(p) for p in parts]).write.partitionBy(*parts)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif mode == "whole":
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        writer.mode("append").parquet(path)
    return path


def chunk_overlaps(intervals: Iterable[str], grain: str) -> Column:
    """Predicate on the partition column alone, so that files are pruned."""
    hit: Column | None = None
    for text in intervals:
        start, end = parse_interval(text)
        one = (F.col(CHUNK) > stamp(start) - grain_length(grain)) & (F.col(CHUNK) < stamp(end))
        hit = one if hit is None else hit | one
    return F.lit(True) if hit is None else hit


def time_range(df: DataFrame, intervals: Iterable[str], grain: str = LONGEST) -> DataFrame:
    """Rows inside the intervals.

    ``grain`` is the longest chunk in the table. Without it no chunk is skipped
    that could reach into an interval, whatever its grain.
    """
    wanted = list(intervals)
    return df.where(chunk_overlaps(wanted, grain)).where(in_intervals(F.col(TIME), wanted))


def read_datasource(
    spark: SparkSession, root: str, name: str, intervals: Iterable[str] | None = None, grain: str = LONGEST
) -> DataFrame:
    df = spark.read.parquet(table_path(root, name))
    return df if intervals is None else time_range(df, intervals, grain)
