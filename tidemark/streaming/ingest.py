"""Streaming ingestion: partial roll-ups per micro-batch, windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import period
from tidemark.operators.rollup import aggregate_of, rollup
from tidemark.operators.shape import assign_chunk, truncate_time
from tidemark.plans.ingest import DIMS, build_stream_rows
from tidemark.sources.streams import period_seconds, publish_trigger
from tidemark.sources.tables import table_path, write_datasource
from tidemark.spec import CHUNK, TIME, IngestSpec, normal_grain
from tidemark.streaming.levels import add_batch, last_list, read_folders

BATCH = "__batch"


def publish(spec: IngestSpec) -> dict:
    """Micro-batches as often as the declaration's ``taskDuration`` says; without one, all there is and then the end."""
    return publish_trigger(spec.io) if spec.io.get("taskDuration") else {"availableNow": True}


def stream_ingest(
    source: DataFrame,
    spec: IngestSpec,
    root: str,
    checkpoint: str,
    trigger: Mapping | None = None,
    late_rejection: str | None = None,
) -> StreamingQuery:
    """Roll up each micro-batch and add it to the table as partial rows.

    Files lie below their chunk and batch number and replace what an earlier
    try of the same batch left, so a replay adds nothing twice. ``compact``
    merges the partial rows later. Late rows go into their chunk unless
    ``late_rejection`` sets a period after which they are dropped.
    """
    rows = build_stream_rows(source, spec)
    marks = f"{checkpoint}/high-time"

    def in_time(batch: DataFrame, number: int) -> DataFrame:
        """Rows no older than the delay before the latest time of earlier batches: one mark, carried from batch to batch."""
        high = last_list(batch.sparkSession, marks, number)["marks"].get("high")
        newest = batch.agg(F.max(F.unix_micros(TIME)).alias("high")).first()["high"]
        latest = max([m for m in (high, newest) if m is not None], default=None)
        add_batch(None, marks, number, lambda d: d, {"high": latest})
        return batch if high is None else batch.where(F.col(TIME) >= F.timestamp_micros(F.lit(high)) - period(late_rejection))

    def add(batch: DataFrame, number: int) -> None:
        if late_rejection:
            batch = in_time(batch, number)
        if spec.rolls_up:
            batch = rollup(batch, [DIMS], spec.metrics, spec.query_granularity)
        else:
            batch = truncate_time(batch, spec.query_granularity)
        out = assign_chunk(batch, spec.segment_granularity).withColumn(BATCH, F.lit(number))
        write_datasource(out, root, spec.data_source, "replace", spec.max_rows_per_segment, [BATCH])

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or publish(spec)))
        .start()
    )


def read_stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(root, name)).drop(BATCH)


def stream_rollup(
    source: DataFrame,
    spec: IngestSpec,
    sink: str,
    checkpoint: str,
    trigger: Mapping | None = None,
    late_rejection: str | None = None,
) -> StreamingQuery:
    """Tumbling windows of the segment granularity, kept up to date in ``sink``.

    Each micro-batch adds the windows it changed, and folders of several batches
    merge to the newest state of each window, which ``read_windows`` gives. With
    ``late_rejection`` closed windows leave the state store.
    """
    grain = normal_grain(spec.segment_granularity)
    width = {"week": "7 days", "month": None, "quarter": None, "year": None}.get(grain, f"1 {grain}")
    if width is None:
        raise ValueError("windows need a fixed length")
    rows = build_stream_rows(source, spec)
    if late_rejection:
        rows = rows.withWatermark(TIME, f"{period_seconds(late_rejection)} seconds")
    windows = rows.groupBy(F.window(TIME, width).alias("w"), DIMS).agg(*[aggregate_of(m) for m in spec.metrics])
    out = windows.select(F.col("w.start").alias(CHUNK), DIMS, *[m.name for m in spec.metrics])

    def put(batch: DataFrame, number: int) -> None:
        add_batch(batch.withColumn(BATCH, F.lit(number)), sink, number, _newest)

    return (
        out.writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or publish(spec)))
        .start()
    )


def _newest(windows: DataFrame) -> DataFrame:
    values = [c for c in windows.columns if c not in (CHUNK, DIMS)]
    newest = windows.groupBy(CHUNK, DIMS).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("v"))
    return newest.select(CHUNK, DIMS, "v.*")


def read_windows(spark: SparkSession, sink: str) -> DataFrame:
    """The newest state of every window."""
    return _newest(read_folders(spark, sink, last_list(spark, sink)["folders"])).drop(BATCH)
