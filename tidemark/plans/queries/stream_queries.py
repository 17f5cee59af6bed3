"""Structured Streaming runs over the events table as a file stream, each to its end."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunks import compact
from tidemark.plans.ingest import DIMS, expand_dimensions
from tidemark.plans.queries.base import SQL_METRICS, VALUE_METRICS, event_lines, events, query, table
from tidemark.session import shared_folder
from tidemark.sources.streams import read_stream
from tidemark.spec import TIME, IngestSpec
from tidemark.streaming.changes import read_changes, stream_status_changes
from tidemark.streaming.dedupe import read_late, read_unique
from tidemark.streaming.dedupe import stream_dedupe as dedupe
from tidemark.streaming.ingest import read_stream_table, read_windows, stream_ingest, stream_rollup

STREAM_SPEC = IngestSpec(
    data_source="events",
    time_column="time",
    time_format="auto",
    exclusions=("time", "value", "event_id", "user_id", "props"),
    metrics=VALUE_METRICS,
    segment_granularity="HOUR",
    query_granularity="NONE",
)
DAY_SPEC = replace(STREAM_SPEC, segment_granularity="DAY", query_granularity="HOUR")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # as a pattern the path may be one file or a folder of files
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return rows.withColumn(TIME, F.col("ts").cast("timestamp")).drop("ts")


def value_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stream(spark, {}, source=event_lines(event_stream(spark, sf_dir)))


@query(
    "stream_rollup",
    f"SELECT date_trunc('hour', ts) AS __chunk, event_type, {SQL_METRICS} FROM events GROUP BY ALL",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    run = stream_rollup(value_stream(spark, sf_dir), STREAM_SPEC, f"{folder}/windows", f"{folder}/checkpoint")
    run.awaitTermination()
    return expand_dimensions(read_windows(spark, f"{folder}/windows"), ["event_type"])


@query(
    "stream_ingest_merged",
    f"""SELECT date_trunc('day', ts) AS __time, date_trunc('day', ts) AS __chunk, event_type, {SQL_METRICS}
        FROM events GROUP BY ALL""",
)
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    stream_ingest(value_stream(spark, sf_dir), DAY_SPEC, folder, f"{folder}/checkpoint").awaitTermination()
    partial = read_stream_table(spark, folder, DAY_SPEC.data_source)
    days = compact(partial, "DAY", [DIMS], VALUE_METRICS, query_granularity="DAY")
    return expand_dimensions(days, ["event_type"])


@query(
    "stream_changes",
    """SELECT user_id, __time, event_id, event_type FROM (
         SELECT user_id, ts AS __time, event_id, event_type,
                lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
       WHERE previous IS NULL OR previous <> event_type""",
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    rows = event_stream(spark, sf_dir).select("user_id", TIME, "event_id", "event_type")
    stream_status_changes(
        rows, ["user_id"], [TIME, "event_id"], "event_type", folder, f"{folder}/checkpoint"
    ).awaitTermination()
    return read_changes(spark, folder).drop("previous", "is_first")


@query("stream_dedupe", "SELECT event_id, user_id, event_type, value, ts AS __time FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, once per copy of the stream."""
    folder = shared_folder(spark, "stream")
    rows = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value", TIME)
    twice = rows.unionByName(event_stream(spark, sf_dir).select(*rows.columns))
    dedupe(twice, ["event_id"], folder, f"{folder}/checkpoint").awaitTermination()
    return read_unique(spark, folder)


def in_turns(spark: SparkSession, parts: list[DataFrame], run) -> str:
    """Writes one part after another to a folder and runs a stream over it each time, as after a restart."""
    folder = shared_folder(spark, "stream")
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{i}")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in/*")
        run(source, folder).awaitTermination()
    return folder


def event_parts(spark: SparkSession, sf_dir: str, by: str) -> list[DataFrame]:
    rows = events(spark, sf_dir)
    return [rows.where(f"({by}) = {i}") for i in range(3)]


@query(
    "stream_dedupe_late",
    """SELECT event_id, user_id, event_type, value, ts AS __time, ts < (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-21')
              - INTERVAL 10 DAY AND day(ts) % 10 = 5 AS late FROM events""",
)
def stream_dedupe_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: the first two thirds of the month, then copies of them with days that were held back, then the rest.

    Held back are the fifth, fifteenth and twenty-fifth. The fifth is beyond what
    is remembered then and comes out as late, once; no other row is lost or doubled.
    """
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", TIME)
    held, early = F.day(TIME) % 10 == 5, F.col(TIME) < "2024-01-21"
    remembered = F.day(TIME) > 11
    parts = [rows.where(early & ~held), rows.where(early & (held | remembered)), rows.where(~early).unionByName(rows.where(~early))]

    def run(source: DataFrame, folder: str):
        return dedupe(source, ["event_id"], folder, f"{folder}/checkpoint", within="P1D", remember="P10D")

    folder = in_turns(spark, parts, run)
    unique, late = read_unique(spark, folder), read_late(spark, folder)
    return unique.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


@query(
    "stream_changes_batches",
    """WITH o AS (SELECT *, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS batch FROM events)
       SELECT user_id, __time, event_id, event_type, previous, previous IS NULL AS is_first FROM (
         SELECT user_id, ts AS __time, event_id, event_type,
                lag(event_type) OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS previous FROM o)
       WHERE previous IS NULL OR previous <> event_type""",
)
def stream_changes_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of ten days with a restart between them; the last status of each user lives in the state store."""
    parts = [p.select("user_id", TIME, "event_id", "event_type") for p in event_parts(spark, sf_dir, "least((day(__time) - 1) div 10, 2)")]

    def run(source: DataFrame, folder: str):
        return stream_status_changes(source, ["user_id"], [TIME, "event_id"], "event_type", folder, f"{folder}/checkpoint")

    return read_changes(spark, in_turns(spark, parts, run))


@query(
    "stream_rollup_batches",
    f"SELECT date_trunc('hour', ts) AS __chunk, event_type, {SQL_METRICS} FROM events GROUP BY ALL",
)
def windows_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that three batches change one after another."""
    parts = [event_lines(p) for p in event_parts(spark, sf_dir, "pmod(event_id, 3)")]

    def run(source: DataFrame, folder: str):
        return stream_rollup(read_stream(spark, {}, source=source), STREAM_SPEC, f"{folder}/windows", f"{folder}/checkpoint")

    return expand_dimensions(read_windows(spark, f"{in_turns(spark, parts, run)}/windows"), ["event_type"])
