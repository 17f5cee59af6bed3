"""Copies in a stream: found by key and time, with nothing lost behind a watermark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.streams import period_seconds
from tidemark.spec import TIME
from tidemark.streaming.levels import add_batch, last_list, read_folders

BATCH, SLOT, DAY = "__batch", "__slot", "__day"
_SEEN = f"__h long, __g long, __at timestamp, {SLOT} long, {DAY} long"


def _slot(at: str | Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000))


def _firsts(rows: DataFrame, key: Sequence[str], seconds: int, time_col: str) -> DataFrame:
    """Of each key the earliest row in each slot, unless the slot before has one less than a period earlier.

    Tasks aggregate first, so an event that is repeated very often is one row a task.
    """
    named = rows.withColumns({"__h": F.xxhash64(*key), "__g": F.xxhash64(F.lit("key"), *key), SLOT: _slot(time_col, seconds)})
    order = F.struct(F.col(time_col), F.xxhash64(*rows.columns))
    one = named.groupBy("__h", "__g", SLOT).agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    one = one.select("__h", "__g", SLOT, F.col(f"row.{time_col}").alias("__at"), "row")
    before = one.select("__h", "__g", (F.col(SLOT) + 1).alias(SLOT), F.col("__at").alias("__was"))
    met = one.join(before, ["__h", "__g", SLOT], "left")
    near = F.unix_micros("__at") - F.unix_micros("__was") < seconds * 1_000_000
    return met.where(~F.coalesce(near, F.lit(False))).drop("__was")


def stream_dedupe(
    source: DataFrame,
    key: Sequence[str],
    sink: str,
    checkpoint: str,
    within: str = "P1D",
    remember: str = "P30D",
    time_col: str = TIME,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Write one row of each key within a period to ``sink/rows``, late rows as well.

    A row is a copy if a kept row of its key is less than ``within`` before or
    after it, in this or any earlier micro-batch; of a batch, the earliest row
    in each slot of that length counts. Keys that were seen are kept by day of
    their time: a batch reads only the days it touches and writes only its own
    keys. Days more than ``remember`` before the latest time are forgotten when
    folders merge. A row from before that cannot be checked: it goes to
    ``sink/late``, so none is lost. So does a row without a time. A row with a
    null in its key has no copies.
    """
    key, seconds = list(key), period_seconds(within)
    horizon = period_seconds(remember)
    state = f"{sink}/seen"

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = last_list(spark, state, number)
        high = before["marks"].get("high")
        newest = batch.agg(F.max(F.unix_micros(time_col)).alias("high")).first()["high"]
        marks = [m for m in (high, newest) if m is not None]
        floor = None if high is None else high - horizon * 1_000_000
        behind = F.col(time_col).isNull() | (F.lit(False) if floor is None else F.unix_micros(time_col) < floor)
        batch.where(behind).write.mode("overwrite").parquet(f"{sink}/late/{BATCH}={number}")
        rows = batch.where(~behind)
        unnamed = F.lit(False)
        for k in key:
            unnamed = unnamed | F.col(f"`{k}`").isNull()
        firsts = _firsts(rows.where(~unnamed), key, seconds, time_col)
        seen = read_folders(spark, state, before["folders"], _SEEN)
        if seen is not None:
            days = rows.select(F.explode(F.array(*[F.floor(F.unix_micros(time_col) / 86_400_000_000) + d for d in _reach(seconds)])).alias(DAY))
            old = seen.join(days.distinct(), DAY, "left_semi")
            old = old.select("__h", "__g", F.explode(F.array(*[F.col(SLOT) + d for d in (-1, 0, 1)])).alias(SLOT), F.col("__at").alias("__was"))
            near = F.abs(F.unix_micros("__at") - F.unix_micros("__was")) < seconds * 1_000_000
            same = (firsts["__h"] == old["__h"]) & (firsts["__g"] == old["__g"]) & (firsts[SLOT] == old[SLOT]) & near
            firsts = firsts.join(old, same, "left_anti")
        kept = firsts.select("row.*").unionByName(rows.where(unnamed))
        kept.write.mode("overwrite").parquet(f"{sink}/rows/{BATCH}={number}")
        fresh = spark.read.schema(batch.schema).parquet(f"{sink}/rows/{BATCH}={number}").where(~unnamed)
        told = fresh.select(
            F.xxhash64(*key).alias("__h"),
            F.xxhash64(F.lit("key"), *key).alias("__g"),
            F.col(time_col).alias("__at"),
            _slot(time_col, seconds).alias(SLOT),
            F.floor(F.unix_micros(time_col) / 86_400_000_000).alias(DAY),
        )
        latest = max(marks, default=None)
        oldest = None if latest is None else (latest - horizon * 1_000_000) // 86_400_000_000 - max(_reach(seconds))
        add_batch(told, state, number, lambda d: d if oldest is None else d.where(F.col(DAY) >= oldest), {"high": latest}, [DAY])

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            split(batch, number)
        finally:
            batch.unpersist()

    return (
        source.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _reach(seconds: int) -> range:
    """Days that a row within a period of another can lie before or after it."""
    days = -(-seconds // 86_400)
    return range(-days, days + 1)


def read_unique(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/rows").drop(BATCH)


def read_late(spark: SparkSession, sink: str) -> DataFrame:
    """Rows too old to be checked, and rows without a time."""
    return spark.read.parquet(f"{sink}/late").drop(BATCH)
