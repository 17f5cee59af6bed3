"""Metric streams: ``ts, metric, dims map<string,string>, value`` rolled up by type."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.maps import sorted_map_json
from tidemark.functions.times import truncated

TIMER_SHARES = (0.5, 0.95, 0.99)

DEFINITION = pa.schema(
    [("metric", pa.string()), ("dimensions", pa.list_(pa.string())), ("type", pa.string()), ("convertRange", pa.bool_())]
)


def metric_definitions(spark: SparkSession, doc: str | Mapping) -> DataFrame:
    """The definition document as rows ``metric, dimensions, type, convertRange``.

    They come as an Arrow table, whose size Spark knows, so it sends them to every worker by its own threshold.
    """
    parsed = json.loads(doc) if isinstance(doc, str) else doc
    rows = [
        {"metric": n, "dimensions": list(d["dimensions"]), "type": d["type"], "convertRange": bool(d.get("convertRange", False))}
        for n, d in parsed.items()
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, DEFINITION))


def conform_metrics(df: DataFrame, defs: DataFrame) -> DataFrame:
    """Only defined metrics, each with only its listed dimensions.

    Ratios marked ``convertRange`` become percentages.
    """
    known = df.join(defs, "metric")
    return known.select(
        "ts",
        "metric",
        "type",
        F.map_filter("dims", lambda k, _: F.array_contains("dimensions", k)).alias("dims"),
        F.when(F.col("convertRange"), F.col("value") * 100).otherwise(F.col("value")).alias("value"),
    )


def _windows(df: DataFrame, defs: DataFrame, type_: str, grain: str, aggs: Iterable[Column]) -> DataFrame:
    rows = conform_metrics(df, defs.where(F.col("type") == type_))
    return rows.groupBy(
        truncated(F.col("ts"), grain).alias("window_start"), "metric", sorted_map_json(F.col("dims")).alias("dims")
    ).agg(*aggs)


def _exact(value: Column, scale: int | None) -> Column:
    """With a scale, sums are of decimals and do not depend on their order."""
    return value if scale is None else value.cast(f"decimal(18,{scale})")


def rollup_counts(df: DataFrame, defs: DataFrame, grain: str = "hour", scale: int | None = None) -> DataFrame:
    value = F.sum(_exact(F.col("value"), scale)).cast("double")
    return _windows(df, defs, "count", grain, [value.alias("value")])


def rollup_gauges(df: DataFrame, defs: DataFrame, grain: str = "hour") -> DataFrame:
    """The last value of each window; of two at the same time, the larger."""
    last = F.max(F.struct("ts", "value"))["value"]
    return _windows(df, defs, "gauge", grain, [last.alias("value")])


def _timer_columns(value: Column, scale: int | None) -> list[Column]:
    return [
        (F.sum(_exact(value, scale)).cast("double") / F.count(value)).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[F.percentile_approx(value, p, 10_000).alias(f"p{int(p * 100)}") for p in TIMER_SHARES],
    ]


def rollup_timers(df: DataFrame, defs: DataFrame, grain: str = "hour", scale: int | None = None) -> DataFrame:
    """Count, mean, bounds and percentiles; percentiles are observed values."""
    value = F.col("value")
    return _windows(df, defs, "timer", grain, [F.count(value).alias("count"), *_timer_columns(value, scale)])


def rollup_metrics(df: DataFrame, defs: DataFrame, grain: str = "hour", scale: int | None = None) -> DataFrame:
    """All types at once: one pass, with the columns that fit the metric's type."""
    rows = conform_metrics(df, defs)
    counts, gauges, timers = (F.col("type") == t for t in ("count", "gauge", "timer"))
    timed = F.when(timers, F.col("value"))
    return rows.groupBy(
        truncated(F.col("ts"), grain).alias("window_start"),
        "metric",
        "type",
        sorted_map_json(F.col("dims")).alias("dims"),
    ).agg(
        F.when(counts, F.sum(_exact(F.col("value"), scale)).cast("double"))
        .when(gauges, F.max(F.struct("ts", "value"))["value"])
        .alias("value"),
        F.when(timers, F.count("value")).alias("count"),
        *_timer_columns(timed, scale),
    )
