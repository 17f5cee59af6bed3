"""Streams of JSON values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.spec import parse_period


def read_stream(spark: SparkSession, io: Mapping, source: DataFrame | None = None) -> DataFrame:
    """The topic's values as text in ``value``.

    ``source`` replaces the topic by any stream that has a ``value`` column.
    """
    if source is None:
        reader = spark.readStream.format("kafka").option("subscribe", io["topic"])
        for key, value in io.get("consumerProperties", {}).items():
            reader = reader.option(f"kafka.{key}", value)
        if io.get("maxOffsetsPerTrigger"):
            reader = reader.option("maxOffsetsPerTrigger", io["maxOffsetsPerTrigger"])
        source = reader.load()
    return source.select(F.col("value").cast("string").alias("value"))


def period_seconds(text: str) -> int:
    """A period of fixed length in seconds."""
    # Length of each period unit in seconds.
    seconds = {"weeks": 604800, "days": 86400, "hours": 3600, "mins": 60, "secs": 1}
    parts = parse_period(text)
    if not set(parts) <= set(seconds):
        raise ValueError(f"months and years have no fixed length: {text!r}")
    return int(sum(seconds[k] * v for k, v in parts.items()))


def publish_trigger(io: Mapping) -> dict[str, str]:
    """``taskDuration`` as the interval between two micro-batches."""
    return {"processingTime": f"{period_seconds(io.get('taskDuration', 'PT1H'))} seconds"}
