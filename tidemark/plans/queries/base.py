"""Registry of queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import TIME, Metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VALUE_METRICS = (
    Metric("count", "count"),
    Metric("value_sum", "doubleSum", "value", scale=2),
    Metric("value_min", "doubleMin", "value"),
    Metric("value_max", "doubleMax", "value"),
)

# Decimal sums do not depend on the order of addition, so both engines agree to the last bit.
SQL_METRICS = """count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_sum,
       min(value) AS value_min, max(value) AS value_max"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables have them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned}) if zoned else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``__time`` as a timestamp."""
    df = table(spark, sf_dir, "events")
    return df.withColumn(TIME, F.col("ts").cast("timestamp")).drop("ts")


def event_lines(df: DataFrame) -> DataFrame:
    """Events as JSON text in ``value``."""
    stamp = F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select(
        F.to_json(F.struct(stamp.alias("time"), "event_id", "user_id", "event_type", "value", "props")).alias("value")
    )
