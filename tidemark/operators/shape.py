"""From text rows to typed rows: time, dimensions, chunks, intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import in_intervals, parse_time, truncated
from tidemark.spec import CHUNK, TIME, Dimension, normal_grain


def with_time(df: DataFrame, column: str, fmt: str = "iso") -> DataFrame:
    return df.withColumn(TIME, parse_time(F.col(column), fmt))


def dimension_value(col: Column, type_: str) -> Column:
    if type_ == "string":
        return col.cast("string")
    text = col.cast("string")
    if type_ == "long":
        # by way of a decimal: it takes fractions, and a failed cast to a whole number is slow
        return text.try_cast("decimal(38,9)").try_cast("bigint")
    if type_ in ("double", "float"):
        return text.try_cast(type_)
    raise ValueError(f"unknown dimension type: {type_!r}")


def select_dimensions(df: DataFrame, dims: Iterable[Dimension], keep: Iterable[str] = (TIME,)) -> DataFrame:
    """The kept columns, then the declared dimensions in their order."""
    return df.select(*keep, *[dimension_value(F.col(f"`{d.name}`"), d.type).alias(d.name) for d in dims])


def discover_names(df: DataFrame, json_col: str, exclusions: Iterable[str] = ()) -> list[str]:
    """Sorted names of all keys that occur, but for the exclusions.

    One pass; partial aggregation leaves each task one row per name, and only
    names come to the driver, which needs them as columns. For lines with more
    keys than a table should have columns, see ``plans.ingest.build_wide``.
    """
    keys = df.select(F.explode(F.map_keys(F.from_json(F.col(json_col), "map<string,string>"))).alias("name"))
    left_out = list(exclusions)
    if left_out:
        keys = keys.where(~F.col("name").isin(left_out))
    return sorted(r["name"] for r in keys.distinct().collect())


def discover_dimensions(
    df: DataFrame,
    json_col: str,
    exclusions: Iterable[str] = (),
    names: list[str] | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Every key of the JSON object but the exclusions as a text column."""
    if names is None:
        names = discover_names(df, json_col, exclusions)
    if not names:
        return df.select(*keep)
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    opened = df.select(*keep, F.from_json(F.col(json_col), ddl).alias("__doc"))
    return opened.select(*keep, "__doc.*")


def truncate_time(df: DataFrame, grain: str | None) -> DataFrame:
    return df if normal_grain(grain) is None else df.withColumn(TIME, truncated(F.col(TIME), grain))


def assign_chunk(df: DataFrame, grain: str) -> DataFrame:
    if normal_grain(grain) is None:
        raise ValueError("chunks need a granularity")
    return df.withColumn(CHUNK, truncated(F.col(TIME), grain))


def filter_intervals(df: DataFrame, intervals: Iterable[str], time_col: str = TIME) -> DataFrame:
    return df.where(in_intervals(F.col(time_col), intervals))


def filtered_count(df: DataFrame, condition: Column, name: str = "Count") -> DataFrame:
    return df.where(condition).agg(F.count(F.lit(1)).alias(name))
