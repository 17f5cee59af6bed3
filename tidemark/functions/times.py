"""Time columns: parsing, truncation, periods and intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import normal_grain, parse_interval, parse_period

# Farther from 1970 a timestamp in microseconds overflows.
MAX_MILLIS = ((1 << 63) - 1) // 1000


def parse_time(col: Column, fmt: str = "iso") -> Column:
    """Text to timestamp; null where the text is no time.

    ``iso`` reads ISO-8601 text, ``auto`` also reads epoch milliseconds.
    """
    text = F.trim(col.cast("string"))
    # a cast alone would read a bare time of day as one of the current date
    dated = (F.substring(text, 5, 1) == "-") | text.rlike(r"^\d{4}$")
    iso = F.when(dated, text.try_cast("timestamp"))
    if fmt == "iso":
        return iso
    if fmt == "auto":
        millis = text.try_cast("bigint")
        return F.when(
            text.rlike(r"^-?\d+$"), F.when(F.abs(millis) <= MAX_MILLIS, F.timestamp_millis(millis))
        ).otherwise(iso)
    raise ValueError(f"unknown time format: {fmt!r}")


def truncated(col: Column, grain: str | None) -> Column:
    name = normal_grain(grain)
    return col if name is None else F.date_trunc(name, col)


def period(text: str) -> Column:
    return F.make_interval(**{k: F.lit(v) for k, v in parse_period(text).items()})


def grain_length(grain: str) -> Column:
    """Length of one chunk of this grain as an interval."""
    name = normal_grain(grain)
    if name is None:
        raise ValueError("chunks need a granularity")
    if name == "quarter":
        return F.make_interval(months=F.lit(3))
    unit = {"second": "secs", "minute": "mins"}.get(name, f"{name}s")
    return F.make_interval(**{unit: F.lit(1)})


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def in_intervals(col: Column, intervals: Iterable[str]) -> Column:
    """True inside any ``[start, end)``; no interval at all means everything."""
    hit: Column | None = None
    for text in intervals:
        start, end = parse_interval(text)
        one = (col >= stamp(start)) & (col < stamp(end))
        hit = one if hit is None else hit | one
    return F.lit(True) if hit is None else hit


def seconds_between(first: Column, second: Column) -> Column:
    """Whole seconds from ``first`` to ``second``."""
    return F.unix_timestamp(second) - F.unix_timestamp(first)
