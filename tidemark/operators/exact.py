"""Exact answers to hold estimates against: quantiles by refining ranges, true ranks, distinct counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRACKETS = 1024


def _bracket(value: Column) -> Column:
    width = F.col("__high") - F.col("__low")
    at = F.floor((value - F.col("__low")) / F.when(width > 0, width) * BRACKETS).cast("int")
    return F.greatest(F.least(F.coalesce(at, F.lit(0)), F.lit(BRACKETS - 1)), F.lit(0))


def exact_quantiles(df: DataFrame, by: Iterable[str], value: str, shares: Sequence[float], passes: int = 2) -> DataFrame:
    """``by, share, quantile``: the least value that at least a share of a group's values do not exceed.

    Each pass counts values per bracket of equal width and keeps the bracket that
    holds the rank, narrowed to the values it has, so an outlier costs one pass
    and not the precision. Counts are folded in tasks first: a group sends at
    most ``BRACKETS`` rows a task and share, however many values it has. The
    rest of the last bracket is counted value by value. Nulls and NaN do not count.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    rank = F.greatest(F.ceil(F.col("__n") * F.col("share") - F.lit(1e-9)), F.lit(1)).cast("long")
    sought = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    sought = sought.select(*by, "share", rank.alias("__rank"), "__low", "__high")

    def within(ranges: DataFrame) -> DataFrame:
        """Values in the range of each share; a value in the ranges of several shares is taken for each."""
        return _met(rows, ranges, by).where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))

    keys = [*by, "share", "__rank"]
    for _ in range(passes):
        counted = within(sought).groupBy(*keys, _bracket(F.col("__v")).alias("__b"))
        counted = counted.agg(F.count("*").alias("__k"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = F.sum("__k").over(Window.partitionBy(*by, "share").orderBy("__b"))
        held = counted.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__k") < F.col("__rank")))
        sought = held.select(*by, "share", (F.col("__rank") - F.col("__upto") + F.col("__k")).alias("__rank"), "__low", "__high")
    counted = within(sought).groupBy(*keys, "__v").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*by, "share").orderBy("__v"))
    reached = counted.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__rank"))
    return reached.groupBy(*by, "share").agg(F.min("__v").alias("quantile"))


def _met(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the ranges of their group; null groups are groups."""
    named = ranges.withColumnsRenamed({b: f"__by_{b}" for b in by})
    match = F.lit(True)
    for b in by:
        match = match & rows[b].eqNullSafe(named[f"__by_{b}"])
    return rows.join(named, match).drop(*[f"__by_{b}" for b in by])


def true_ranks(df: DataFrame, by: Iterable[str], value: str, estimates: DataFrame) -> DataFrame:
    """``estimates`` (``by, share, estimate``) with the shares of the group's values ``below`` and ``upto`` the estimate."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    met = _met(rows, estimates, by)
    return met.groupBy(*by, "share", "estimate").agg(
        F.avg((F.col("__v") < F.col("estimate")).cast("int")).alias("below"),
        F.avg((F.col("__v") <= F.col("estimate")).cast("int")).alias("upto"),
    )


def distinct_counts(df: DataFrame, by: Iterable[str], value: str) -> DataFrame:
    """``by, n``: different values that are not null, folded in two steps, so that a hot group is spread by its values."""
    by = list(by)
    each = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.lit(1).alias("__one"))
    return each.groupBy(*by).agg(F.count("*").alias("n"))
