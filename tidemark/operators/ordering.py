"""Row numbers, predecessors and running values in groups of any size.

A plain window puts a whole group into one task. Here the rows are dealt to
buckets along (group, order) first, so that a group of any size is many
buckets and many small groups are one. What crosses buckets, a count or a last
value, is carried by a second, small scan over one row per bucket and group.

The bounds of the buckets are quantiles of a sample of the distinct keys,
taken by hash: tasks merge their samples, equal keys count once, and the same
rows give the same bounds again when a lost task is rerun. Nothing depends on
the kind of the order column or on the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"

# Sampled keys per bucket: bucket sizes then differ from their mean by about a sixth.
SAMPLE_PER_BUCKET = 32

_SPAN = 1 << 31


def bucket_count(df: DataFrame) -> int:
    """Twice the session's shuffle partitions, which are set for the size of the data."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _key(columns: Iterable[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])


def _bounds(df: DataFrame, key: Column, buckets: int) -> Column:
    """The smallest keys of all buckets but the first, as one scalar array."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.floor(F.lit(float(SAMPLE_PER_BUCKET * buckets * _SPAN)) / F.greatest(rows, F.lit(1)))
    sample = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(_SPAN)) < share)
    found = sample.agg(F.sort_array(F.collect_set("k")).alias("s"))
    place = lambda i: F.floor(i * F.size("s") / buckets).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("s", place(i)))
    return found.select(F.when(F.size("s") > 0, picked).alias("b")).scalar()


def bucketed(df: DataFrame, group: Iterable[str], order: Iterable[str], buckets: int | None = None, out: str = BUCKET) -> DataFrame:
    """Rows with a bucket number that never falls along ``group``, then ``order``.

    A bucket holds about an equal share of the distinct keys; rows of one key
    are in one bucket. Lazy: the bounds are a scalar subquery of the plan, of
    at most ``buckets`` keys.
    """
    key = _key([*group, *order])
    buckets = max(2, buckets or bucket_count(df))
    rows = df.withColumns({"__key": key, "__bounds": _bounds(df, key, buckets), out: F.lit(0)})
    # a binary search, one step a projection, so that generated code does it
    step = 1 << (buckets - 1).bit_length() - 1
    while step:
        after = F.get("__bounds", F.col(out) + F.lit(step - 1)) <= F.col("__key")
        rows = rows.withColumn(out, F.when(after, F.col(out) + F.lit(step)).otherwise(F.col(out)))
        step //= 2
    return rows.drop("__key", "__bounds")


def _carried(rows: DataFrame, group: list[str], parts: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """For each group and bucket that goes on from an earlier bucket: what the earlier ones fold to.

    ``parts`` names the partial aggregate of a bucket and the fold of partials.
    A bucket can go on with one group only, so there are fewer rows than buckets.
    """
    before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    partials = rows.groupBy(*group, BUCKET).agg(*[part.alias(f"__part_{n}") for n, (part, _) in parts.items()])
    return partials.select(
        *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(BUCKET).alias("__b"),
        F.count("*").over(before).alias("__n"),
        *[fold(f"__part_{n}").over(before).alias(f"__carry_{n}") for n, (_, fold) in parts.items()],
    ).where(F.col("__n") > 0).drop("__n")


def _with_carry(rows: DataFrame, group: list[str], carried: DataFrame) -> DataFrame:
    match = rows[BUCKET] == carried["__b"]
    for i, g in enumerate(group):
        match = match & rows[f"`{g}`"].eqNullSafe(carried[f"__g{i}"])
    return rows.join(F.broadcast(carried), match, "left").drop("__b", *[f"__g{i}" for i in range(len(group))])


def row_numbers(df: DataFrame, group: Iterable[str], order: Iterable[str], out: str, buckets: int | None = None) -> DataFrame:
    """``row_number`` of each row in its group, counted from 1."""
    group, order = list(group), list(order)
    rows = bucketed(df, group, order, buckets)
    carried = _carried(rows, group, {"n": (F.count(F.lit(1)), F.sum)})
    inside = Window.partitionBy(BUCKET, *group).orderBy(*order)
    number = F.coalesce("__carry_n", F.lit(0)) + F.row_number().over(inside)
    return _with_carry(rows, group, carried).withColumn(out, number).select(*df.columns, out)


def previous_values(
    df: DataFrame, key: Iterable[str], order: Iterable[str], value: str, out: str, buckets: int | None = None
) -> DataFrame:
    """The value of the row before, as ``struct<value>``; null on a key's first row."""
    key, order = list(key), list(order)
    boxed = F.struct(F.col(value).alias("value"))
    rows = bucketed(df, key, order, buckets)
    carried = _carried(rows, key, {"last": (F.max_by(boxed, _key(order)), F.last)})
    inside = Window.partitionBy(BUCKET, *key).orderBy(*order)
    before = F.coalesce(F.lag(boxed).over(inside), F.col("__carry_last"))
    return _with_carry(rows, key, carried).withColumn(out, before).select(*df.columns, out)


def running(
    df: DataFrame,
    group: Iterable[str],
    order: Iterable[str],
    folds: dict[str, tuple[Callable[[str], Column], Callable[[Column, Column], Column], Column]],
    buckets: int | None = None,
) -> DataFrame:
    """Folds of all rows before a row in its group, the row itself left out; null on a group's first row.

    ``folds`` names, for each new column, an aggregate that can fold its own
    results (``sum``, ``min``, ``bit_xor``), what joins two of its results, and
    its input. ``order`` must be unique within a group.
    """
    group, order = list(group), list(order)
    rows = bucketed(df.withColumns({f"__in_{n}": value for n, (_, _, value) in folds.items()}), group, order, buckets)
    carried = _carried(rows, group, {n: (fold(f"__in_{n}"), fold) for n, (fold, _, _) in folds.items()})
    inside = Window.partitionBy(BUCKET, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = _with_carry(rows, group, carried)
    held = held.withColumns({f"__own_{n}": fold(f"__in_{n}").over(inside) for n, (fold, _, _) in folds.items()})
    joined = {
        n: F.when(F.col(f"__own_{n}").isNull(), F.col(f"__carry_{n}"))
        .when(F.col(f"__carry_{n}").isNull(), F.col(f"__own_{n}"))
        .otherwise(join(F.col(f"__carry_{n}"), F.col(f"__own_{n}")))
        for n, (_, join, _) in folds.items()
    }
    return held.withColumns(joined).select(*df.columns, *folds)
