"""Pre-aggregation: metrics per truncated time and dimensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import in_intervals, truncated
from tidemark.spec import TIME, Metric

# Sketch sizes: theta is exact below 2^12 distinct values, KLL has about 1.3 % rank error at k=200.
THETA_LG_K = 12
HLL_LG_K = 12
KLL_K = 200


def _double_sum(col: Column, scale: int | None) -> Column:
    if scale is None:
        return F.sum(col.try_cast("double"))
    return F.sum(col.try_cast(f"decimal(28,{scale})")).cast("double")


def aggregate_of(metric: Metric) -> Column:
    """The aggregate that builds a metric from raw rows; values that are no numbers count as null."""
    field = F.col(f"`{metric.field}`") if metric.field else None
    if metric.type == "count":
        agg = F.count(F.lit(1))
    elif metric.type == "doubleSum":
        agg = _double_sum(field, metric.scale)
    elif metric.type == "doubleMin":
        agg = F.min(field.try_cast("double"))
    elif metric.type == "doubleMax":
        agg = F.max(field.try_cast("double"))
    elif metric.type == "thetaSketch":
        agg = F.theta_sketch_agg(field, THETA_LG_K)
    elif metric.type == "hllSketch":
        agg = F.hll_sketch_agg(field, HLL_LG_K)
    elif metric.type == "quantiles":
        agg = F.kll_sketch_agg_double(field.try_cast("double"), KLL_K)
    else:
        raise ValueError(f"unknown metric type: {metric.type!r}")
    return agg.alias(metric.name)


def merge_of(metric: Metric) -> Column:
    """The aggregate that merges partial values of the same metric."""
    part = F.col(f"`{metric.name}`")
    if metric.type == "count":
        agg = F.sum(part)
    elif metric.type == "doubleSum":
        agg = _double_sum(part, metric.scale)
    elif metric.type == "doubleMin":
        agg = F.min(part)
    elif metric.type == "doubleMax":
        agg = F.max(part)
    elif metric.type == "thetaSketch":
        agg = F.theta_union_agg(part, THETA_LG_K)
    elif metric.type == "hllSketch":
        agg = F.hll_union_agg(part)
    elif metric.type == "quantiles":
        agg = F.kll_merge_agg_double(part, KLL_K)
    else:
        raise ValueError(f"unknown metric type: {metric.type!r}")
    return agg.alias(metric.name)


def _group(df: DataFrame, dims: Iterable[str], aggs: list[Column], grain: str | None) -> DataFrame:
    keys = [truncated(F.col(TIME), grain).alias(TIME), *[F.col(f"`{d}`") for d in dims]]
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs)


def rollup(df: DataFrame, dims: Iterable[str], metrics: Iterable[Metric], grain: str | None) -> DataFrame:
    """One row per truncated time and dimension values.

    Tasks aggregate before the shuffle, so a hot group sends one row per task.
    """
    return _group(df, dims, [aggregate_of(m) for m in metrics], grain)


def merge_rollup(df: DataFrame, dims: Iterable[str], metrics: Iterable[Metric], grain: str | None) -> DataFrame:
    """Roll up rows that are partial roll-ups already."""
    return _group(df, dims, [merge_of(m) for m in metrics], grain)


def ingest_audit(
    df: DataFrame,
    parsed_ok: Column,
    intervals: Iterable[str],
    duplicate_key: Column,
    output_key: Column | None = None,
    by: Iterable[str] = (),
) -> DataFrame:
    """Counts of processed, unparseable, thrown away, duplicate and output rows.

    ``df`` has ``__time`` already. ``output_key`` is what a roll-up groups by;
    without it every kept row is an output row. Rows with one ``duplicate_key``
    have one output key.

    Rows are folded in steps, to different lines, to output keys, to ``by``: each
    row is shuffled once at most, and a hot datasource is spread by its lines.
    """
    by = list(by)
    ok = F.coalesce(parsed_ok, F.lit(False)) & F.col(TIME).isNotNull()
    inside = ok & F.coalesce(in_intervals(F.col(TIME), intervals), F.lit(False))
    output = F.lit(None).cast("boolean") if output_key is None else F.when(F.col("__in"), output_key)
    marked = df.withColumns({"__ok": ok, "__in": inside})
    lines = marked.groupBy(*by, "__ok", "__in", output.alias("__out"), F.when(F.col("__in"), duplicate_key).alias("__line"))
    keys = lines.agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "__ok", "__in", "__out")
    folded = keys.agg(F.sum("n").alias("n"), F.count("__line").alias("lines"))
    kept = F.coalesce(F.sum(F.when(F.col("__in"), F.col("n"))), F.lit(0))
    lined = F.coalesce(F.sum(F.when(F.col("__in"), F.col("lines"))), F.lit(0))
    return folded.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.when(~F.col("__ok"), F.col("n"))), F.lit(0)).alias("unparseable"),
        F.coalesce(F.sum(F.when(F.col("__ok") & ~F.col("__in"), F.col("n"))), F.lit(0)).alias("thrown_away"),
        (kept - lined).alias("duplicate"),
        (kept if output_key is None else F.count(F.when(F.col("__in"), 1))).alias("output"),
    )
