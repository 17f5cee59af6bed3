"""From a declaration to rows of a table, and on to the table itself."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.maps import sorted_map_json
from tidemark.functions.times import parse_time, truncated
from tidemark.operators.rollup import ingest_audit, rollup
from tidemark.operators.shape import (
    assign_chunk,
    discover_dimensions,
    discover_names,
    filter_intervals,
    select_dimensions,
    truncate_time,
)
from tidemark.sources.files import BAD_RECORD, read_json, read_lines
from tidemark.sources.tables import write_datasource
from tidemark.spec import TIME, Dimension, IngestSpec

DIMS = "__dims"


def _finish(rows: DataFrame, spec: IngestSpec, dims: list[str]) -> DataFrame:
    if spec.rolls_up:
        rows = rollup(rows, dims, spec.metrics, spec.query_granularity)
    else:
        rows = truncate_time(rows, spec.query_granularity)
    return assign_chunk(rows, spec.segment_granularity)


def _kept(timed: DataFrame, spec: IngestSpec) -> DataFrame:
    """Rows with a readable time inside the intervals; an interval holds no null, so one test does."""
    return filter_intervals(timed, spec.intervals) if spec.intervals else timed.where(F.col(TIME).isNotNull())


def metric_fields(spec: IngestSpec) -> list[str]:
    return sorted({m.field for m in spec.metrics if m.field})


def build(df: DataFrame, spec: IngestSpec) -> DataFrame:
    """Rows with one text column per field -> rows of the table.

    Rows without a readable time and rows outside the intervals are left out.
    """
    timed = df.withColumn(TIME, parse_time(F.col(f"`{spec.time_column}`"), spec.time_format))
    kept = _kept(timed, spec)
    inputs = metric_fields(spec)
    # a field may be a dimension and the input of a metric: keep its raw text apart
    raw = kept.select("*", *[F.col(f"`{f}`").alias(f"__in_{i}") for i, f in enumerate(inputs)])
    rows = select_dimensions(raw, spec.dimensions, keep=[TIME, *[f"__in_{i}" for i in range(len(inputs))]])
    return _finish(rows, _with_inputs(spec, inputs), spec.dimension_names)


def _with_inputs(spec: IngestSpec, inputs: list[str]) -> IngestSpec:
    place = {f: f"__in_{i}" for i, f in enumerate(inputs)}
    return replace(spec, metrics=tuple(replace(m, field=place[m.field]) if m.field else m for m in spec.metrics))


def _text_fields(spec: IngestSpec) -> list[str]:
    return list(dict.fromkeys([spec.time_column, *spec.dimension_names, *metric_fields(spec)]))


def build_lines(lines: DataFrame, spec: IngestSpec, column: str = "value") -> DataFrame:
    """Lines of JSON text -> rows of the table; dimensions are discovered if none is declared.

    A key that has the name of a metric is no dimension: the metric has the column.
    """
    if not spec.dimensions:
        metrics = [m.name for m in spec.metrics] if spec.rolls_up else []
        names = discover_names(lines, column, [*spec.exclusions, *metrics])
        spec = replace(spec, dimensions=tuple(Dimension(n) for n in names))
    return build(discover_dimensions(lines, column, names=_text_fields(spec)), spec)


def build_stream_rows(lines: DataFrame, spec: IngestSpec, column: str = "value") -> DataFrame:
    """Lines of JSON text -> ``__time``, ``__dims`` and the inputs of the metrics.

    The dimensions of a row are one JSON text with sorted keys, so no key has to
    be known first; ``expand_dimensions`` makes columns of those that are wanted.
    A line is parsed once: the exploded map keeps later tests from being moved
    below the parser, which would parse again.
    """
    inputs = metric_fields(spec)
    parsed = F.from_json(F.col(column), "map<string,string>")
    opened = lines.select(F.explode(F.array(parsed)).alias("__doc"))
    if spec.dimensions:
        listed = list(spec.dimension_names)
        found = F.map_filter("__doc", lambda k, _: k.isin(listed))
    elif spec.exclusions:
        left_out = list(spec.exclusions)
        found = F.map_filter("__doc", lambda k, _: ~k.isin(left_out))
    else:
        found = F.col("__doc")
    value = lambda name: F.try_element_at("__doc", F.lit(name))
    timed = opened.select(
        parse_time(value(spec.time_column), spec.time_format).alias(TIME),
        sorted_map_json(found).alias(DIMS),
        *[value(f).alias(f) for f in inputs],
    )
    return _kept(timed, spec).select(TIME, DIMS, *[F.col(f"`{f}`") for f in inputs])


def build_wide(lines: DataFrame, spec: IngestSpec, column: str = "value") -> DataFrame:
    """Lines of JSON text -> rows of the table with all dimensions in ``__dims``.

    For lines of any number of different keys: none becomes a column, so none
    is collected, and none can take the name of a metric. ``field_statistics``
    tells what keys there are.
    """
    return _finish(build_stream_rows(lines, spec, column), spec, [DIMS])


def field_statistics(rows: DataFrame, column: str = DIMS) -> DataFrame:
    """``field, rows, nulls, numbers, least, greatest`` of each key in the JSON texts of a column."""
    opened = rows.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("field", "v"))
    return opened.groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
        F.count(F.col("v").try_cast("double")).alias("numbers"),
        F.min("v").alias("least"),
        F.max("v").alias("greatest"),
    )


def expand_dimensions(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns for the named dimensions instead of ``__dims``."""
    ddl = ", ".join(f"`{n}` string" for n in names)
    rest = [c for c in df.columns if c != DIMS]
    return df.select(*rest, F.from_json(DIMS, ddl).alias("__d")).select(*rest, "__d.*")


def audit_lines(lines: DataFrame, spec: IngestSpec, column: str = "value") -> DataFrame:
    """The audit counts of a declaration over raw lines, per datasource."""
    if spec.dimensions:
        # only the declared fields are parsed; a broken line shows in the extra one
        ddl = ", ".join(f"`{f}` string" for f in [*_text_fields(spec), BAD_RECORD])
        doc = F.from_json(F.col(column), ddl, {"columnNameOfCorruptRecord": BAD_RECORD})
        ok = F.col("__doc").isNotNull() & F.col(f"__doc.{BAD_RECORD}").isNull()
        raw_time = F.col(f"__doc.`{spec.time_column}`")
        dims = [F.col(f"__doc.`{d}`") for d in spec.dimension_names]
    else:
        doc = F.from_json(F.col(column), "map<string,string>")
        ok = F.col("__doc").isNotNull()
        raw_time = F.try_element_at("__doc", F.lit(spec.time_column))
        left_out = list(spec.exclusions)
        dims = [sorted_map_json(F.map_filter("__doc", lambda k, _: ~k.isin(left_out)))]
    rows = lines.select(F.lit(spec.data_source).alias("dataSource"), F.col(column).alias("__line"), doc.alias("__doc"))
    timed = rows.withColumn(TIME, parse_time(raw_time, spec.time_format))
    output = F.struct(truncated(F.col(TIME), spec.query_granularity), *dims) if spec.rolls_up else None
    # lines are told apart by their hash, so that whole lines need not be shuffled
    line = F.unhex(F.sha1("__line"))
    return ingest_audit(timed, ok, spec.intervals, line, output, by=["dataSource"])


def ingest(spark: SparkSession, spec: IngestSpec, root: str, base_dir: str, glob: str = "*.json*") -> str:
    """Read the declared files and write the table; gives its path."""
    if spec.dimensions:
        rows = build(read_json(spark, base_dir, glob, text_fields=_text_fields(spec)), spec)
    else:
        rows = build_lines(read_lines(spark, base_dir, glob), spec)
    return write_datasource(
        rows, root, spec.data_source, "append" if spec.append else "replace", spec.max_rows_per_segment
    )
