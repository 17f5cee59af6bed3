import gzip
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import parse_time
from tidemark.operators import shape
from tidemark.operators.rollup import ingest_audit, merge_rollup, rollup
from tidemark.plans.ingest import DIMS, audit_lines, build_lines, build_stream_rows, build_wide, field_statistics, ingest
from tidemark.sources.files import BAD_RECORD, read_json, read_lines, to_object_lines, write_object_lines
from tidemark.sources.streams import period_seconds, publish_trigger
from tidemark.sources.tables import read_datasource, write_datasource
from tidemark.spec import CHUNK, TIME, Dimension, IngestSpec, Metric


def at(text):
    return datetime.fromisoformat(text)


def times(spark, texts, fmt):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", parse_time(F.col("t"), fmt).alias("x")).orderBy("i").collect()]


def test_iso_time(spark):
    texts = ["2015-09-12T00:46:58.771Z", "2015-09-12", "2015-09-12 01:02:03", " 2015-09-12T02:00:00+02:00 ", None, "", "x", "12:00:00", "1442018818771", "2015", "12:3", "1-2-3"]
    assert times(spark, texts, "iso") == [
        at("2015-09-12T00:46:58.771"),
        at("2015-09-12"),
        at("2015-09-12T01:02:03"),
        at("2015-09-12"),
        None,
        None,
        None,
        None,
        None,
        at("2015-01-01"),
        None,
        None,
    ]


def test_auto_time(spark):
    texts = ["1442018818771", "0", "-1", "2015-09-12T00:46:58.771Z", "9" * 30, "9223372036854775807", "1.5", None]
    assert times(spark, texts, "auto") == [
        at("2015-09-12T00:46:58.771"),
        at("1970-01-01"),
        at("1969-12-31T23:59:59.999"),
        at("2015-09-12T00:46:58.771"),
        None,
        None,
        None,
        None,
    ]
    with pytest.raises(ValueError):
        parse_time(F.lit("x"), "posix")


def test_long_dimension(spark):
    df = spark.createDataFrame([("5",), ("5.7",), ("-5.7",), ("x",), (None,), ("9223372036854775808",), (" 7 ",)], "a string")
    got = [r[0] for r in df.select(shape.dimension_value(F.col("a"), "long")).collect()]
    assert got == [5, 5, -5, None, None, None, 7]


def test_discovery(spark):
    lines = [{"t": 1, "b": "x", "n": {"q": 1}}, {"t": 2, "a b": 5.70, "value": 3}, {"t": 3, "b": None}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("broken",)], "value string")
    assert shape.discover_names(df, "value", ["t", "value"]) == ["a b", "b", "n"]
    got = shape.discover_dimensions(df, "value", ["t", "value"]).collect()
    assert [tuple(r) for r in got] == [(None, "x", '{"q":1}'), ("5.7", None, None), (None, None, None), (None, None, None)]
    assert shape.discover_names(df.where("false"), "value") == []


def test_lines_of_many_keys_need_no_columns(spark):
    lines = [{"t": "2024-01-01", f"k{i % 5}": i % 3, "n": 1, "deep": {"b": 1, "a": [i % 2]}} for i in range(60)] + [{"t": "x"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("broken",), ('{"t":"2024-01-01","e":null}',)], "value string")
    spec = IngestSpec("d", "t", exclusions=("t", "n"), metrics=(Metric("n", "doubleSum", "n"), Metric("k0", "count")))
    got = build_wide(df, spec)
    assert sorted(got.columns) == sorted([TIME, CHUNK, DIMS, "n", "k0"])
    rows = {r[DIMS]: (r["n"], r["k0"]) for r in got.collect()}
    assert len(rows) == 31 and rows['{"deep":"{\\"b\\":1,\\"a\\":[0]}","k0":"0"}'] == (2.0, 2)
    stats = {r["field"]: tuple(r)[1:] for r in field_statistics(build_stream_rows(df, spec)).collect()}
    assert stats["k3"] == (12, 0, 12, "0", "2") and stats["deep"][:3] == (60, 0, 0) and stats["e"][:2] == (1, 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_intervals_are_half_open(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 23:59:59.999999",), ("2024-01-02 00:00:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias(TIME))
    assert shape.filter_intervals(df, ["2024-01-01/2024-01-02"]).count() == 2
    assert shape.filter_intervals(df, ["2024-01-01/2024-01-02", "2024-01-02/2024-01-03"]).count() == 3
    assert shape.filter_intervals(df, []).count() == 4


def test_bad_lines_do_not_spoil_others(spark, folder):
    with gzip.open(os.path.join(folder, "a.json.gz"), "wt") as f:
        f.write('{"t":"2024-01-01","flag":false,"n":5.7}\nbroken\n{"t":"2024-01-02","n":"x"}\n')
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("not read")
    got = read_json(spark, folder, "*.json.gz", text_fields=["t", "flag", "n"])
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == [("2024-01-01", "false", "5.7", None), ("2024-01-02", None, "x", None), (None, None, None, "broken")]
    assert [r[BAD_RECORD] for r in got.where(F.col("t").isNull()).collect()] == ["broken"]
    assert read_lines(spark, folder, "*.json.gz").count() == 3


def test_object_lines_round_trip(spark, folder):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert [r["line"] for r in to_object_lines(df).collect()] == ['{"a":1,"b":"x"}', '{"a":2}']
    write_object_lines(df, f"{folder}/out")
    assert read_lines(spark, f"{folder}/out", "*.txt.gz").count() == 2


SPEC = IngestSpec(
    data_source="metrics",
    time_column="timestamp",
    time_format="auto",
    exclusions=("timestamp", "value"),
    metrics=(Metric("count", "count"), Metric("value_sum", "doubleSum", "value"), Metric("value_max", "doubleMax", "value")),
    segment_granularity="HOUR",
    query_granularity="minute",
    intervals=("2024-01-01/2024-01-02",),
)
LINES = [
    '{"timestamp":"2024-01-01T10:00:01Z","host":"a","value":1}',
    '{"timestamp":1704103202000,"host":"a","value":"2.5"}',
    '{"timestamp":"2024-01-01T10:01:00Z","host":"a","value":4}',
    '{"timestamp":"2024-01-01T10:01:00Z","host":"a","value":4}',
    '{"timestamp":"2024-01-01T10:00:03Z","zone":"z","value":null}',
    '{"timestamp":"2024-01-02T00:00:00Z","host":"a","value":1}',
    '{"timestamp":"never","host":"a","value":1}',
    "broken",
]


def test_lines_to_rolled_up_table(spark, folder):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    rows = build_lines(df, SPEC)
    got = {(str(r[TIME]), r["host"], r["zone"]): (r["count"], r["value_sum"], r["value_max"]) for r in rows.collect()}
    assert got == {
        ("2024-01-01 10:00:00", "a", None): (2, 3.5, 2.5),
        ("2024-01-01 10:01:00", "a", None): (2, 8.0, 4.0),
        ("2024-01-01 10:00:00", None, "z"): (1, None, None),
    }
    df.write.text(f"{folder}/in")
    ingest(spark, SPEC, f"{folder}/root", f"{folder}/in", "*.txt")
    assert read_datasource(spark, f"{folder}/root", "metrics").count() == 3


def test_audit(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    row = audit_lines(df, SPEC).first().asDict()
    assert row == {"dataSource": "metrics", "processed": 8, "unparseable": 2, "thrown_away": 1, "duplicate": 1, "output": 3}


def test_passthrough_keeps_rows(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    spec = IngestSpec("m", "timestamp", "auto", dimensions=(Dimension("host"), Dimension("value", "long")))
    assert build_lines(df, spec).count() == 6


def test_replace_touches_only_its_chunks(spark, folder):
    def rows(*pairs):
        df = spark.createDataFrame(list(pairs), "t string, v int")
        return shape.assign_chunk(df.select(F.col("t").cast("timestamp").alias(TIME), "v"), "DAY")

    def content():
        return sorted((str(r[TIME]), r["v"]) for r in read_datasource(spark, folder, "x").collect())

    write_datasource(rows(("2024-01-01 01:00:00", 1), ("2024-01-02 01:00:00", 2)), folder, "x", "replace")
    write_datasource(rows(("2024-01-02 05:00:00", 3)), folder, "x", "replace")
    assert content() == [("2024-01-01 01:00:00", 1), ("2024-01-02 05:00:00", 3)]
    write_datasource(rows(("2024-01-02 05:00:00", 3)), folder, "x", "append")
    assert content()[1:] == [("2024-01-02 05:00:00", 3)] * 2
    with pytest.raises(ValueError):
        write_datasource(rows(("2024-01-02 05:00:00", 3)), folder, "x", "merge")


def test_hot_chunk_is_cut_into_files(spark, folder):
    df = spark.range(1000).select(F.lit("2024-01-01").cast("timestamp").alias(TIME), "id")
    write_datasource(shape.assign_chunk(df, "DAY"), folder, "x", max_rows=100)
    files = [f for _, _, names in os.walk(f"{folder}/x") for f in names if f.endswith(".parquet")]
    assert len(files) >= 10
    assert read_datasource(spark, folder, "x").count() == 1000


def test_interval_read_prunes_partitions(spark, folder):
    df = spark.range(240).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id"))).alias(TIME), "id")
    write_datasource(shape.assign_chunk(df, "DAY"), folder, "x")
    got = read_datasource(spark, folder, "x", ["2024-01-03T12:00:00Z/2024-01-04T12:00:00Z"])
    assert sorted(r["id"] for r in got.collect()) == list(range(60, 84))
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({CHUNK}" in scan


def test_merged_partials_equal_direct(spark):
    df = spark.range(5000).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias(TIME),
        (F.col("id") % 3).cast("string").alias("k"),
        (F.col("id") % 97).cast("double").alias("v"),
    )
    metrics = [Metric("n", "count"), Metric("s", "doubleSum", "v", scale=2), Metric("lo", "doubleMin", "v"), Metric("hi", "doubleMax", "v")]
    two_steps = merge_rollup(rollup(df, ["k"], metrics, "HOUR"), ["k"], metrics, "DAY")
    assert sorted(map(tuple, two_steps.collect())) == sorted(map(tuple, rollup(df, ["k"], metrics, "DAY").collect()))


def test_sketches_are_close(spark):
    df = spark.range(20000).select(
        F.lit("2024-01-01").cast("timestamp").alias(TIME), (F.col("id") % 10 + F.lit(0)).alias("part"), F.col("id").cast("double").alias("v"), "id"
    )
    metrics = [Metric("theta", "thetaSketch", "v"), Metric("hll", "hllSketch", "id"), Metric("kll", "quantiles", "v")]
    whole = merge_rollup(rollup(df, ["part"], metrics, None), [], metrics, None)
    row = whole.select(
        F.theta_sketch_estimate("theta").alias("t"),
        F.hll_sketch_estimate("hll").alias("h"),
        F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("q"),
    ).first()
    assert abs(row["t"] - 20000) < 1000 and abs(row["h"] - 20000) < 1000 and abs(row["q"] - 10000) < 600


def test_dimensions_without_metrics_are_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string").withColumn(TIME, F.lit("2024-01-01").cast("timestamp"))
    assert rollup(df, ["k"], [], "DAY").count() == 2


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        rollup(spark.range(1).withColumn(TIME, F.current_timestamp()), [], [Metric("x", "longSum", "id")], None)


def test_trigger():
    assert publish_trigger({"taskDuration": "PT30M"}) == {"processingTime": "1800 seconds"}
    assert publish_trigger({}) == {"processingTime": "3600 seconds"}
    assert period_seconds("P1DT1S") == 86401
    with pytest.raises(ValueError):
        period_seconds("P1M")


def test_auto_time_reads_up_to_the_largest_timestamp(spark):
    texts = ["9100000000000000", "9223372036854775", "9223372036854776"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_time(F.col("t"), "auto").isNotNull()).collect()]
    assert got == [True, True, False]


def test_values_that_are_no_numbers_count_as_null(spark):
    df = spark.createDataFrame([("n/a",), ("2.5",), (None,), ("1e17",)], "v string").withColumn(TIME, F.lit("2024-01-01").cast("timestamp"))
    metrics = [Metric("n", "count"), Metric("s", "doubleSum", "v", 2), Metric("low", "doubleMin", "v"), Metric("high", "doubleMax", "v")]
    row = rollup(df, [], metrics, "DAY").first()
    assert (row["n"], row["s"], row["low"], row["high"]) == (4, 1e17 + 2.5, 2.5, 1e17)


def test_audit_folds_without_copies(spark):
    """Counts per datasource against plain counting, with a hot datasource and repeated lines; rows are not multiplied."""
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"d{i % 7}", rnd.choice([None, *range(20)]), rnd.random() < 0.9, f"line{rnd.randrange(150)}") for i in range(900)]
    rows = [(d, None if h is None else datetime(2024, 1, 1) + timedelta(hours=h), ok, f"{x}-{h}-{ok}") for d, h, ok, x in rows]
    df = spark.createDataFrame(rows, f"d string, {TIME} timestamp, ok boolean, line string").repartition(4)
    got = ingest_audit(df, F.col("ok"), ["2024-01-01T05:00/2024-01-01T15:00"], F.col("line"), F.col(TIME), ["d"])
    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        good = [r for r in own if r[2] and r[1]]
        kept = [r for r in good if 5 <= r[1].hour < 15]
        want[d] = (len(own), len(own) - len(good), len(good) - len(kept), len(kept) - len({r[3] for r in kept}), len({r[1] for r in kept}))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(ingest_audit(df.where("false"), F.col("ok"), [], F.col("line")).first()) == (0, 0, 0, 0, 0)


def test_a_key_named_like_a_metric_is_no_dimension(spark):
    lines = spark.createDataFrame([('{"t":"2024-01-01","a":"x","count":"7"}',), ('{"t":"2024-01-01","a":"x"}',)], "value string")
    spec = IngestSpec("d", "t", exclusions=("t",), metrics=(Metric("count", "count"),))
    got = build_lines(lines, spec)
    assert sorted(got.columns) == sorted([TIME, CHUNK, "a", "count"])
    assert [(r["a"], r["count"]) for r in got.collect()] == [("x", 2)]
