import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.chunks import assign_segment, chunk_summary, compact
from tidemark.operators.ordering import BUCKET, bucketed, previous_values, row_numbers, running
from tidemark.operators.retention import (
    apply_retention,
    assign_rules,
    assign_tiers,
    broadcast_lookup,
)
from tidemark.operators.documents import rules_to_rows
from tidemark.operators.rule_table import assign_rules_by_source, rule_bounds
from tidemark.operators.shape import assign_chunk
from tidemark.plans.maintain import compact_datasource, retain_datasource
from tidemark.sources.tables import read_datasource, write_datasource
from tidemark.spec import CHUNK, SEGMENT, TIME, Metric, Rule

START = datetime(2024, 1, 1)


def skewed(spark, seed, n=600):
    """One key owns a third of the rows; keys and values may be null."""
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [
        (
            "hot" if rnd.random() < 0.34 else rnd.choice(["a", "b", "c", None]),
            start + timedelta(minutes=rnd.randrange(2000)),
            i,
            rnd.choice(["up", "down", None]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, t timestamp, i int, s string").repartition(5)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("buckets", [2, 7, 64, None])
def test_row_numbers_equal_a_plain_window(spark, seed, buckets):
    df = skewed(spark, seed)
    got = row_numbers(df, ["k"], ["t", "i"], "rn", buckets)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("buckets", [2, 7, 64, None])
def test_previous_equals_a_plain_lag(spark, seed, buckets):
    df = skewed(spark, seed)
    got = previous_values(df, ["k"], ["t", "i"], "s", "p", buckets)
    want = df.withColumn("p", F.lag(F.struct(F.col("s").alias("value"))).over(Window.partitionBy("k").orderBy("t", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_running_folds_equal_a_plain_window(spark, buckets):
    df = skewed(spark, 5).withColumn("x", F.when(F.col("i") % 7 > 0, F.col("i")))
    folds = {
        "total": (F.sum, lambda a, b: a + b, F.col("x")),
        "bits": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), F.xxhash64("i")),
        "least": (F.min, F.least, F.col("x")),
    }
    got = running(df, ["k"], ["t", "i"], folds, buckets)
    before = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns(
        {"total": F.sum("x").over(before), "bits": F.bit_xor(F.xxhash64("i")).over(before), "least": F.min("x").over(before)}
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


EVEN = {
    "one group": ("'g'", "timestamp_seconds(id)"),
    "one minute": ("id % 3", "timestamp_micros(id)"),
    "one date": ("'g'", "date'2024-01-01'"),
    "text order": ("'g'", "concat('the same long beginning of every text ', id)"),
    "many groups": ("id div 2", "id"),
}


@pytest.mark.parametrize("case", EVEN)
def test_no_bucket_is_far_above_its_share(spark, case):
    group, order = EVEN[case]
    df = spark.range(20_000).selectExpr(f"{group} AS g", f"{order} AS o", "id")
    buckets = bucketed(df, ["g"], ["o", "id"], 16)
    sizes = [r["n"] for r in buckets.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    got = row_numbers(df, ["g"], ["o", "id"], "rn", 16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert got.exceptAll(want).isEmpty() and got.count() == 20_000


def test_ordering_of_no_rows(spark):
    df = skewed(spark, 1).where("i < 0")
    assert row_numbers(df, ["k"], ["t", "i"], "rn").count() == 0
    assert previous_values(df, ["k"], ["t"], "s", "p").count() == 0


@pytest.mark.parametrize("buckets", [4, 40])
def test_segments_are_full_and_ordered(spark, buckets):
    df = assign_chunk(skewed(spark, 9).withColumnRenamed("t", TIME), "DAY")
    got = assign_segment(df, ["i"], max_rows=50, buckets=buckets)
    sizes = got.groupBy(CHUNK, SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("a"), F.max(TIME).alias("b")).collect()
    for chunk in {r[CHUNK] for r in sizes}:
        parts = sorted((r for r in sizes if r[CHUNK] == chunk), key=lambda r: r[SEGMENT])
        assert [p[SEGMENT] for p in parts] == list(range(len(parts)))
        assert all(p["n"] == 50 for p in parts[:-1]) and parts[-1]["n"] <= 50
        assert all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:]))
    assert sum(r["n"] for r in sizes) == 600


def hours(spark, n):
    df = spark.range(n).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id"))).alias(TIME), F.lit(1).cast("bigint").alias("n")
    )
    return assign_chunk(df, "HOUR")


def test_skip_offset_keeps_late_chunks(spark):
    metrics = [Metric("n", "count")]
    # the latest chunk ends at 2024-01-03 00:00
    df = hours(spark, 48)
    all_merged = compact(df, "DAY", [], metrics, query_granularity="DAY", skip_offset="PT0S", current_grain="HOUR")
    assert sorted(r["n"] for r in all_merged.collect()) == [24, 24]
    partly = compact(df, "DAY", [], metrics, query_granularity="DAY", skip_offset="PT24H", current_grain="HOUR")
    assert sorted(r["n"] for r in partly.collect()) == [1] * 24 + [24]
    # a chunk that ends exactly at the border is settled
    border = compact(df, "DAY", [], metrics, query_granularity="DAY", skip_offset="PT1H", current_grain="HOUR")
    assert sorted(r["n"] for r in border.collect()) == [1, 23, 24]
    with pytest.raises(ValueError):
        compact(df, "DAY", skip_offset="PT1H")


def test_compaction_without_metrics_keeps_rows(spark):
    assert compact(hours(spark, 48), "DAY").count() == 48
    assert compact(hours(spark, 0), "DAY", [], [Metric("n", "count")], skip_offset="P1D", current_grain="HOUR").count() == 0


def test_chunk_summary(spark):
    got = chunk_summary(assign_chunk(hours(spark, 30).drop(CHUNK), "DAY"), max_rows=10).orderBy(CHUNK).collect()
    assert [(r["rows"], r["segments"]) for r in got] == [(24, 3), (6, 1)]


def day_chunks(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp").alias(CHUNK))


def actions(spark, rules, as_of, *days):
    got = assign_rules(day_chunks(spark, *days), rules, as_of, "DAY").orderBy(CHUNK).collect()
    return [r["action"] for r in got]


def test_rule_edges(spark):
    drop = Rule("drop", interval="2012-01-01/2013-01-01")
    assert actions(spark, [drop], "2024-01-01", "2011-12-31", "2012-01-01", "2012-12-31", "2013-01-01") == ["keep", "drop", "drop", "keep"]
    week = Rule("dropByPeriod", period="P7D")
    days = ["2024-01-23", "2024-01-24", "2024-01-30", "2024-01-31", "2024-02-05"]
    assert actions(spark, [week], "2024-01-31", *days) == ["keep", "drop", "drop", "keep", "keep"]
    future = Rule("dropByPeriod", period="P7D", include_future=True)
    assert actions(spark, [future], "2024-01-31", *days) == ["keep", "drop", "drop", "drop", "drop"]
    lookup = Rule("broadcastByPeriod", period="P7D")
    assert actions(spark, [lookup], "2024-01-31T12:00:00Z", *days) == ["keep", "broadcast", "broadcast", "broadcast", "keep"]


def test_first_match_decides(spark):
    forever, week = Rule("loadForever"), Rule("dropByPeriod", period="P7D")
    assert actions(spark, [forever, week], "2024-01-31", "2024-01-30") == ["load"]
    assert actions(spark, [week, forever], "2024-01-31", "2024-01-30", "2024-01-01") == ["load", "drop"]
    assert actions(spark, [], "2024-01-31", "2024-01-30") == ["keep"]
    with pytest.raises(ValueError):
        actions(spark, [Rule("loadSometimes")], "2024-01-31", "2024-01-30")


def test_month_period_clamps(spark):
    month = Rule("dropByPeriod", period="P1M")
    assert actions(spark, [month], "2024-03-31", "2024-02-28", "2024-02-29") == ["keep", "drop"]


def test_tiers(spark):
    rules = [Rule("dropByPeriod", period="P7D"), Rule("load", tiers={"hot": 2, "cold": 1})]
    got = assign_tiers(day_chunks(spark, "2024-01-30", "2024-01-01"), rules, "2024-01-31", "DAY").collect()
    assert sorted((r["tier"], r["replicas"]) for r in got) == [("cold", 1), ("hot", 2)]


def test_retention_filters_on_the_chunk_alone(spark):
    df = assign_chunk(hours(spark, 72).drop(CHUNK), "DAY")
    assert apply_retention(df, [Rule("drop", interval="2024-01-02/2024-01-03")], "2024-02-01", "DAY").count() == 48


@pytest.mark.parametrize("threshold", [-1, 10_000_000])
def test_lookup_joins_the_same_with_and_without_broadcast(spark, threshold):
    fact = spark.range(100).select((F.col("id") % 7).alias("k"))
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = broadcast_lookup(fact, lookup, "k")
        assert joined.count() == sum(1 for i in range(100) if i % 7 < 5)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_maintenance_never_overwrites_its_input(spark, folder):
    write_datasource(hours(spark, 30), folder, "x")
    for bad in (
        lambda: compact_datasource(spark, folder, "x", "x", "DAY"),
        lambda: retain_datasource(spark, folder, "x", "x", [], "2024-02-01", "HOUR"),
    ):
        with pytest.raises(ValueError):
            bad()
    # a second run replaces what the first one wrote
    for _ in range(2):
        compact_datasource(spark, folder, "x", "y", "DAY", [], [Metric("n", "count")], "DAY")
    assert sorted(r["n"] for r in read_datasource(spark, folder, "y").collect()) == [6, 24]
    retain_datasource(spark, folder, "y", "z", [Rule("drop", interval="2024-01-01/2024-01-02")], "2024-02-01", "DAY")
    assert [r["n"] for r in read_datasource(spark, folder, "z").collect()] == [6]


def test_second_runs_replace_the_target(spark, folder):
    write_datasource(hours(spark, 30), folder, "x")
    for grain in ("DAY", "MONTH"):
        compact_datasource(spark, folder, "x", "y", grain, [], [Metric("n", "count")], grain, partial=False)
        assert sum(r["n"] for r in read_datasource(spark, folder, "y").collect()) == 30
    inside = read_datasource(spark, folder, "y", ["2024-01-01/2024-01-02"])
    assert [r["n"] for r in inside.collect()] == [30]
    for end, left in (("2024-01-01T06:00", 24), ("2024-01-01T12:00", 18)):
        retain_datasource(spark, folder, "x", "z", [Rule("drop", interval=f"2024-01-01/{end}")], "2024-02-01", "HOUR")
        assert read_datasource(spark, folder, "z").count() == left


def test_month_table_is_read_without_a_grain(spark, folder):
    write_datasource(assign_chunk(hours(spark, 40).drop(CHUNK), "MONTH"), folder, "m")
    assert read_datasource(spark, folder, "m", ["2024-01-02/2024-01-03"]).count() == 16


def test_rule_rows_decide_as_rule_lists(spark):
    """Many datasources, each with its own rules and one with most of the chunks, against the list of each; broken rules match nothing."""
    rnd = random.Random(8)
    kinds = [
        lambda: {"type": "drop", "interval": f"2024-0{rnd.randrange(1, 4)}-1{rnd.randrange(10)}/2024-0{rnd.randrange(3, 6)}-2{rnd.randrange(9)}T0{rnd.randrange(9)}"},
        lambda: {"type": "dropByPeriod", "period": rnd.choice(["P1M", "P40D", "P1W", "PT36H"]), "includeFuture": rnd.random() < 0.5},
        lambda: {"type": "broadcastByPeriod", "period": rnd.choice(["P2M", "P3D"]), "includeFuture": rnd.random() < 0.5},
        lambda: {"type": "load"} if rnd.random() < 0.3 else {"type": "drop", "interval": "2024-02-10/2024-02-11"},
    ]
    lists = {f"s{i}": [rnd.choice(kinds)() for _ in range(rnd.randrange(5))] for i in range(12)}
    documents = [(k, json.dumps(v)) for k, v in lists.items()] + [("odd", '[{"type":"drop"},{"type":"dropByPeriod","period":"1D"},{"type":"x"},7,{"type":"load"}]')]
    days = [START + timedelta(days=rnd.randrange(200)) for _ in range(150)]
    rows = [("s3" if rnd.random() < 0.5 else f"s{rnd.randrange(12)}", d) for d in days] + [("odd", days[0]), ("none", days[1]), ("s1", days[2])]
    chunks = spark.createDataFrame(sorted(set(rows)), f"k string, {CHUNK} timestamp").withColumn("__end", F.col(CHUNK) + F.expr("INTERVAL 1 DAY"))
    table = rules_to_rows(spark.createDataFrame(documents, "k string, rules string"), "k")
    got = {(r["k"], r[CHUNK]): (r["rule_index"], r["rule_type"], r["action"]) for r in assign_rules_by_source(chunks, table, "k", "2024-04-15").collect()}
    want = {}
    for k, rules in lists.items():
        own = assign_rules(chunks.where(F.col("k") == k), [Rule.parse(r) for r in rules], "2024-04-15", "DAY").collect()
        want.update({(k, r[CHUNK]): (r["rule_index"], r["rule_type"], r["action"]) for r in own})
    want[("odd", days[0])] = (4, "load", "load")
    want[("none", days[1])] = (None, None, "keep")
    assert got == want
    faults = {r["position"]: r["fault"] for r in rule_bounds(table.where("k = 'odd'"), "k", "2024-04-15").collect()}
    assert faults == {0: "rule needs an interval", 1: "rule needs a period", 2: "unknown rule type", 3: "error unmarshalling rule", 4: None}
