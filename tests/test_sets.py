import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.maps import concat_scopes, first_non_empty, labels_match, merge_maps
from tidemark.functions.metric_map import METRIC_MAP
from tidemark.functions.quantity import quantity
from tidemark.operators import metrics as M
from tidemark.operators import overlay as V
from tidemark.operators import status as S
from tidemark.operators import sync


def test_sync_plan(spark):
    desired = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z"), ("e", 5, None)], "k string, v int, w string")
    current = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 4, "q"), ("e", 5, None)], "k string, v bigint, w string")
    plan = sync.plan_sync(desired, current, ["k"])
    assert {r["k"]: r["action"] for r in plan.collect()} == {"a": "noop", "b": "update", "c": "create", "d": "delete", "e": "noop"}
    assert [r["k"] for r in sync.survivors(plan, ["k"]).collect()] == ["a", "b", "c", "e"]
    nothing = sync.plan_sync(desired.where("false"), current, ["k"])
    assert {r["action"] for r in nothing.collect()} == {"delete"}


def sweep(spark, owners, ages):
    as_of = datetime(2024, 1, 31, 12)
    rows = [(f"i{n}", None if age is None else as_of - timedelta(seconds=age)) for n, age in enumerate(ages)]
    items = spark.createDataFrame(rows, "name string, marked_at timestamp")
    df = spark.createDataFrame(owners, "refs array<string>, pending boolean, healthy boolean")
    got = sync.sweep_orphans(items, df, "2024-01-31 12:00:00").orderBy("name").collect()
    return [r["action"] for r in got]


def test_sweep_grace(spark):
    assert sweep(spark, [(["x"], False, True)], [None, 0, 59, 60, 61]) == ["mark", "wait", "wait", "delete", "delete"]


def test_sweep_references(spark):
    owners = [(["i0", "i1", "i1"], False, True), (["i1"], False, True), (["i2"], True, True), (None, False, True)]
    # a pending owner does not hold its item
    assert sweep(spark, owners, [None, 100, 100]) == ["keep", "unmark", "delete"]


def test_sweep_gate(spark):
    assert sweep(spark, [(["i0"], False, False), (["x"], False, True)], [None, 100]) == ["keep", "keep"]
    assert sweep(spark, [], [None]) == ["mark"]


def test_order_by_rank(spark):
    kinds = ["router", "broker", "historical", "coordinator", "middleManager", "overlord", "indexer", "historical", "other"]
    df = spark.createDataFrame([(f"n{i}", k) for i, k in enumerate(kinds)], "key string, kind string")
    got = [(r["kind"], r["key"]) for r in sync.order_by_rank(df, "kind", "key").collect()]
    assert got == [
        ("historical", "n2"),
        ("historical", "n7"),
        ("overlord", "n5"),
        ("middleManager", "n4"),
        ("indexer", "n6"),
        ("broker", "n1"),
        ("coordinator", "n3"),
        ("router", "n0"),
    ]


def test_deny(spark):
    df = spark.createDataFrame([("a",), ("b",), (" b",), (None,), ("",)], "ns string")
    assert sync.deny(df, "ns", "").count() == 5
    assert [r["ns"] for r in sync.deny(df, "ns", "a, b").collect()] == ["b", None, ""]


def test_flags_and_labels(spark):
    df = spark.createDataFrame([(1, {"i": "true", "a": "x"}), (2, {"i": "True"}), (3, {}), (4, None)], "n int, m map<string,string>")
    assert [r["n"] for r in sync.drop_flagged(df, "m", "i").collect()] == [2, 3, 4]
    assert [r["n"] for r in sync.match_labels(df, "m", {"i": "true", "a": "x"}).collect()] == [1]
    assert df.where(labels_match(F.col("m"), {})).count() == 4


def test_overlay(spark):
    df = spark.createDataFrame([("", "w", None, 1), (None, "w", 0, 1), ("n", "w", None, None)], "a string, b string, c int, d int")
    got = V.overlay(df, {"x": ("a", "b"), "y": ("c", "d")}).collect()
    assert [(r["x"], r["y"]) for r in got] == [("w", 1), ("w", 0), ("n", None)]
    assert df.select(first_non_empty(F.lit(None).cast("string"), F.lit("")).alias("x")).first()["x"] == ""


def test_map_merge(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1"}, {"b": "2", "c": "2"}), (None, {"a": "2"}), ({"a": "1"}, None), (None, None)],
        "w map<string,string>, n map<string,string>",
    )
    forced = F.create_map(F.lit("c"), F.lit("3"))
    got = [r[0] for r in df.select(merge_maps(F.col("w"), F.col("n"), forced)).collect()]
    assert got == [{"a": "1", "b": "2", "c": "3"}, {"a": "2", "c": "3"}, {"a": "1", "c": "3"}, {"c": "3"}]
    plain = [r[0] for r in df.select(merge_maps(F.col("w"), F.col("n"))).collect()]
    assert plain == [{"a": "1", "b": "2", "c": "2"}, {"a": "2"}, {"a": "1"}, {}]


def test_concat_scopes(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["b"]), (["a"], None), (None, None)], "w array<string>, n array<string>")
    assert [r[0] for r in df.select(concat_scopes(F.col("w"), F.col("n"))).collect()] == [["a", "b", "b"], ["b"], ["a"], []]


def test_referenced_maps(spark):
    maps = spark.createDataFrame([("m1", {"a": "1", "b": "1"}), ("m2", {"b": "2", "c": None})], "name string, data map<string,string>")
    rows = [("x", ["m1", "m2"]), ("y", ["m2", "gone", "m1"]), ("z", ["gone"]), ("e", []), ("n", None)]
    df = spark.createDataFrame(rows, "key string, refs array<string>")
    got = {r["key"]: r["merged"] for r in V.merge_referenced(df, "key", "refs", maps).collect()}
    assert got == {
        "x": {"a": "1", "b": "2", "c": None},
        "y": {"a": "1", "b": "1", "c": None},
        "z": {},
        "e": {},
        "n": {},
    }


def test_duplicates(spark):
    rows = [("g1", n, i) for i, n in enumerate("abcbaa")] + [("g2", n, i) for i, n in enumerate("ab")] + [("g3", "x", i) for i in range(3000)]
    got = V.find_duplicates(spark.createDataFrame(rows, "g string, n string, p int"), "g", "n", "p")
    assert sorted(tuple(r) for r in got.collect()) == [("g1", "b", 3), ("g3", "x", 1)]
    # a hot name is cut down in each task before the shuffle
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_validation(spark):
    df = spark.createDataFrame([("ok-1", "img"), ("___", ""), ("UPPERlower", None)], "key string, image string")
    checks = [
        (F.col("image") != "", F.lit("image missing;")),
        (F.col("key").rlike(r"[a-z0-9]([-a-z0-9]*[a-z0-9])?"), F.format_string("bad key %s;", "key")),
    ]
    assert [r["message"] for r in V.validate(df, checks).collect()] == ["", "image missing;bad key ___;", "image missing;"]


def test_quantity(spark):
    cases = {
        "2Gi": 2 * 1024**3,
        "2.2Ti": Decimal("2.2") * 1024**4,
        "1k": 1000,
        "1K": None,
        "500m": Decimal("0.5"),
        "1e3": 1000,
        "1E": 10**18,
        "5": 5,
        "1.5Ki": 1536,
        "5n": Decimal("0.000000005"),
        "8Ei": 8 * 1024**6,
        "-1.25Mi": Decimal("-1.25") * 1024**2,
        "7E": 7 * 10**18,
        "2e-3": Decimal("0.002"),
        "1073741824Ki": 1024**4,
        "12345678901.5Ki": Decimal("12345678901.5") * 1024,
        "": None,
        "Gi": None,
        "x": None,
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r["q"] for r in df.select("i", quantity(F.col("t")).alias("q")).orderBy("i").collect()]
    assert got == list(cases.values())


def drift(spark, desired, current, claims):
    df = spark.createDataFrame([(1, desired, current, claims)], "k int, desired array<string>, current array<string>, claims array<string>")
    return sorted((r["position"], r["action"], r["claim"]) for r in V.capacity_drift(df, "k").collect())


def test_capacity(spark):
    assert drift(spark, ["1Gi"], ["1024Mi"], ["1Gi"]) == []
    got = drift(spark, ["2Gi"], ["1Gi"], ["1Gi", "2Gi"])
    assert {x[:2] for x in got} == {(0, "patch"), (0, "recreate")} and len(got) == 2


@pytest.mark.parametrize(
    ("desired", "current", "claims", "steps"),
    [
        # a smaller quantity stops everything after it
        (["1Gi", "5Gi"], ["2Gi", "1Gi"], ["1Gi", "1Gi"], [(0, "reject")]),
        (["5Gi", "1Gi"], ["5Gi", "2Gi"], ["5Gi", "5Gi"], [(1, "reject")]),
        # fewer claims than desired: nothing
        (["2Gi", "2Gi"], ["1Gi", "1Gi"], ["1Gi"], []),
        ([], [], ["1Gi"], []),
        (["2.2Ti"], ["2.2Ti"], ["2.2Ti"], []),
        (["lots"], ["2Gi"], ["2Gi"], [(0, "invalid")]),
        (["1Gi", "1Gi"], ["1Gi"], ["1Gi", "1Gi"], [(1, "invalid")]),
        (["1Gi"], ["1Gi"], ["x"], [(0, "patch")]),
    ],
)
def test_capacity_steps(spark, desired, current, claims, steps):
    assert [x[:2] for x in drift(spark, desired, current, claims)] == steps


CONDITIONS = "array<struct<type:string,status:string,reason:string>>"


def test_health(spark):
    bad, good = [("Ready", "False", "why")], [("Ready", "True", None)]
    rows = [
        ("g", 1, "a", bad),
        ("g", 2, "b", [("Ready", "False", "first"), ("Ready", "False", "last")]),
        ("g", 3, "c", good),
        ("h", 1, "a", good),
        ("h", 2, "b", None),
        ("i", 1, "a", [("Other", "False", "x"), ("Ready", "Unknown", "x")]),
    ]
    df = spark.createDataFrame(rows, f"g string, p int, name string, conditions {CONDITIONS}")
    got = {r["g"]: (r["status"], r["member"], r["reason"]) for r in S.health_rollup(df, "g", "p").collect()}
    ready = ("ready", "All", "all members are ready")
    assert got == {"g": ("error", "b", "last"), "h": ready, "i": ready}


def test_crash_loops(spark):
    not_ready, ready = [("ContainersReady", "False", None)], [("ContainersReady", "True", None)]
    rows = [
        (1, "Failed", None, None),
        (2, "Unknown", ready, []),
        (3, "Running", not_ready, [("c", 1), ("d", 2)]),
        (4, "Running", not_ready, [("c", 1)]),
        (5, "Running", ready, [("c", 9)]),
        (6, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, f"n int, phase string, conditions {CONDITIONS}, containers array<struct<name:string,restartCount:int>>"
    )
    assert [r["n"] for r in S.find_crash_loops(df).collect()] == [1, 2, 3]


def test_rollout(spark):
    ok = [("Progressing", "True", None)]
    rows = [
        ("set", "r1", "r1", 3, 3, 3, None, True, None),
        ("set", "r1", "r2", 3, 3, 3, None, False, None),
        ("set", "r1", "r1", 3, 3, 2, None, False, None),
        ("deployment", None, None, 3, None, 3, ok, True, None),
        ("deployment", None, None, 3, None, 2, ok, False, None),
        ("deployment", None, None, 3, None, 3, [], False, None),
        ("deployment", None, None, 3, None, 3, [("Progressing", "False", "x"), *ok], False, None),
        ("deployment", None, None, 3, None, 3, [("ReplicaFailure", "True", "quota"), *ok], False, "quota"),
        # only the first condition counts
        ("deployment", None, None, 3, None, 3, [*ok, ("ReplicaFailure", "True", "quota")], True, None),
        ("other", None, None, 3, None, 3, ok, False, None),
    ]
    df = spark.createDataFrame(
        [(i, *r[:7]) for i, r in enumerate(rows)],
        "i int, kind string, current_revision string, update_revision string, replicas int, current_replicas int, "
        f"ready_replicas int, conditions {CONDITIONS}",
    )
    got = S.rollout_progress(df).orderBy("i").collect()
    assert [(r["done"], r["error"]) for r in got] == [r[7:] for r in rows]


def test_changes_and_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, None), ("b", 2, "y")]
    df = spark.createDataFrame(rows, "k string, o bigint, s string")
    got = sorted((r["k"], r["o"], r["previous"], r["is_first"]) for r in S.status_changes(df, "k", ["o"], "s").collect())
    assert [x[:2] for x in got] == [("a", 1), ("a", 3), ("a", 5), ("b", 1), ("b", 2)]
    assert [x[3] for x in got] == [True, False, False, True, False]
    assert sorted(tuple(r) for r in S.latest_state(df, "k", ["o"]).collect()) == [("a", 5, "x"), ("b", 2, "y")]
    # an order by text needs nothing more
    by_text = S.status_changes(df, "k", ["s", "o"], "s").collect()
    assert sorted((r["k"], r["o"]) for r in by_text) == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]


def test_metric_map(spark):
    parsed = json.loads(METRIC_MAP)
    kinds = [d["type"] for d in parsed.values()]
    assert (len(kinds), kinds.count("timer"), kinds.count("count"), kinds.count("gauge")) == (127, 14, 49, 64)
    assert sum(bool(d.get("convertRange")) for d in parsed.values()) == 3
    rows = [
        ("2024-01-01 10:00:00", "query/bytes", {"dataSource": "p", "type": "t", "host": "h1"}, 1.0),
        ("2024-01-01 10:30:00", "query/bytes", {"dataSource": "p", "type": "t", "host": "h2"}, 2.0),
        ("2024-01-01 10:10:00", "segment/usedPercent", {"tier": "hot"}, 0.25),
        ("2024-01-01 10:20:00", "segment/usedPercent", {"tier": "hot"}, 0.5),
        ("2024-01-01 10:00:00", "query/node/time", {"server": "s"}, 10.0),
        ("2024-01-01 10:00:01", "query/node/time", {"server": "s"}, 30.0),
        ("2024-01-01 10:00:00", "not/defined", {}, 1.0),
    ]
    df = spark.createDataFrame(rows, "t string, metric string, dims map<string,string>, value double")
    df = df.select(F.col("t").cast("timestamp").alias("ts"), "metric", "dims", "value")
    got = {r["metric"]: r for r in M.rollup_metrics(df, M.metric_definitions(spark, METRIC_MAP)).collect()}
    assert set(got) == {"query/bytes", "segment/usedPercent", "query/node/time"}
    assert (got["query/bytes"]["dims"], got["query/bytes"]["value"]) == ('{"dataSource":"p","type":"t"}', 3.0)
    assert got["segment/usedPercent"]["value"] == 50.0
    timer = got["query/node/time"]
    assert [timer[c] for c in ("value", "count", "mean", "min", "max", "p50", "p99")] == [None, 2, 20.0, 10.0, 30.0, 10.0, 30.0]


def test_unknown_health_stops_the_sweep(spark):
    owners = [(["x"], False, None), (["y"], False, True)]
    assert sweep(spark, owners, [None, 0, 100]) == ["keep", "keep", "keep"]
