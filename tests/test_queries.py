"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import os

import pytest

from check import compare, connect
from tidemark.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

STREAMS = {name for name in QUERIES if name.startswith("stream_")}
WITH_PYTHON = {"json_equal", "json_includes", "json_drift"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # estimates only
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_has_no_slow_nodes(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    if name not in WITH_PYTHON:
        assert "Python" not in plan


def test_distinct_theta_is_exact_beyond_the_sketch(spark, tmp_path):
    from datetime import datetime

    from tidemark.plans.queries.ingest_queries import distinct_theta

    day, other = datetime(2024, 1, 1, 5), datetime(2024, 1, 2, 5)
    rows = [(i, day, i % 9000, "click", 1.0, None) for i in range(12000)] + [(12000, other, None, "view", 1.0, None)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((str(r["__time"]), r["users"]) for r in distinct_theta(spark, str(tmp_path)).collect())
    assert got == [("2024-01-01 00:00:00", 9000), ("2024-01-02 00:00:00", 0)]
