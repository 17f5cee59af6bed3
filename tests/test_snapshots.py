"""Versions of a table: mixed chunks, partial replacement, jobs that die or meet, removal."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.shape import assign_chunk
from tidemark.plans.maintain import compact_table, retain_table
from tidemark.sources import snapshots
from tidemark.sources.snapshots import (
    END,
    Conflict,
    commit,
    entries,
    forget,
    latest_version,
    read_snapshot,
    rewrite,
    uncovered,
    write_snapshot,
)
from tidemark.spec import CHUNK, TIME, Metric, Rule

START = datetime(2024, 1, 1)


def hours(spark, low, high, value=1):
    rows = [(START + timedelta(hours=i), value) for i in range(low, high)]
    return spark.createDataFrame(rows, f"{TIME} timestamp, v int")


def put(spark, folder, low, high, grain, mode="append", value=1):
    return write_snapshot(assign_chunk(hours(spark, low, high, value), grain), folder, "t", grain, mode)


def shown(spark, folder, **kw):
    return sorted((r[TIME], r["v"]) for r in read_snapshot(spark, folder, "t", **kw).collect())


def expected(*parts):
    return sorted((START + timedelta(hours=i), v) for low, high, v in parts for i in range(low, high))


def test_replacement_goes_by_time(spark, folder):
    put(spark, folder, 0, 72, "DAY")
    put(spark, folder, 30, 33, "HOUR", "replace", 2)
    assert shown(spark, folder) == expected((0, 30, 1), (30, 33, 2), (33, 72, 1))
    put(spark, folder, 31, 32, "HOUR", "replace", 3)
    assert shown(spark, folder) == expected((0, 30, 1), (30, 31, 2), (31, 32, 3), (32, 33, 2), (33, 72, 1))
    inside = shown(spark, folder, intervals=["2024-01-02T05:00/2024-01-02T09:00"])
    assert inside == expected((29, 30, 1), (30, 31, 2), (31, 32, 3), (32, 33, 2))
    # a longer chunk hides all of it; another day stays
    put(spark, folder, 24, 26, "DAY", "replace", 4)
    assert shown(spark, folder) == expected((0, 24, 1), (24, 26, 4), (48, 72, 1))
    # and the versions before are still there
    assert shown(spark, folder, version=0) == expected((0, 72, 1))
    assert latest_version(spark, folder, "t") == 3


def test_new_columns_are_null_in_older_chunks(spark, folder):
    put(spark, folder, 0, 2, "HOUR")
    wide = hours(spark, 2, 3).withColumn("w", F.lit("x"))
    write_snapshot(assign_chunk(wide, "HOUR"), folder, "t", "HOUR", "append")
    assert sorted(str(r["w"]) for r in read_snapshot(spark, folder, "t").collect()) == ["None", "None", "x"]
    with pytest.raises(ValueError):
        write_snapshot(assign_chunk(hours(spark, 3, 4).withColumn("v", F.lit("x")), "HOUR"), folder, "t", "HOUR", "append")
    assert read_snapshot(spark, folder, "t").count() == 3


def test_a_job_that_dies_leaves_the_old_table(spark, folder, monkeypatch):
    put(spark, folder, 0, 5, "HOUR")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            put(spark, folder, 0, 5, "HOUR", "whole", 9)
    # data and manifest were written, and so may be half a data folder and a draft
    os.makedirs(f"{folder}/t/data/b=half/c=0/e=1")
    open(f"{folder}/t/data/b=half/c=0/e=1/part-0.parquet", "w").close()
    open(f"{folder}/t/log/_draft-x", "w").close()
    assert shown(spark, folder) == expected((0, 5, 1))
    assert put(spark, folder, 5, 6, "HOUR") == 1
    assert forget(spark, folder, "t") == [0]
    assert shown(spark, folder) == expected((0, 6, 1))
    assert sorted(os.listdir(f"{folder}/t/data"))[0] != "b=half" and len(os.listdir(f"{folder}/t/data")) == 2
    assert [n for n in os.listdir(f"{folder}/t/log") if not n.endswith(".crc")] == [f"{1:020d}"]


def test_jobs_that_meet(spark, folder, monkeypatch):
    put(spark, folder, 0, 3, "HOUR")
    published = snapshots._publish
    met = []

    def late(spark_, path, version, pointer):
        if not met:
            met.append(version)
            put(spark, folder, 10, 12, "HOUR", value=7)
        published(spark_, path, version, pointer)

    monkeypatch.setattr(snapshots, "_publish", late)
    assert put(spark, folder, 3, 4, "HOUR") == 2
    assert shown(spark, folder) == expected((0, 4, 1), (10, 12, 7))
    # a compaction whose chunks another job has replaced gives way
    met.clear()

    def replaced(spark_, path, version, pointer):
        if not met:
            met.append(version)
            put(spark, folder, 1, 2, "HOUR", "replace", value=8)
        published(spark_, path, version, pointer)

    monkeypatch.setattr(snapshots, "_publish", replaced)
    with pytest.raises(Conflict):
        compact_table(spark, folder, "t", "DAY")
    assert shown(spark, folder) == expected((0, 1, 1), (1, 2, 8), (2, 4, 1), (10, 12, 7))


def test_compaction_reads_only_what_is_not_merged(spark, folder):
    put(spark, folder, 0, 60, "HOUR")
    assert compact_table(spark, folder, "t", "DAY", [], [Metric("n", "count")], "DAY", skip_offset="P1D", partial=False) == 1
    state = sorted((r.start, r.end, r.rows) for r in entries(spark, folder, "t").collect())
    day = timedelta(days=1)
    # the latest end is 60 hours in: only a day that ends by hour 36 is settled
    assert state[0] == (START, START + day, 1) and len(state) == 1 + 36
    put(spark, folder, 60, 96, "HOUR")
    before = {r.b for r in entries(spark, folder, "t").where("c % 86400 = 0 and e - c = 86400").collect()}
    compact_table(spark, folder, "t", "DAY", [], [Metric("n", "count")], "DAY", skip_offset="P1D", partial=False)
    days = entries(spark, folder, "t").where("e - c = 86400").orderBy("start").collect()
    assert [r.start for r in days] == [START, START + day, START + 2 * day] and days[0].b in before
    assert compact_table(spark, folder, "t", "DAY", skip_offset="P1D") is None


def test_cut_months_and_retain_without_reading(spark, folder):
    write_snapshot(assign_chunk(hours(spark, 0, 48), "MONTH"), folder, "t", "MONTH")
    compact_table(spark, folder, "t", "DAY")
    assert {r[END] - r[CHUNK] for r in read_snapshot(spark, folder, "t").collect()} == {timedelta(days=1)}
    files = sorted(os.listdir(f"{folder}/t/data"))
    for _ in range(2):
        retain_table(spark, folder, "t", [Rule("drop", interval="2024-01-02/2024-01-03T05:00")], "2024-02-01")
        assert shown(spark, folder) == expected((0, 24, 1))
    assert sorted(os.listdir(f"{folder}/t/data")) == files


def test_new_and_empty_tables(spark, folder):
    assert latest_version(spark, folder, "t") is None and entries(spark, folder, "t").count() == 0
    put(spark, folder, 0, 0, "DAY")
    assert read_snapshot(spark, folder, "t").count() == 0
    assert compact_table(spark, folder, "t", "DAY") is None
    assert rewrite(spark, folder, "t", entries(spark, folder, "t"), lambda d: d, "DAY") is None
    assert commit(spark, folder, "t", lambda e: e) == 1


def test_uncovered_by_brute_force(spark):
    import random

    rnd = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            a = rnd.randrange(200)
            out.append((START + timedelta(hours=a), START + timedelta(hours=a + rnd.randrange(1, 40)), f"b{i}", i, i + 1, 5))
        return out

    old, new = some(30), some(8)
    got = uncovered(spark.createDataFrame(old, snapshots.ENTRY), spark.createDataFrame(new, snapshots.ENTRY)).collect()
    hour = timedelta(hours=1)
    left = {(r.b, r.start + k * hour) for r in got for k in range((r.end - r.start) // hour)}
    want = {
        (b, t)
        for low, high, b, *_ in old
        for t in (low + k * hour for k in range((high - low) // hour))
        if not any(a <= t < z for a, z, *_ in new)
    }
    assert left == want and len({(r.b, r.start) for r in got}) == len(got)
