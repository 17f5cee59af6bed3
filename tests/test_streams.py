import os
import shutil
import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.chunks import compact
from tidemark.operators.status import status_changes
from tidemark.plans.ingest import DIMS, expand_dimensions
from tidemark.sources.streams import read_stream
from tidemark.spec import TIME, IngestSpec, Metric
from tidemark.streaming.changes import read_changes, stream_status_changes
from tidemark.streaming import levels
from tidemark.streaming.dedupe import read_late, read_unique, stream_dedupe
from tidemark.streaming.ingest import publish, read_stream_table, read_windows, stream_ingest, stream_rollup

SPEC = IngestSpec(
    data_source="metrics",
    time_column="timestamp",
    time_format="auto",
    exclusions=("timestamp", "value"),
    metrics=(Metric("count", "count"), Metric("value_sum", "doubleSum", "value")),
    segment_granularity="HOUR",
)


def put(folder, name, lines, age):
    """One input file; an older age is read first."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    when = datetime.now().timestamp() - age
    os.utime(path, (when, when))


def line(time, host, value):
    return f'{{"timestamp":"{time}","host":"{host}","value":{value}}}'


def values(spark, folder):
    return read_stream(spark, {}, spark.readStream.option("maxFilesPerTrigger", 1).text(folder))


def test_partial_rows_merge_over_batches(spark, folder):
    put(f"{folder}/in", "a", [line("2024-01-01T10:00:00Z", "a", 1), line("2024-01-01T10:00:00Z", "a", 2), "broken"], 20)
    put(f"{folder}/in", "b", [line("2024-01-01T10:00:00Z", "a", 4), line("2024-01-01T11:00:00Z", "b", 8)], 10)
    stream_ingest(values(spark, f"{folder}/in"), SPEC, folder, f"{folder}/check").awaitTermination()
    partial = read_stream_table(spark, folder, "metrics")
    assert partial.count() == 3
    merged = expand_dimensions(compact(partial, "DAY", [DIMS], SPEC.metrics), ["host"])
    got = sorted((str(r[TIME]), r["host"], r["count"], r["value_sum"]) for r in merged.collect())
    assert got == [("2024-01-01 10:00:00", "a", 3, 7.0), ("2024-01-01 11:00:00", "b", 1, 8.0)]


def test_replay_adds_nothing_twice(spark, folder):
    put(f"{folder}/in", "a", [line("2024-01-01T10:00:00Z", "a", 1)], 20)
    put(f"{folder}/in", "b", [line("2024-01-01T10:00:00Z", "a", 2)], 10)
    stream_ingest(values(spark, f"{folder}/in"), SPEC, folder, f"{folder}/check").awaitTermination()
    # as if the job had been lost before it could note that batch 1 was done
    os.rename(f"{folder}/check/commits/1", f"{folder}/lost-commit")
    crc = f"{folder}/check/commits/.1.crc"
    if os.path.exists(crc):
        os.rename(crc, f"{folder}/lost-crc")
    stream_ingest(values(spark, f"{folder}/in"), SPEC, folder, f"{folder}/check").awaitTermination()
    got = read_stream_table(spark, folder, "metrics").agg(F.sum("count"), F.sum("value_sum")).first()
    assert tuple(got) == (2, 3.0)


@pytest.mark.parametrize(("late", "rows"), [(None, 3), ("PT1H", 2), ("PT3H", 3)])
def test_late_rows(spark, folder, late, rows):
    put(f"{folder}/in", "a", [line("2024-01-01T12:00:00Z", "a", 1)], 20)
    put(f"{folder}/in", "b", [line("2024-01-01T10:00:00Z", "a", 2), line("2024-01-01T11:00:00Z", "a", 4)], 10)
    stream_ingest(values(spark, f"{folder}/in"), SPEC, folder, f"{folder}/check", late_rejection=late).awaitTermination()
    assert read_stream_table(spark, folder, "metrics").count() == rows


@pytest.mark.parametrize("late", [None, "P1D"])
def test_windows_keep_their_newest_state(spark, folder, late):
    put(f"{folder}/in", "a", [line("2024-01-01T10:00:00Z", "a", 1), line("2024-01-01T11:00:00Z", "a", 1)], 20)
    put(f"{folder}/in", "b", [line("2024-01-01T10:59:59Z", "a", 2), line("2024-01-01T10:00:00Z", "b", 5)], 10)
    run = stream_rollup(values(spark, f"{folder}/in"), SPEC, f"{folder}/out", f"{folder}/check", late_rejection=late)
    run.awaitTermination()
    got = expand_dimensions(read_windows(spark, f"{folder}/out"), ["host"]).collect()
    assert sorted((str(r["__chunk"]), r["host"], r["count"], r["value_sum"]) for r in got) == [
        ("2024-01-01 10:00:00", "a", 2, 3.0),
        ("2024-01-01 10:00:00", "b", 1, 5.0),
        ("2024-01-01 11:00:00", "a", 1, 1.0),
    ]


SCHEMA = "k string, t timestamp, i int, s string"


def write_states(spark, folder, batches):
    """One file per batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{folder}/parts/{n}")
        source = next(f for f in os.listdir(f"{folder}/parts/{n}") if f.endswith(".json"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.copy(f"{folder}/parts/{n}/{source}", f"{folder}/in/{n}.json")
        when = datetime.now().timestamp() - 100 + n
        os.utime(f"{folder}/in/{n}.json", (when, when))


def test_changes_over_batches_equal_one_batch(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [
        ("hot" if i % 3 == 0 else f"k{i % 5}", start + timedelta(minutes=i), i, None if i % 11 == 0 else "xy"[(i * i // 7) % 2])
        for i in range(300)
    ]
    write_states(spark, folder, [rows[:90], rows[90:95], rows[95:]])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    run = stream_status_changes(source, ["k"], ["t", "i"], "s", folder, f"{folder}/check")
    run.awaitTermination()
    got = read_changes(spark, folder)
    want = status_changes(spark.createDataFrame(rows, SCHEMA), "k", ["t", "i"], "s")
    columns = want.columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/check")
    assert state.count() == 6
    # the small batch has written its own keys only
    touched = [p.stateOperators[0].numRowsUpdated for p in run.recentProgress if p.numInputRows]
    assert touched == [len({r[0] for r in part}) for part in (rows[:90], rows[90:95], rows[95:])]


def test_changes_run_whatever_store_the_session_names(spark, folder):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.unset(store)
    try:
        rows = [("a", datetime(2024, 1, 1), 1, "x"), ("a", datetime(2024, 1, 2), 2, "y"), ("b", datetime(2024, 1, 1), 3, "x")]
        write_states(spark, folder, [rows])
        source = spark.readStream.schema(SCHEMA).json(f"{folder}/in")
        stream_status_changes(source, ["k"], ["t", "i"], "s", folder, f"{folder}/check").awaitTermination()
        assert spark.conf.get(store, None) is None
    finally:
        spark.conf.set(store, before)
    assert sorted(r.i for r in read_changes(spark, folder).collect()) == [1, 2, 3]


def test_silent_keys_are_forgotten(spark, folder):
    start = datetime(2024, 1, 1)
    write_states(spark, folder, [[("a", start, 1, "x"), ("b", start, 2, "x")]])
    write_states(spark, f"{folder}/later", [[("b", start, 4, "x")]])
    source = spark.readStream.schema(SCHEMA).json(f"{folder}/in")
    with pytest.raises(ValueError):
        stream_status_changes(source, ["k"], ["i"], "s", folder, f"{folder}/check", forget_after="PT1S")
    query = stream_status_changes(
        source, ["k"], ["i"], "s", folder, f"{folder}/check", forget_after="PT1S", trigger={"processingTime": "1 second"}
    )

    def wait_for(rows):
        for _ in range(60):
            if os.path.exists(f"{folder}/changes/_spark_metadata/0") and read_changes(spark, folder).count() == rows:
                return True
            time.sleep(0.5)
        return False

    try:
        assert wait_for(2)
        time.sleep(2)
        shutil.copy(f"{folder}/later/in/0.json", f"{folder}/in/later.json")
        assert wait_for(3)
        assert all(r.is_first for r in read_changes(spark, folder).collect())
    finally:
        query.stop()


def deduped(spark, folder, remember="P30D", within="P1D"):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    stream_dedupe(source, ["k"], folder, f"{folder}/check", within, remember, time_col="t").awaitTermination()
    return sorted((r.k or "", r.i) for r in read_unique(spark, folder).collect())


def test_copies_go_and_late_rows_stay(spark, folder):
    day = datetime(2024, 1, 20)
    hot = [("hot", day + timedelta(seconds=i % 7), i % 7, "s") for i in range(300)]
    first = [*hot, ("a", day, 1, "s"), (None, day, 2, "s"), (None, day, 3, "s"), ("edge", day.replace(hour=23, minute=59), 4, "s")]
    second = [
        ("hot", day, 8, "s"),
        ("new", day - timedelta(days=5), 9, "s"),
        ("edge", day + timedelta(days=1, minutes=30), 10, "s"),
        ("a", day + timedelta(days=3), 11, "s"),
    ]
    third = [("new", day - timedelta(days=5, hours=3), 12, "s"), ("old", day - timedelta(days=40), 13, "s"), ("none", None, 14, "s")]
    write_states(spark, folder, [first, second, third])
    assert deduped(spark, folder) == [("", 2), ("", 3), ("a", 1), ("a", 11), ("edge", 4), ("hot", 0), ("new", 9)]
    assert sorted(r.i for r in read_late(spark, folder).collect()) == [13, 14]


def test_a_repeated_batch_of_copies_adds_nothing(spark, folder):
    day = datetime(2024, 1, 20)
    write_states(spark, folder, [[("a", day, 1, "s")], [("a", day, 2, "s"), ("b", day, 3, "s")]])
    want = deduped(spark, folder)
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{folder}/check/commits/{name}"):
            os.rename(f"{folder}/check/commits/{name}", f"{folder}/lost{name}")
    assert deduped(spark, folder) == want == [("a", 1), ("b", 3)]


def test_folders_and_marks_do_not_grow_with_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(levels, "FANOUT", 3)
    rows = lambda i: spark.createDataFrame([(i % 4, i), (9, i)], "k int, v int")
    newest = lambda d: d.groupBy("k").agg(F.max("v").alias("v"))
    for i in range(30):
        levels.add_batch(rows(i), f"{folder}/s", i, newest, {"high": i})
        if i in (7, 17):  # the batch is tried again after it was listed
            levels.add_batch(rows(i), f"{folder}/s", i, newest, {"high": i})
    told = levels.last_list(spark, f"{folder}/s")
    assert told["marks"] == {"high": 29} and len(told["folders"]) <= 2 * 4
    assert len([n for n in os.listdir(f"{folder}/s") if n.startswith("level")]) <= 2 * 8
    assert len([n for n in os.listdir(f"{folder}/s/lists") if n.isdigit()]) <= 2
    got = newest(levels.read_folders(spark, f"{folder}/s", told["folders"])).collect()
    assert {r.k: r.v for r in got} == {0: 28, 1: 29, 2: 26, 3: 27, 9: 29}


def test_publishing_follows_the_declaration():
    assert publish(SPEC) == {"availableNow": True}
    assert publish(replace(SPEC, io={"taskDuration": "PT30M"})) == {"processingTime": "1800 seconds"}
