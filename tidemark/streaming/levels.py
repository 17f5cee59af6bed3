"""What a stream keeps between micro-batches: folders that merge as they grow in number, and marks.

Each micro-batch adds one folder. When a level has ``FANOUT`` of them they are
merged into one of the next level, so after n batches there are some log n
folders, and a row is rewritten log n times at most. One small file a batch
lists the live folders and carries the marks (such as the latest time) forward.
It takes its name when it is complete, so a batch that dies is simply repeated
from the list before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _lists(spark: SparkSession, sink: str) -> list[int]:
    fs, log = _fs(spark, f"{sink}/lists")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()) if fs.exists(log) else []


def last_list(spark: SparkSession, sink: str, before: int | None = None) -> dict:
    """The newest list, or the newest of the batches before a number: ``batch``, ``folders``, ``marks``."""
    found = [n for n in _lists(spark, sink) if before is None or n < before]
    if not found:
        return {"batch": -1, "folders": [], "marks": {}}
    return json.loads(spark.read.text(f"{sink}/lists/{found[-1]:020d}", wholetext=True).first()[0])


def _publish(spark: SparkSession, sink: str, number: int, content: dict) -> None:
    fs, draft = _fs(spark, f"{sink}/lists/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final = _fs(spark, f"{sink}/lists/{number:020d}")[1]
    fs.delete(final, False)  # a list left by an earlier try of this batch
    if not fs.rename(draft, final):
        raise OSError(f"cannot publish batch {number} of {sink}")


def read_folders(spark: SparkSession, sink: str, folders: Iterable[Mapping], schema: str | None = None) -> DataFrame | None:
    """Rows of the listed folders; nothing if there is none."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    frames = [reader.parquet(f"{sink}/{f['name']}") for f in folders]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def add_batch(
    rows: DataFrame | None,
    sink: str,
    number: int,
    fold: Callable[[DataFrame], DataFrame],
    marks: Mapping[str, str | None] | None = None,
    parts: Iterable[str] = (),
) -> None:
    """Add a batch's rows and marks, and merge levels that are full by ``fold``. A replay replaces what an earlier try left."""
    spark = rows.sparkSession if rows is not None else SparkSession.getActiveSession()
    before = last_list(spark, sink, number)
    parts = list(parts)

    def put(df: DataFrame, level: int) -> dict:
        name = f"level={level}-{number}-{uuid.uuid4().hex}"
        df.write.partitionBy(*parts).parquet(f"{sink}/{name}")
        return {"name": name, "level": level}

    folders = [*before["folders"]]
    if rows is not None:
        folders.append(put(rows, 0))
        level = 0
        while len(full := [f for f in folders if f["level"] == level]) >= FANOUT:
            folders = [f for f in folders if f["level"] != level]
            folders.append(put(fold(read_folders(spark, sink, full)), level + 1))
            level += 1
    _publish(spark, sink, number, {"batch": number, "folders": folders, "marks": {**before["marks"], **(marks or {})}})
    # a replay needs the list before this one, and readers may still be at it
    live = {f["name"] for f in [*folders, *before["folders"]]} | {"lists"}
    fs, where = _fs(spark, sink)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("level=") and name not in live:
            fs.delete(status.getPath(), True)
    for old in _lists(spark, sink):
        if old < before["batch"]:
            fs.delete(_fs(spark, f"{sink}/lists/{old:020d}")[1], False)
