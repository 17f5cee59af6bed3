"""Tables as versions: immutable data folders, a manifest of their chunks, and a log of commits.

    name/data/b=<write>/c=<start>/e=<end>/   rows of a chunk, times in seconds
    name/manifest/<id>/                      the chunks of one version, as Parquet
    name/log/<version>                       one small file that names a manifest

A write adds a data folder and a manifest and then moves one finished file to the
next version's name, which fails if another job was first. Until then readers
see the version before, so a job that dies leaves nothing half done. Each entry
carries the start and end of its chunk, so chunks of different lengths live in
one table, and rules, reads and replacements go by true bounds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import grain_length, in_intervals, stamp
from tidemark.sources.tables import table_path
from tidemark.spec import CHUNK, TIME, parse_interval

END = "__end"

# start, end: what of the chunk is shown; b, c, e: its folder, c and e being the bounds of the chunk itself.
ENTRY = "start timestamp, end timestamp, b string, c long, e long, rows long"
_PLACE = ["b", "c", "e"]

# Entries are matched by the days they touch.
_SLOT = 86400


class Conflict(Exception):
    """Another job has changed what this one has read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, log = _fs(spark, f"{path}/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n) for n in names if n.isdigit())


def _pointer(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/log/{version:020d}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, version: int, pointer: dict) -> None:
    """One finished file takes the version's name; fails if the name is taken."""
    jvm = spark._jvm
    fs, draft = _fs(spark, f"{path}/log/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/log/{version:020d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        context.rename(draft, final, how)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {version} of {path} is taken") from e
        raise


def latest_version(spark: SparkSession, root: str, name: str) -> int | None:
    found = _versions(spark, table_path(root, name))
    return found[-1] if found else None


def entries(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The chunks of a version, by default of the latest; none if the table is new."""
    path = table_path(root, name)
    version = latest_version(spark, root, name) if version is None else version
    if version is None:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/manifest/{_pointer(spark, path, version)['manifest']}")


def _schema(spark: SparkSession, path: str, version: int | None) -> T.StructType:
    return T.StructType() if version is None else T.StructType.fromJson(_pointer(spark, path, version)["schema"])


def _joined(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both; one name has one type."""
    known = {f.name: f.dataType for f in old}
    for f in new:
        if known.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name!r} was {known[f.name].simpleString()} and is {f.dataType.simpleString()} now")
    return T.StructType([T.StructField(n, t) for n, t in known.items()])


def commit(
    spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame], columns: T.StructType | None = None
) -> int:
    """Publish what ``change`` makes of the latest entries; again on the new ones if another job was first."""
    path = table_path(root, name)
    while True:
        base = latest_version(spark, root, name)
        schema = _joined(_schema(spark, path, base), columns or T.StructType())
        manifest = uuid.uuid4().hex
        fields = [f.strip().split()[0] for f in ENTRY.split(",")]
        change(entries(spark, root, name, base)).select(*fields).write.parquet(f"{path}/manifest/{manifest}")
        try:
            version = 0 if base is None else base + 1
            _publish(spark, path, version, {"manifest": manifest, "schema": schema.jsonValue()})
            return version
        except Conflict:
            continue


def _written(df: DataFrame, root: str, name: str, length: str | Column, max_rows: int | None) -> tuple[DataFrame, T.StructType]:
    """Rows as a new data folder; gives its entries and its columns."""
    path, folder = table_path(root, name), uuid.uuid4().hex
    end = F.col(CHUNK) + grain_length(length) if isinstance(length, str) else length
    rows = df.withColumns({"c": F.unix_timestamp(CHUNK), "e": F.unix_timestamp(end)}).drop(CHUNK, END)
    columns = rows.drop("c", "e").schema
    writer = rows.hint("rebalance", F.col("c"), F.col("e")).write.partitionBy("c", "e")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.parquet(f"{path}/data/b={folder}")
    layout = T.StructType([*columns, T.StructField("c", T.LongType()), T.StructField("e", T.LongType())])
    # counted from the footers: no column is read
    found = df.sparkSession.read.schema(layout).parquet(f"{path}/data/b={folder}").groupBy("c", "e").agg(F.count(F.lit(1)).alias("rows"))
    bounds = [F.timestamp_seconds("c").alias("start"), F.timestamp_seconds("e").alias("end")]
    return found.select(*bounds, F.lit(folder).alias("b"), "c", "e", "rows"), columns


def _slots(start: str, end: str) -> Column:
    first = F.floor(F.unix_timestamp(start) / _SLOT)
    return F.explode(F.sequence(first, F.greatest(first, F.floor((F.unix_timestamp(end) - 1) / _SLOT))))


def uncovered(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old entries, cut to what no chunk of the new ones covers.

    Entries meet by the days they touch, and an entry's covers are those within
    its own chunk.
    """
    covers = new.select(F.col("start").alias("low"), F.col("end").alias("high")).distinct()
    left = old.select("*", _slots("start", "end").alias("slot"))
    right = covers.select("*", _slots("low", "high").alias("slot"))
    met = left.join(right, "slot").where((F.col("low") < F.col("end")) & (F.col("high") > F.col("start")))
    per = met.groupBy(*_PLACE, "start", "end").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("covers"))
    cut = old.join(per, [*_PLACE, "start", "end"], "left")
    span = F.struct(F.col("end").alias("low"), F.col("end").alias("high"))
    walked = F.aggregate(
        F.concat(F.coalesce("covers", F.array().cast("array<struct<low:timestamp,high:timestamp>>")), F.array(span)),
        F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:timestamp,end:timestamp>>").alias("gaps")),
        lambda a, c: F.struct(
            F.greatest(a["at"], c["high"]).alias("at"),
            F.when(a["at"] < c["low"], F.array_append(a["gaps"], F.struct(a["at"].alias("start"), c["low"].alias("end"))))
            .otherwise(a["gaps"])
            .alias("gaps"),
        ),
        lambda a: a["gaps"],
    )
    return cut.select(*_PLACE, "rows", F.explode(walked).alias("gap")).select("gap.start", "gap.end", *_PLACE, "rows")


def write_snapshot(
    df: DataFrame, root: str, name: str, length: str | Column, mode: str = "replace", max_rows: int | None = None
) -> int:
    """Write rows that carry ``__chunk`` as a new version; gives its number.

    ``length`` is the grain of the chunks, or a column with their end.
    ``replace`` hides what earlier chunks show of the time that the new chunks
    cover, whatever their lengths; ``append`` adds, ``whole`` leaves only the new
    rows. Data is written once, also if the commit has to be repeated.
    """
    if mode not in ("replace", "append", "whole"):
        raise ValueError(f"unknown write mode: {mode!r}")
    fresh, columns = _written(df, root, name, length, max_rows)

    def change(old: DataFrame) -> DataFrame:
        if mode == "whole":
            return fresh
        return (uncovered(old, fresh) if mode == "replace" else old).unionByName(fresh)

    return commit(df.sparkSession, root, name, change, columns)


def _rows(spark: SparkSession, path: str, version: int | None, found: DataFrame) -> DataFrame:
    """Rows of entries, with ``__chunk`` and ``__end``. Only the entries' own folders are listed and read."""
    columns = _schema(spark, path, version)
    layout = T.StructType([*columns, *[T.StructField(n, t()) for n, t in (("b", T.StringType), ("c", T.LongType), ("e", T.LongType))]])
    reader = spark.read.schema(layout).option("basePath", f"{path}/data")
    whole = (F.unix_timestamp("start") == F.col("c")) & (F.unix_timestamp("end") == F.col("e"))
    listed = found.select(*_PLACE, whole.alias("whole")).distinct().collect()
    bounds = {CHUNK: F.timestamp_seconds("c"), END: F.timestamp_seconds("e")}

    def of(wanted: bool) -> DataFrame:
        paths = [f"{path}/data/b={r.b}/c={r.c}/e={r.e}" for r in listed if r.whole == wanted]
        return reader.parquet(*paths) if paths else spark.createDataFrame([], layout)

    shown = of(True)
    if not all(r.whole for r in listed):
        # a chunk that later ones cover in part: its rows in the ranges that are left
        part = found.where(~whole).select(*_PLACE, "start", "end")
        inside = (F.col(TIME) >= F.col("start")) & (F.col(TIME) < F.col("end"))
        shown = shown.unionByName(of(False).join(part, _PLACE).where(inside).select(*layout.names))
    return shown.withColumns(bounds).drop(*_PLACE)


def read_snapshot(
    spark: SparkSession, root: str, name: str, intervals: Iterable[str] | None = None, version: int | None = None
) -> DataFrame:
    """Rows of a version, by default the latest, inside the intervals; with ``__chunk`` and ``__end``."""
    path = table_path(root, name)
    version = latest_version(spark, root, name) if version is None else version
    found = entries(spark, root, name, version)
    if intervals is None:
        return _rows(spark, path, version, found)
    wanted = list(intervals)
    hit: Column = F.lit(not wanted)
    for low, high in map(parse_interval, wanted):
        hit = hit | ((F.col("start") < stamp(high)) & (F.col("end") > stamp(low)))
    return _rows(spark, path, version, found.where(hit)).where(in_intervals(F.col(TIME), wanted))


def rewrite(
    spark: SparkSession, root: str, name: str, chosen: DataFrame, made: Callable[[DataFrame], DataFrame], length: str, max_rows: int | None = None
) -> int | None:
    """Replace chosen entries by what ``made`` makes of their rows; gives the version, or nothing if none is chosen.

    Fails with ``Conflict`` if another job changed one of them meanwhile.
    """
    path, base = table_path(root, name), latest_version(spark, root, name)
    if chosen.isEmpty():
        return None
    fresh, columns = _written(made(_rows(spark, path, base, chosen)), root, name, length, max_rows)
    keys = [*_PLACE, "start", "end"]
    count = chosen.count()

    def change(now: DataFrame) -> DataFrame:
        if now.join(chosen.select(*keys), keys, "left_semi").count() != count:
            raise Conflict(f"chunks of {path} were changed by another job")
        return now.join(chosen.select(*keys), keys, "left_anti").unionByName(fresh)

    return commit(spark, root, name, change, columns)


def forget(spark: SparkSession, root: str, name: str, keep: int = 1) -> list[int]:
    """Remove versions but the last ``keep``, and what only they use; gives the versions removed.

    Not to run beside a job that writes: its new folder is not in any version yet.
    """
    path = table_path(root, name)
    found = _versions(spark, path)
    old, kept = found[: len(found) - keep], found[len(found) - keep :]
    pointers = {v: _pointer(spark, path, v)["manifest"] for v in kept}
    used: set[str] = set()
    for v in kept:
        used |= {r.b for r in entries(spark, root, name, v).select("b").distinct().collect()}
    for folder, live in (("data", {f"b={b}" for b in used}), ("manifest", set(pointers.values())), ("log", {f"{v:020d}" for v in kept})):
        fs, where = _fs(spark, f"{path}/{folder}")
        for status in fs.listStatus(where):
            if status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)
    return old
