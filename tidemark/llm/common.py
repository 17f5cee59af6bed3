"""What the text operators share: words, saved tables, names, fixed-size bitmaps, the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACE = "[ \\t-\\r]+"
# Spark's setting by which a query removes its shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for CRC-32 of an ASCII text, bit by bit."""
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    byte = f"lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::UBIGINT[]), {step})"
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: ascii(({text})[i])::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), {byte}), 4294967295::UBIGINT)"


def text_key() -> dict[str, Column]:
    """128 bits that tell texts apart, so that rows that share a doc_id, or have none, are told apart by them."""
    return {"h": F.xxhash64("text"), "g": F.xxhash64("text", F.lit("text"))}


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written as Parquet to the cluster's shared folder and read again.

    This cuts the lineage: a lost executor costs no more than reading the files
    again. The folder is that of ``spark.checkpoint.dir``; whoever runs the
    cluster empties it between jobs. The shuffle files of the write are of no
    more use then, and go at its end instead of when the driver collects garbage.
    """
    conf, path = df.sparkSession.conf, shared_folder(df.sparkSession, purpose)
    was = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREED) if was is None else conf.set(FREED, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the only column, at the value's lowest bits.

    Built in Spark as blocks of 4 KB; ``bits`` (a power of two) bounds what
    reaches the driver to ``bits / 8`` bytes, whatever the number of rows.
    """
    spot = F.col(hashes.columns[0]).bitwiseAND(bits - 1)
    blocks = (
        hashes.select(F.shiftright(spot, 15).alias("block"), spot.bitwiseAND((1 << 15) - 1).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("set"))
    )
    out = np.zeros(max(1, bits >> 15) * 4096, np.uint8)
    for block, found in blocks.collect():
        out[block * 4096 : block * 4096 + 4096] |= np.frombuffer(found, np.uint8)
    return out


def in_bitmap(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash (int64 or uint64), whether its bit is set."""
    spot = hashes.astype(np.uint64) & np.uint64(len(marks) * 8 - 1)
    return (marks[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
