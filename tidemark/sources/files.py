"""JSON files in, result lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD_RECORD = "__bad"


def read_json(
    spark: SparkSession,
    base_dir: str,
    glob: str = "*.json*",
    schema: T.StructType | str | None = None,
    text_fields: list[str] | None = None,
) -> DataFrame:
    """One JSON object per line; compressed files are read by their suffix.

    Every declared field is read as text, so that one field of the wrong type
    does not spoil its row. A line that is no JSON object has all fields null
    and its text in ``__bad``; Spark wants another column read along with it.
    """
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in text_fields or []])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .json(base_dir)
    )


def read_lines(spark: SparkSession, base_dir: str, glob: str = "*.json*") -> DataFrame:
    """The same files as whole lines in ``value``, for discovery and audits."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(base_dir)


def to_object_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, in ``line``; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def write_object_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    to_object_lines(df).write.mode("overwrite").option("compression", compression).text(path)
