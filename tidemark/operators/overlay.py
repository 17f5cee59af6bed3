"""Scopes, references, duplicates, validation and capacity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maps import first_non_empty, first_non_null
from tidemark.functions.quantity import quantity


def overlay(df: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """For each output name: the narrow column unless it is empty, else the wide one.

    Text counts as empty when it is null or has no characters, anything else
    when it is null.
    """
    types = dict(df.dtypes)
    for out, (narrow, wide) in fields.items():
        pick = first_non_empty if types[narrow] == "string" else first_non_null
        df = df.withColumn(out, pick(F.col(narrow), F.col(wide)))
    return df


def merge_referenced(
    df: DataFrame, key: str, refs: str, maps: DataFrame, name: str = "name", data: str = "data"
) -> DataFrame:
    """Per key one map: the referenced maps merged in list order, later wins.

    ``maps`` holds each name once. A reference to no map is skipped; a key of
    which no reference is found gets an empty map.
    """
    listed = df.select(key, F.posexplode_outer(refs).alias("__at", "__ref"))
    named = maps.select(F.col(name).alias("__ref"), F.col(data).alias("__data"))
    entries = listed.join(named, "__ref", "left").select(key, "__at", F.explode_outer("__data").alias("__k", "__v"))
    # one shuffle by key serves both groupings, which are as small as a row's own maps
    winners = entries.repartition(key).groupBy(key, "__k").agg(F.max_by("__v", "__at").alias("__v"))
    found = F.collect_list(F.when(F.col("__k").isNotNull(), F.struct("__k", "__v")))
    return winners.groupBy(key).agg(F.map_from_entries(F.sort_array(found)).alias("merged"))


def find_duplicates(df: DataFrame, group: str | Iterable[str], name: str, position: str) -> DataFrame:
    """Per group the name whose second occurrence comes first, and where.

    Only the first two rows of a name matter; Spark cuts to them in each task
    before the shuffle, so a name with many rows is no hot key.
    """
    group = [group] if isinstance(group, str) else list(group)
    nth = F.row_number().over(Window.partitionBy(*group, name).orderBy(position))
    seconds = df.select(*group, name, position).withColumn("__nth", nth).where(F.col("__nth") <= 2)
    return (
        seconds.where(F.col("__nth") == 2)
        .groupBy(*group)
        .agg(F.min_by(name, position).alias("duplicate"), F.min(position).alias("second_at"))
    )


def validate(df: DataFrame, checks: Sequence[tuple[Column, Column]], out: str = "message") -> DataFrame:
    """Join the messages of all checks that a row fails; empty means valid.

    A check is a pair of the condition that must hold and the message.
    """
    parts = [F.when(~F.coalesce(holds, F.lit(False)), text) for holds, text in checks]
    return df.withColumn(out, F.concat_ws("", *parts))


def capacity_drift(
    df: DataFrame, key: str, desired: str = "desired", current: str = "current", claims: str = "claims"
) -> DataFrame:
    """Steps that bring quantities to what is desired, in order.

    ``position`` counts the desired quantities. A quantity below the current
    one is rejected and ends the list; another difference asks to recreate;
    each claim that differs is patched. Nothing happens while there are fewer
    claims than desired quantities. An unreadable or absent quantity is
    ``invalid`` and ends the list too.
    """
    sizes = df.select(
        key,
        *[F.transform(c, quantity).alias(a) for c, a in ((desired, "d"), (current, "c"), (claims, "p"))],
    ).where(F.size("p") >= F.size("d"))

    def steps(want: Column, i: Column) -> Column:
        have = F.try_element_at("c", i + 1)
        kind = (
            F.when(want.isNull() | have.isNull(), "invalid")
            .when(want < have, "reject")
            .when(want != have, "recreate")
        )
        return F.struct(i.alias("position"), want.alias("want"), kind.alias("kind"))

    ends = ("reject", "invalid")
    checked = sizes.select(key, "p", F.transform("d", steps).alias("s"))
    first_end = F.array_min(F.transform(F.filter("s", lambda x: x["kind"].isin(*ends)), lambda x: x["position"]))
    due = checked.select(
        key,
        "p",
        F.explode(F.filter("s", lambda x: x["position"] <= F.coalesce(first_end, F.size("s")))).alias("step"),
    )

    def patches(step: Column) -> Column:
        return F.filter(
            F.transform("p", lambda claim, j: F.when(~claim.eqNullSafe(step["want"]), j)), lambda j: j.isNotNull()
        )

    no_claim = F.lit(None).cast("int")
    own = F.when(
        F.col("step.kind").isNotNull(),
        F.array(F.struct(F.col("step.kind").alias("action"), no_claim.alias("claim"))),
    ).otherwise(F.array().cast("array<struct<action:string,claim:int>>"))
    patched = F.when(
        ~F.coalesce(F.col("step.kind").isin(*ends), F.lit(False)),
        F.transform(patches(F.col("step")), lambda j: F.struct(F.lit("patch").alias("action"), j.alias("claim"))),
    ).otherwise(F.array().cast("array<struct<action:string,claim:int>>"))
    return due.select(
        key, F.col("step.position").alias("position"), F.explode(F.concat(own, patched)).alias("do")
    ).select(key, "position", "do.action", "do.claim")
