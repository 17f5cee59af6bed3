"""Keeping a table in step with a wanted one: filters, diffs, orphans, order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.documents import content_hash, ordered_maps
from tidemark.functions.maps import flag_set, labels_match
from tidemark.functions.times import seconds_between, stamp

# Rank of the member types; a type that is not listed has none.
RANKS = ("historical", "overlord", "middleManager", "indexer", "broker", "coordinator", "router")

# Fixed value: seconds between marking an orphan and deleting it.
GRACE_SECONDS = 60


def deny(df: DataFrame, column: str, deny_list: str) -> DataFrame:
    """Drop rows whose value is in the comma list; its items are not trimmed."""
    if deny_list == "":
        return df
    return df.where(~F.coalesce(F.col(column).isin(deny_list.split(",")), F.lit(False)))


def drop_flagged(df: DataFrame, annotations: str, key: str) -> DataFrame:
    return df.where(~flag_set(F.col(annotations), key))


def match_labels(df: DataFrame, labels: str, selector: Mapping[str, str]) -> DataFrame:
    return df.where(labels_match(F.col(labels), selector))


def plan_sync(
    desired: DataFrame, current: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """What turns current into desired: ``create``, ``update``, ``noop``, ``delete``.

    Both sides are cut to key and content hash before they are shuffled.
    """
    columns = list(columns) if columns else [c for c in desired.columns if c not in keys]
    # a column that is the same but for its type or the order of map entries must hash the same
    types = {f.name: f.dataType for f in desired.schema.fields}
    hashed = content_hash(*[ordered_maps(F.col(c).cast(types[c]), types[c]).alias(c) for c in columns])
    want = desired.select(*keys, hashed.alias("desired_hash"))
    have = current.select(*keys, hashed.alias("current_hash"))
    action = (
        F.when(F.col("current_hash").isNull(), "create")
        .when(F.col("desired_hash").isNull(), "delete")
        .when(F.col("desired_hash") != F.col("current_hash"), "update")
        .otherwise("noop")
    )
    return want.join(have, list(keys), "full_outer").select(*keys, action.alias("action"))


def survivors(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted keys that are left once the plan is carried out, one per row."""
    return plan.where(F.col("action") != "delete").select(*keys).orderBy(*keys)


def active_references(owners: DataFrame, refs: str = "refs", pending: str = "pending") -> DataFrame:
    """Names that some owner which is not pending refers to, each once."""
    held = owners.where(~F.coalesce(F.col(pending), F.lit(False)))
    return held.select(F.explode(refs).alias("name")).distinct()


def find_orphans(items: DataFrame, owners: DataFrame, name: str = "name") -> DataFrame:
    held = active_references(owners).withColumnRenamed("name", name)
    return items.join(held, name, "left_anti")


def sweep_orphans(
    items: DataFrame,
    owners: DataFrame,
    as_of: str,
    grace: int = GRACE_SECONDS,
    name: str = "name",
    marked_at: str = "marked_at",
) -> DataFrame:
    """Add the ``action`` due on each item.

    An orphan is marked first and deleted once the mark is ``grace`` seconds
    old; an item in use loses its mark. A single owner that is not known to be healthy stops it all.
    """
    held = active_references(owners).select(F.col("name").alias(name), F.lit(True).alias("__held"))
    all_healthy = owners.agg(F.coalesce(F.bool_and(F.coalesce("healthy", F.lit(False))), F.lit(True)).alias("ok")).scalar()
    marked = F.col(marked_at).isNotNull()
    age = seconds_between(F.col(marked_at), stamp(as_of))
    action = (
        F.when(~all_healthy, "keep")
        .when(F.col("__held").isNotNull(), F.when(marked, "unmark").otherwise("keep"))
        .when(~marked, "mark")
        .when(age >= grace, "delete")
        .otherwise("wait")
    )
    return items.join(held, name, "left").withColumn("action", action).drop("__held")


def order_by_rank(
    df: DataFrame, column: str, key: str, ranks: Iterable[str] = RANKS, out: str = "rank"
) -> DataFrame:
    """Listed types only, in the order of the list, then by key."""
    place = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(column))
    return df.withColumn(out, place).where(F.col(out) > 0).orderBy(out, key)
