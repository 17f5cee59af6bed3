"""Status of members: roll-ups, crash loops, roll-outs, changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import previous_values

READY, NOT_READY = "ready", "error"
ALL_MEMBERS = "All"
ALL_READY = "all members are ready"


def health_rollup(
    df: DataFrame,
    group: str | Iterable[str],
    position: str,
    name: str = "name",
    conditions: str = "conditions",
    ready_type: str = "Ready",
) -> DataFrame:
    """Per group: ready, unless a member has a false ready condition.

    The last such member in list order, and in it the last such condition,
    names the member and gives the reason.
    """
    group = [group] if isinstance(group, str) else list(group)
    failing = F.filter(conditions, lambda c: (c["type"] == ready_type) & (c["status"] == "False"))
    last = F.try_element_at(failing, F.lit(-1))
    found = F.when(
        last.isNotNull(), F.struct(F.col(position).alias("at"), F.col(name).alias("name"), last["reason"].alias("reason"))
    )
    worst = df.groupBy(*group).agg(F.max(found).alias("w"))
    return worst.select(
        *group,
        F.when(F.col("w").isNull(), READY).otherwise(NOT_READY).alias("status"),
        F.coalesce(F.col("w.name"), F.lit(ALL_MEMBERS)).alias("member"),
        F.when(F.col("w").isNull(), ALL_READY).otherwise(F.col("w.reason")).alias("reason"),
    )


def crash_looping(phase: Column, conditions: Column, containers: Column) -> Column:
    not_ready = F.exists(conditions, lambda c: (c["type"] == "ContainersReady") & (c["status"] == "False"))
    restarting = F.exists(containers, lambda c: c["restartCount"] > 1)
    return F.coalesce(phase.isin("Failed", "Unknown"), F.lit(False)) | F.coalesce(
        not_ready & restarting, F.lit(False)
    )


def find_crash_loops(
    df: DataFrame, phase: str = "phase", conditions: str = "conditions", containers: str = "containers"
) -> DataFrame:
    """Members in a failed or unknown phase, or restarting while not ready."""
    return df.where(crash_looping(F.col(phase), F.col(conditions), F.col(containers)))


def rollout_progress(df: DataFrame) -> DataFrame:
    """Add ``done`` and ``error``.

    A ``set`` is done when its revisions and its current and ready replicas
    agree. A ``deployment`` is judged by its first condition: a replica
    failure is an error, a roll-out that does not progress is not done, else
    all replicas must be ready; without any condition it is not done.
    """
    first = F.try_element_at("conditions", F.lit(1))
    failed = (F.col("kind") == "deployment") & (first["type"] == "ReplicaFailure")
    stuck = (first["type"] == "Progressing") & (first["status"] != "True")
    as_set = (F.col("current_revision") == F.col("update_revision")) & (
        F.col("current_replicas") == F.col("ready_replicas")
    )
    as_deployment = first.isNotNull() & ~failed & ~stuck & (F.col("ready_replicas") == F.col("replicas"))
    done = F.when(F.col("kind") == "set", as_set).when(F.col("kind") == "deployment", as_deployment)
    return df.withColumn("done", F.coalesce(done, F.lit(False))).withColumn("error", F.when(failed, first["reason"]))


def status_changes(
    df: DataFrame,
    key: str | Iterable[str],
    order: Iterable[str],
    status: str,
    buckets: int | None = None,
) -> DataFrame:
    """Rows whose status differs from the row before of the same key.

    Adds ``previous`` and ``is_first``; a key's first row is a change. ``order`` must be unique within a key.
    A key of any number of rows is read by as many tasks as it has buckets, see ``ordering``.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = list(order)
    seen = previous_values(df, key, order, status, "__prev", buckets)
    changed = F.col("__prev").isNull() | ~F.col("__prev.value").eqNullSafe(F.col(status))
    return (
        seen.where(changed)
        .withColumn("previous", F.col("__prev.value"))
        .withColumn("is_first", F.col("__prev").isNull())
        .drop("__prev")
    )


def latest_state(df: DataFrame, key: str | Iterable[str], order: Iterable[str]) -> DataFrame:
    """The newest row per key; tasks keep one row per key before the shuffle."""
    key = [key] if isinstance(key, str) else list(key)
    order = list(order)
    rest = [c for c in df.columns if c not in (*key, *order)]
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*key).agg(newest.alias("__row")).select(*key, "__row.*").select(*df.columns)
