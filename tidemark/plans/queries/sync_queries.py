"""Set logic: diffs, orphans, order, labels, overlays, duplicates, capacity, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.maps import concat_scopes, merge_maps, sorted_map_json
from tidemark.operators import sync
from tidemark.operators.overlay import capacity_drift, find_duplicates, merge_referenced, overlay, validate
from tidemark.operators.status import (
    find_crash_loops,
    health_rollup,
    latest_state,
    rollout_progress,
    status_changes,
)
from tidemark.plans.queries.base import events, query, table
from tidemark.spec import TIME

# Wanted: the newest event per user and type, errors aside. Present: the same on January 20, errors included.
_SNAPSHOTS = """d AS (SELECT user_id, event_type, max(event_id) AS id FROM events WHERE event_type <> 'error' GROUP BY ALL),
    c AS (SELECT user_id, event_type, max(event_id) AS id FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
    p AS (SELECT user_id, event_type,
                 CASE WHEN c.id IS NULL THEN 'create' WHEN d.id IS NULL THEN 'delete'
                      WHEN c.id <> d.id THEN 'update' ELSE 'noop' END AS action
          FROM d FULL OUTER JOIN c USING (user_id, event_type))"""
_KEYS = ["user_id", "event_type"]


def snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value", "props")
    early = events(spark, sf_dir).where(F.col(TIME) < F.lit("2024-01-20").cast("timestamp"))
    wanted = latest_state(rows.where(F.col("event_type") != "error"), _KEYS, ["event_id"])
    present = latest_state(early.select(*rows.columns), _KEYS, ["event_id"])
    return sync.plan_sync(wanted, present, _KEYS)


@query("sync_plan", f"WITH {_SNAPSHOTS} SELECT * FROM p")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_plan(spark, sf_dir)


@query("survivors", f"WITH {_SNAPSHOTS} SELECT user_id, event_type FROM p WHERE action <> 'delete' ORDER BY ALL")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.survivors(snapshot_plan(spark, sf_dir), _KEYS)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: F marked for a minute to the second, P for less, O not at all."""
    as_of = F.lit(SWEEP_AS_OF).cast("timestamp")
    marked = F.when(F.col("o_orderstatus") == "F", as_of - F.expr("INTERVAL 60 SECONDS")).when(
        F.col("o_orderstatus") == "P", as_of - F.expr("INTERVAL 59 SECONDS")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("name"), marked.alias("marked_at")
    )


def line_owners(spark: SparkSession, sf_dir: str, healthy: Column | None = None) -> DataFrame:
    """Line items as owners of their order; those with flag N are pending."""
    return table(spark, sf_dir, "lineitem").select(
        F.array(F.concat(F.lit("order-"), "l_orderkey")).alias("refs"),
        (F.col("l_returnflag") == "N").alias("pending"),
        (F.lit(True) if healthy is None else healthy).alias("healthy"),
    )


SWEEP_AS_OF = "2024-01-31 12:00:00"
_HELD = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')"


@query("orphans", f"SELECT 'order-' || o_orderkey AS name FROM orders WHERE NOT {_HELD}")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.find_orphans(order_items(spark, sf_dir), line_owners(spark, sf_dir)).select("name")


@query(
    "orphan_sweep",
    f"""SELECT 'order-' || o_orderkey AS name,
               CASE WHEN {_HELD} THEN CASE WHEN o_orderstatus = 'O' THEN 'keep' ELSE 'unmark' END
                    ELSE CASE o_orderstatus WHEN 'O' THEN 'mark' WHEN 'F' THEN 'delete' ELSE 'wait' END END AS action
        FROM orders""",
)
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = sync.sweep_orphans(order_items(spark, sf_dir), line_owners(spark, sf_dir), SWEEP_AS_OF)
    return swept.select("name", "action")


@query("orphan_sweep_gated", "SELECT 'order-' || o_orderkey AS name, 'keep' AS action FROM orders")
def orphan_sweep_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = line_owners(spark, sf_dir, healthy=F.col("l_linestatus") == "F")
    return sync.sweep_orphans(order_items(spark, sf_dir), owners, SWEEP_AS_OF).select("name", "action")


PRIORITIES = ("1-URGENT", "5-LOW", "3-MEDIUM")


@query(
    "ranked",
    """SELECT o_orderkey, o_orderpriority, CAST(list_position(['1-URGENT', '5-LOW', '3-MEDIUM'], o_orderpriority) AS BIGINT) AS rank
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '3-MEDIUM') ORDER BY rank, o_orderkey""",
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sync.order_by_rank(rows, "o_orderpriority", "o_orderkey", PRIORITIES)


@query(
    "deny",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
)
def deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # the blank belongs to the last item, which therefore denies nothing
    return sync.deny(rows, "c_mktsegment", "BUILDING,MACHINERY, FURNITURE")


def labelled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = F.when(F.col("c_acctbal") < 0, "true").otherwise("false")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(
            F.col("c_mktsegment") != "FURNITURE",
            F.create_map(F.lit("ignored"), ignored, F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")),
        ).alias("labels"),
    )


@query("flagged", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_acctbal >= 0")
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.drop_flagged(labelled_customers(spark, sf_dir), "labels", "ignored").select("c_custkey")


@query("labels_match", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def labels_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"segment": "BUILDING", "nation": "7"}
    return sync.match_labels(labelled_customers(spark, sf_dir), "labels", wanted).select("c_custkey")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "overlay",
    """SELECT doc_id, CASE WHEN lang IN ('fr', 'en') THEN source ELSE lang END AS tag,
              coalesce(CAST(quality AS BIGINT), n_chars) AS amount
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = F.when(F.col("lang") == "fr", "").when(F.col("lang") != "en", F.col("lang"))
    rows = labelled_documents(spark, sf_dir).select(
        "doc_id", narrow.alias("narrow"), "source", F.col("quality").cast("bigint").alias("quality"), "n_chars"
    )
    return overlay(rows, {"tag": ("narrow", "source"), "amount": ("quality", "n_chars")}).select("doc_id", "tag", "amount")


@query(
    "merged_maps",
    """SELECT doc_id, '{"app":"docs","lang":"' || CASE WHEN quality IS NULL THEN lang ELSE 'any' END ||
              CASE WHEN quality IS NULL THEN '' ELSE '","quality":"' || quality END || '","source":"' || source || '"}' AS merged
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("app"), F.lit("wide"))
    narrow = F.when(
        F.col("quality").isNotNull(),
        F.create_map(F.lit("lang"), F.lit("any"), F.lit("quality"), F.col("quality").cast("string"), F.lit("app"), F.lit("narrow")),
    )
    forced = F.create_map(F.lit("app"), F.lit("docs"))
    return labelled_documents(spark, sf_dir).select("doc_id", sorted_map_json(merge_maps(wide, narrow, forced)).alias("merged"))


@query(
    "concat_scopes",
    """SELECT doc_id, lang || '|' || source || CASE WHEN quality IS NULL THEN '' ELSE '|' || source || '|' || quality END AS items
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = F.when(F.col("quality").isNotNull(), F.array("source", F.col("quality").cast("string")))
    both = concat_scopes(F.array("lang", "source"), narrow)
    return labelled_documents(spark, sf_dir).select("doc_id", F.array_join(both, "|").alias("items"))


@query(
    "referenced_maps",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN '{}' ELSE
              '{"nation":"' || n_name || '","region":"' || r_name || '","scope":"' ||
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'region' ELSE 'nation' END || '"}' END AS merged
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def referenced_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")

    def named(df: DataFrame, name: str, kind: str) -> DataFrame:
        data = F.create_map(F.lit(kind), F.col(name), F.lit("scope"), F.lit(kind))
        return df.select(F.col(name).alias("name"), data.alias("data"))

    maps = named(nation, "n_name", "nation").unionByName(named(region, "r_name", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    refs = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.array("n_name", "r_name", F.lit("absent")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("absent")))
        .otherwise(F.array("r_name", F.lit("absent"), "n_name"))
    )
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    merged = merge_referenced(rows.select("c_custkey", refs.alias("refs")), "c_custkey", "refs", maps)
    return merged.select("c_custkey", sorted_map_json(F.col("merged")).alias("merged"))


@query(
    "duplicates",
    """SELECT user_id, arg_min(event_type, event_id) AS duplicate, min(event_id) AS second_at
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
       WHERE rn = 2 GROUP BY ALL""",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    "validation",
    """SELECT p_partkey, CASE WHEN p_size <= 40 THEN '' ELSE 'size ' || p_size || ' is too large; ' END ||
              CASE WHEN regexp_matches(p_name, '(red|blue) [a-z]+') THEN '' ELSE 'name ' || p_name || ' is not allowed; ' END AS message
       FROM part""",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        (F.col("p_size") <= 40, F.format_string("size %d is too large; ", "p_size")),
        (F.col("p_name").rlike("(red|blue) [a-z]+"), F.format_string("name %s is not allowed; ", "p_name")),
    ]
    return validate(table(spark, sf_dir, "part"), checks).select("p_partkey", "message")


@query(
    "capacity_drift",
    """WITH p AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'less' WHEN 'SMALL' THEN 'same' ELSE 'more' END AS kind
                  FROM part WHERE p_size <= 25)
       SELECT p_partkey, 0 AS position, 'reject' AS action, CAST(NULL AS INTEGER) AS claim FROM p WHERE kind = 'less'
       UNION ALL SELECT p_partkey, 0, 'recreate', NULL FROM p WHERE kind = 'more'
       UNION ALL SELECT p_partkey, 0, 'patch', 1 FROM p WHERE kind <> 'less'
       UNION ALL SELECT p_partkey, 1, 'patch', 0 FROM p WHERE kind <> 'less'""",
)
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    want = F.concat(size.cast("string"), F.lit("Gi"))
    have = (
        F.when(F.col("p_type") == "ECONOMY", F.concat((size + 1).cast("string"), F.lit("Gi")))
        .when(F.col("p_type") == "SMALL", F.concat((size * 1024).cast("string"), F.lit("Mi")))
        .otherwise(F.concat((size - 1).cast("string"), F.lit("Gi")))
    )
    claims = F.when(size <= 25, F.array(want, F.lit("1.5Ti"))).otherwise(F.array(want))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(want, F.lit("1.5Ti")).alias("desired"),
        F.array(have, F.lit("1536Gi")).alias("current"),
        claims.alias("claims"),
    )
    return capacity_drift(rows, "p_partkey")


@query(
    "health",
    """SELECT user_id, CASE WHEN bad IS NULL THEN 'ready' ELSE 'error' END AS status,
              CASE WHEN bad IS NULL THEN 'All' ELSE 'event-' || bad END AS member,
              CASE WHEN bad IS NULL THEN 'all members are ready' ELSE why END AS reason
       FROM (SELECT user_id, max(event_id) FILTER (event_type = 'error' AND value > 60) AS bad,
                    arg_max(props, event_id) FILTER (event_type = 'error' AND value > 60) AS why FROM events GROUP BY ALL)""",
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("event_type") == "error") & (F.col("value") > 60)
    conditions = F.array(
        F.struct(F.lit("Scheduled").alias("type"), F.lit("False").alias("status"), F.lit("other").alias("reason")),
        F.struct(
            F.lit("Ready").alias("type"), F.when(bad, "False").otherwise("True").alias("status"), F.col("props").alias("reason")
        ),
    )
    members = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.concat(F.lit("event-"), "event_id").alias("name"), conditions.alias("conditions")
    )
    return health_rollup(members, "user_id", "event_id")


@query(
    "crash_loops",
    """SELECT event_id FROM events WHERE event_type IN ('signup', 'view')
       OR (event_type IN ('error', 'click') AND value > 50 AND CAST(floor(value) AS INTEGER) - 50 > 1)""",
)
def crash_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    phase = F.when(kind == "signup", "Failed").when(kind == "view", "Unknown").otherwise("Running")
    ready = F.when(kind.isin("error", "click"), "False").otherwise("True")
    condition = F.struct(F.lit("ContainersReady").alias("type"), ready.alias("status"))
    containers = F.array(
        F.struct(F.lit("side").alias("name"), F.lit(1).alias("restartCount")),
        F.struct(F.lit("main").alias("name"), (F.floor("value").cast("int") - 50).alias("restartCount")),
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", phase.alias("phase"), F.array(condition).alias("conditions"), containers.alias("containers")
    )
    return find_crash_loops(rows).select("event_id")


@query(
    "rollout",
    """SELECT o_orderkey,
              CASE WHEN o_orderstatus = 'F' THEN o_orderpriority NOT IN ('1-URGENT', '5-LOW')
                   ELSE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') END AS done,
              CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'quota' END AS error
       FROM orders""",
)
def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")

    def condition(type_: str, status: str) -> Column:
        return F.array(F.struct(F.lit(type_).alias("type"), F.lit(status).alias("status"), F.lit("quota").alias("reason")))

    conditions = (
        F.when(priority == "2-HIGH", condition("Progressing", "False"))
        .when(priority == "4-NOT SPECIFIED", condition("ReplicaFailure", "True"))
        .when(priority != "3-MEDIUM", condition("Available", "True"))
        .otherwise(F.filter(condition("none", "none"), lambda _: F.lit(False)))
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "set").otherwise("deployment").alias("kind"),
        F.lit("r1").alias("current_revision"),
        F.when(priority == "1-URGENT", "r2").otherwise("r1").alias("update_revision"),
        F.lit(3).alias("replicas"),
        F.lit(3).alias("current_replicas"),
        F.when(priority == "5-LOW", 2).otherwise(3).alias("ready_replicas"),
        conditions.alias("conditions"),
    )
    return rollout_progress(rows).select("o_orderkey", "done", "error")


@query(
    "status_changes",
    """SELECT user_id, __time, event_id, event_type, previous FROM (
         SELECT user_id, ts AS __time, event_id, event_type,
                lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
       WHERE previous IS NULL OR previous <> event_type""",
)
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", TIME, "event_id", "event_type")
    return status_changes(rows, "user_id", [TIME, "event_id"], "event_type").drop("is_first")


@query(
    "latest_state",
    """SELECT user_id, event_id, event_type, value, ts AS __time FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", TIME)
    return latest_state(rows, "user_id", [TIME, "event_id"])
