"""Chunks, compaction, segments, retention rules and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunks import assign_segment, chunk_summary, compact
from tidemark.operators.documents import rules_to_rows
from tidemark.operators.retention import (
    apply_retention,
    assign_rules,
    assign_tiers,
    broadcast_chunks,
    broadcast_lookup,
)
from tidemark.operators.rollup import merge_rollup, rollup
from tidemark.operators.rule_table import assign_rules_by_source
from tidemark.operators.shape import assign_chunk
from tidemark.plans.maintain import compact_datasource, compact_table, retain_datasource, retain_table
from tidemark.plans.queries.base import SQL_METRICS, VALUE_METRICS, events, query, table
from tidemark.session import shared_folder
from tidemark.sources.snapshots import END, read_snapshot, write_snapshot
from tidemark.sources.tables import read_datasource, write_datasource
from tidemark.spec import CHUNK, TIME, Rule

AS_OF = "2024-01-31"
RULES = [
    Rule("drop", interval="2024-01-03/2024-01-05"),
    Rule("broadcastByPeriod", period="P2D", include_future=True),
    Rule("dropByPeriod", period="P7D"),
]
TIER_RULES = [
    Rule("dropByPeriod", period="P3D", include_future=True),
    Rule("load", tiers={"hot": 2, "cold": 1}),
    Rule("loadForever"),
]


def hour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour roll-up of events, written once because a compaction with an offset reads its input in parts."""
    folder = shared_folder(spark, "hours")
    rows = assign_chunk(rollup(events(spark, sf_dir), ["event_type"], VALUE_METRICS, "HOUR"), "HOUR")
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


@query(
    "compact_day",
    f"""SELECT date_trunc('day', ts) AS __time, date_trunc('day', ts) AS __chunk, event_type, {SQL_METRICS}
        FROM events GROUP BY ALL""",
)
def compact_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = assign_chunk(rollup(events(spark, sf_dir), ["event_type"], VALUE_METRICS, "HOUR"), "HOUR")
    return compact(hours, "DAY", ["event_type"], VALUE_METRICS, query_granularity="DAY")


@query(
    "compact_skip",
    f"""WITH m AS (SELECT max(date_trunc('hour', ts)) + INTERVAL 1 HOUR - INTERVAL 2 DAY AS settled FROM events),
             e AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT settled FROM m) AS done FROM events)
        SELECT CASE WHEN done THEN date_trunc('day', ts) ELSE date_trunc('hour', ts) END AS __time,
               CASE WHEN done THEN date_trunc('day', ts) ELSE date_trunc('hour', ts) END AS __chunk,
               event_type, {SQL_METRICS} FROM e GROUP BY 1, 2, 3, done""",
)
def compact_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(
        hour_rows(spark, sf_dir),
        "DAY",
        ["event_type"],
        VALUE_METRICS,
        query_granularity="DAY",
        skip_offset="P2D",
        current_grain="HOUR",
    )


@query(
    "reprocess",
    f"""SELECT date_trunc('hour', ts) AS __time, date_trunc('month', ts) AS __chunk, event_type, user_id, {SQL_METRICS}
        FROM events GROUP BY ALL""",
)
def reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw day chunks become rolled-up month chunks."""
    raw = assign_chunk(events(spark, sf_dir), "DAY")
    return compact(
        raw, "MONTH", ["event_type", "user_id"], VALUE_METRICS, query_granularity="HOUR", partial=False
    )


@query(
    "segment_numbers",
    """SELECT event_id, date_trunc('day', ts) AS __chunk,
              (row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) - 1) // 100 AS __segment
       FROM events""",
)
def segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_chunk(events(spark, sf_dir), "DAY").select("event_id", TIME, CHUNK)
    return assign_segment(rows, ["event_id"], max_rows=100).drop(TIME)


@query(
    "chunk_summary",
    """SELECT date_trunc('day', ts) AS __chunk, count(*) AS rows, min(ts) AS min_time, max(ts) AS max_time,
              CAST(ceil(count(*) / 100.0) AS BIGINT) AS segments
       FROM events GROUP BY ALL""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_summary(assign_chunk(events(spark, sf_dir), "DAY"), max_rows=100)


@query(
    "maintained_table",
    f"""SELECT date_trunc('hour', ts) AS __time, date_trunc('month', ts) AS __chunk, event_type, {SQL_METRICS}
        FROM events WHERE date_trunc('day', ts) < TIMESTAMP '2024-01-24' GROUP BY ALL""",
)
def maintained_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day chunks are written, dropped by a rule, and compacted to month chunks, table by table."""
    root = shared_folder(spark, "tables")
    rows = rollup(events(spark, sf_dir), ["event_type"], VALUE_METRICS, "HOUR")
    write_datasource(assign_chunk(rows, "DAY"), root, "days")
    retain_datasource(spark, root, "days", "kept", [Rule("dropByPeriod", period="P7D")], AS_OF, "DAY")
    compact_datasource(spark, root, "kept", "months", "MONTH", ["event_type"], VALUE_METRICS)
    return read_datasource(spark, root, "months")


def day_table(spark: SparkSession, sf_dir: str) -> str:
    """A table of day chunks, written in two commits: users by even and by odd number."""
    root = shared_folder(spark, "snapshots")
    for rest, mode in ((0, "whole"), (1, "append")):
        rows = rollup(events(spark, sf_dir).where(F.col("user_id") % 2 == rest), ["event_type"], VALUE_METRICS, "HOUR")
        write_snapshot(assign_chunk(rows, "DAY"), root, "events", "DAY", mode)
    return root


@query(
    "compact_twice",
    f"""SELECT date_trunc('day', ts) AS __time, date_trunc('week', ts) AS __chunk, date_trunc('week', ts) + INTERVAL 7 DAY AS __end,
               event_type, {SQL_METRICS}, true AS second_is_idle FROM events GROUP BY ALL""",
)
def compact_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second compaction finds nothing to do and makes no version."""
    root = day_table(spark, sf_dir)
    compact_table(spark, root, "events", "WEEK", ["event_type"], VALUE_METRICS, "DAY")
    again = compact_table(spark, root, "events", "WEEK", ["event_type"], VALUE_METRICS, "DAY")
    return read_snapshot(spark, root, "events").withColumn("second_is_idle", F.lit(again is None))


_SETTLED = """(date_trunc('week', ts) + INTERVAL 7 DAY <=
               (SELECT max(date_trunc('day', ts)) + INTERVAL 1 DAY - INTERVAL 1 DAY FROM events))"""


@query(
    "rules_mixed",
    f"""WITH e AS (SELECT *, {_SETTLED} AS done FROM events),
             g AS (SELECT CASE WHEN done THEN date_trunc('week', ts) ELSE date_trunc('day', ts) END AS __chunk,
                          date_trunc('hour', ts) AS __time, done, event_type, {SQL_METRICS} FROM e GROUP BY 1, 2, 3, 4),
             c AS (SELECT *, __chunk + CASE WHEN done THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END AS __end FROM g)
        SELECT * EXCLUDE done FROM c WHERE NOT (__chunk >= TIMESTAMP '2024-01-08' AND __end <= TIMESTAMP '2024-01-17')
          AND NOT (__chunk >= TIMESTAMP '2024-01-30' AND __end <= TIMESTAMP '2024-01-31')""",
)
def rules_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week chunks beside day chunks: a rule that ends within a week drops the weeks before, not that one."""
    root = day_table(spark, sf_dir)
    compact_table(spark, root, "events", "WEEK", ["event_type"], VALUE_METRICS, "HOUR", skip_offset="P1D")
    rules = [Rule("drop", interval="2024-01-08/2024-01-17"), Rule("dropByPeriod", period="P1D")]
    retain_table(spark, root, "events", rules, AS_OF)
    return merge_rollup(read_snapshot(spark, root, "events"), ["event_type", CHUNK, END], VALUE_METRICS, "HOUR")


@query(
    "retain_twice",
    f"""SELECT date_trunc('hour', ts) AS __time, date_trunc('day', ts) AS __chunk, event_type, {SQL_METRICS} FROM events
        WHERE ts < TIMESTAMP '2024-01-24' GROUP BY ALL""",
)
def retain_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come back between two runs are dropped again; a stricter rule then drops more."""
    root = day_table(spark, sf_dir)
    for days in ("P3D", "P7D"):
        retain_table(spark, root, "events", [Rule("dropByPeriod", period=days)], AS_OF)
        late = rollup(events(spark, sf_dir).where(F.col(TIME) >= "2024-01-30"), ["event_type"], VALUE_METRICS, "HOUR")
        write_snapshot(assign_chunk(late, "DAY"), root, "events", "DAY", "append")
    retain_table(spark, root, "events", [Rule("dropByPeriod", period="P7D")], AS_OF)
    rows = read_snapshot(spark, root, "events").drop(END)
    return compact(rows, "DAY", ["event_type"], VALUE_METRICS, "HOUR")


@query(
    "month_read",
    """SELECT event_id, ts AS __time, date_trunc('month', ts) AS __chunk, date_trunc('month', ts) + INTERVAL 1 MONTH AS __end
       FROM events WHERE (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11') OR ts >= TIMESTAMP '2024-01-20 06:00:00'""",
)
def month_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals inside month chunks, found by the chunks' own ends."""
    root = shared_folder(spark, "snapshots")
    rows = assign_chunk(events(spark, sf_dir).select("event_id", TIME), "MONTH")
    write_snapshot(rows, root, "months", "MONTH")
    return read_snapshot(spark, root, "months", ["2024-01-10/2024-01-11", "2024-01-20T06:00/2030-01-01"])


@query(
    "replace_part",
    f"""SELECT event_id, ts AS __time, CASE WHEN hour(ts) = 5 AND day(ts) < 9 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END AS __chunk,
               CASE WHEN hour(ts) = 5 AND day(ts) < 9 THEN -value ELSE value END AS value FROM events""",
)
def replace_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours written anew over day chunks hide that hour of the day and nothing else."""
    root = shared_folder(spark, "snapshots")
    rows = events(spark, sf_dir).select("event_id", TIME, "value")
    write_snapshot(assign_chunk(rows, "DAY"), root, "days", "DAY")
    fifth = rows.where((F.hour(TIME) == 5) & (F.day(TIME) < 9)).withColumn("value", -F.col("value"))
    write_snapshot(assign_chunk(fifth, "HOUR"), root, "days", "HOUR")
    return read_snapshot(spark, root, "days").drop(END)


_DAY_CHUNKS = "SELECT date_trunc('day', ts) AS __chunk, count(*) AS rows FROM events GROUP BY ALL"
_ACTION = """CASE WHEN __chunk >= TIMESTAMP '2024-01-03' AND __chunk + INTERVAL 1 DAY <= TIMESTAMP '2024-01-05' THEN 0
                  WHEN __chunk + INTERVAL 1 DAY > TIMESTAMP '2024-01-29' THEN 1
                  WHEN __chunk >= TIMESTAMP '2024-01-24' AND __chunk + INTERVAL 1 DAY <= TIMESTAMP '2024-01-31' THEN 2 END"""


def day_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_summary(assign_chunk(events(spark, sf_dir), "DAY")).select(CHUNK, "rows")


@query(
    "rules_assign",
    f"""SELECT __chunk, rows, rule_index,
               CASE rule_index WHEN 0 THEN 'drop' WHEN 1 THEN 'broadcastByPeriod' WHEN 2 THEN 'dropByPeriod' END AS rule_type,
               CASE rule_index WHEN 0 THEN 'drop' WHEN 1 THEN 'broadcast' WHEN 2 THEN 'drop' ELSE 'keep' END AS action
        FROM (SELECT *, {_ACTION} AS rule_index FROM ({_DAY_CHUNKS}))""",
)
def rules_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_rules(day_chunks(spark, sf_dir), RULES, AS_OF, "DAY")


@query(
    "tiers",
    f"""SELECT __chunk, rows, unnest(['hot', 'cold']) AS tier, unnest([2, 1]) AS replicas
        FROM ({_DAY_CHUNKS}) WHERE __chunk < TIMESTAMP '2024-01-28'""",
)
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_tiers(day_chunks(spark, sf_dir), TIER_RULES, AS_OF, "DAY")


@query(
    "tiers_default",
    f"SELECT __chunk, rows, '_default_tier' AS tier, 2 AS replicas FROM ({_DAY_CHUNKS})",
)
def tiers_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order matters: a rule after ``loadForever`` never decides."""
    return assign_tiers(day_chunks(spark, sf_dir), [Rule("loadForever"), Rule("dropByPeriod", period="P7D")], AS_OF, "DAY")


@query(
    "retained_rows",
    f"""SELECT event_id, __chunk FROM (SELECT event_id, date_trunc('day', ts) AS __chunk FROM events)
        WHERE coalesce({_ACTION}, 3) NOT IN (0, 2)""",
)
def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_chunk(events(spark, sf_dir), "DAY").select("event_id", CHUNK)
    return apply_retention(rows, RULES, AS_OF, "DAY")


@query(
    "broadcast_lookup",
    """SELECT o_orderpriority, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE date_trunc('day', o_orderdate) + INTERVAL 1 DAY > TIMESTAMP '2001-07-01' GROUP BY ALL""",
)
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(TIME, F.col("o_orderdate").cast("timestamp"))
    rule = [Rule("broadcastByPeriod", period="P1M", include_future=True)]
    recent = broadcast_chunks(assign_chunk(orders, "DAY"), rule, "2001-08-01", "DAY")
    lookup = recent.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = broadcast_lookup(table(spark, sf_dir, "lineitem"), lookup, "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )


SOURCE_RULES = {
    "click": '[{"type":"drop","interval":"2024-01-03/2024-01-05T12:00"},{"type":"dropByPeriod","period":"P7D"},{"type":"loadForever"}]',
    "view": '[{"type":"loadForever"},{"type":"dropByPeriod","period":"P1M"}]',
    "purchase": '[5,{"type":"broadcastByPeriod","period":"P2D","includeFuture":true},{"type":"drop","interval":"2023-12-01/2024-01-10"}]',
    "error": "[]",
}


@query(
    "rules_by_source",
    """WITH c AS (SELECT event_type, date_trunc('day', ts) AS __chunk, count(*) AS rows FROM events GROUP BY ALL),
            e AS (SELECT *, __chunk + INTERVAL 1 DAY AS __end FROM c),
            r AS (SELECT *, CASE event_type
                WHEN 'click' THEN CASE WHEN __chunk >= TIMESTAMP '2024-01-03' AND __end <= TIMESTAMP '2024-01-05 12:00:00' THEN 0
                    WHEN __chunk >= TIMESTAMP '2024-01-24' AND __end <= TIMESTAMP '2024-01-31' THEN 1 ELSE 2 END
                WHEN 'view' THEN 0
                WHEN 'purchase' THEN CASE WHEN __end > TIMESTAMP '2024-01-29' THEN 1 WHEN __end <= TIMESTAMP '2024-01-10' THEN 2 END
                END AS rule_index FROM e)
       SELECT *, CASE event_type || rule_index WHEN 'click0' THEN 'drop' WHEN 'click1' THEN 'dropByPeriod' WHEN 'click2' THEN 'loadForever'
                     WHEN 'view0' THEN 'loadForever' WHEN 'purchase1' THEN 'broadcastByPeriod' WHEN 'purchase2' THEN 'drop' END AS rule_type,
              CASE event_type || rule_index WHEN 'click0' THEN 'drop' WHEN 'click1' THEN 'drop' WHEN 'click2' THEN 'load'
                     WHEN 'view0' THEN 'load' WHEN 'purchase1' THEN 'broadcast' WHEN 'purchase2' THEN 'drop' ELSE 'keep' END AS action FROM r""",
)
def rules_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event is a datasource with a rule document of its own."""
    rows = assign_chunk(events(spark, sf_dir), "DAY")
    chunks = rows.groupBy("event_type", CHUNK).agg(F.count(F.lit(1)).alias("rows"))
    chunks = chunks.withColumn(END, F.col(CHUNK) + F.expr("INTERVAL 1 DAY"))
    document = F.lit(None).cast("string")
    for source, text in SOURCE_RULES.items():
        document = F.when(F.col("event_type") == source, F.lit(text)).otherwise(document)
    documents = rows.select("event_type").distinct().withColumn("rules", document)
    return assign_rules_by_source(chunks, rules_to_rows(documents, "event_type"), "event_type", AS_OF)
