"""JSON documents: equality, containment, drift, specs, compaction, rules, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.documents import content_hash, json_equal
from tidemark.operators.documents import (
    compare_includes,
    enrich_compaction,
    extract_datasource,
    extract_task_id,
    json_drift,
    resolve_spec,
    rules_text,
    rules_to_rows,
)
from tidemark.plans.queries.base import query, table


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A current and a desired document per order.

    Desired is the same in another key order for status O, has another nested
    customer for F, and is a part of current for P; urgent orders ask for one
    more key.
    """

    def detail(customer: Column) -> Column:
        return F.struct(
            F.struct(customer.alias("id"), F.lit("c").alias("kind")).alias("customer"),
            F.col("o_totalprice").alias("total"),
            F.col("o_orderpriority").alias("priority"),
        )

    tags = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("tag"))
    current = F.to_json(
        F.struct(F.col("o_orderkey").alias("key"), detail(F.col("o_custkey")).alias("detail"), tags.alias("tags"))
    )

    def other_order(customer: Column) -> Column:
        return F.to_json(F.struct(tags.alias("tags"), detail(customer).alias("detail"), F.col("o_orderkey").alias("key")))

    part = F.to_json(
        F.struct(
            F.struct(F.struct(F.col("o_custkey").alias("id")).alias("customer")).alias("detail"),
            F.array(F.lit("tag"), F.col("o_orderstatus")).alias("tags"),
        )
    )
    changed = (
        F.when(F.col("o_orderstatus") == "O", other_order(F.col("o_custkey")))
        .when(F.col("o_orderstatus") == "F", other_order(F.col("o_custkey") + 1))
        .otherwise(part)
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    desired = F.when(urgent, F.concat(F.lit('{"note":null,'), F.expr("substr(__d, 2)"))).otherwise(F.col("__d"))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderstatus", "o_orderpriority", current.alias("current"), changed.alias("__d"))
        .withColumn("desired", desired)
        .drop("__d")
    )


@query(
    "json_equal",
    """SELECT o_orderkey, o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AS same FROM orders""",
)
def equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_documents(spark, sf_dir)
    return docs.select("o_orderkey", json_equal(F.col("current"), F.col("desired")).alias("same"))


@query(
    "json_includes",
    """SELECT o_orderkey, o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' AS included,
              CAST(NULL AS VARCHAR) AS error FROM orders""",
)
def includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_documents(spark, sf_dir)
    return compare_includes(docs, "current", "desired").select("o_orderkey", "included", "error")


@query(
    "json_drift",
    """SELECT o_orderkey, '["detail"]["customer"]["id"]' AS path, 'differs' AS state,
              CAST(o_custkey + 1 AS VARCHAR) AS desired FROM orders WHERE o_orderstatus = 'F'
       UNION ALL
       SELECT o_orderkey, '["note"]', 'missing', 'null' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_drift(order_documents(spark, sf_dir), "o_orderkey", "current", "desired")


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a native and a text document; which of them is sound depends on the segment."""
    good = F.to_json(F.struct(F.struct(F.struct(F.col("c_name").alias("dataSource")).alias("dataSchema")).alias("spec")))
    number = F.to_json(F.struct(F.struct(F.struct(F.col("c_custkey").alias("dataSource")).alias("dataSchema")).alias("spec")))
    segment = F.col("c_mktsegment")
    native = F.when(segment == "BUILDING", good).when(segment == "HOUSEHOLD", F.expr("left(__good, 10)"))
    text = (
        F.when(segment.isin("BUILDING", "MACHINERY", "HOUSEHOLD"), F.col("__good"))
        .when(segment == "AUTOMOBILE", number)
        .otherwise(F.lit(""))
    )
    return (
        table(spark, sf_dir, "customer")
        .withColumn("__good", good)
        .select("c_custkey", "c_name", "c_mktsegment", native.alias("native"), text.alias("text"))
    )


@query(
    "spec_resolve",
    """SELECT c_custkey,
              CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
                     THEN '{"spec":{"dataSchema":{"dataSource":"' || c_name || '"}}}'
                   WHEN c_mktsegment = 'AUTOMOBILE' THEN '{"spec":{"dataSchema":{"dataSource":' || c_custkey || '}}}' END AS spec,
              CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN NULL
                   WHEN c_mktsegment = 'HOUSEHOLD' THEN 'error unmarshalling nativeSpec'
                   ELSE 'no valid ingestion spec provided' END AS error
       FROM customer""",
)
def spec_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_spec(spec_documents(spark, sf_dir)).select("c_custkey", "spec", "error")


@query(
    "spec_datasource",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END AS "dataSource",
              CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'dataSource not found in spec' END AS error
       FROM customer""",
)
def spec_datasource(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_spec(spec_documents(spark, sf_dir)).drop("error")
    return extract_datasource(resolved).select("c_custkey", "dataSource", "error")


@query(
    "compaction_docs",
    """SELECT c_custkey,
              CASE WHEN c_acctbal < 0 THEN '{}'
                   WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
                     THEN '{"dataSource":"' || c_name || '","skip":"PT0S","task":{"nation":' || c_nationkey || '}}' END AS document,
              CASE WHEN c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL
                   ELSE 'error getting dataSource' END AS error
       FROM customer""",
)
def compaction_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_spec(spec_documents(spark, sf_dir)).drop("error").select("c_custkey", "spec")
    wanted = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(
            F.col("c_acctbal") >= 0,
            F.to_json(
                F.struct(
                    F.struct(F.col("c_nationkey").alias("nation")).alias("task"),
                    F.lit("old").alias("dataSource"),
                    F.lit("PT0S").alias("skip"),
                )
            ),
        ).alias("compaction"),
    )
    return enrich_compaction(resolved.join(wanted, "c_custkey")).select("c_custkey", "document", "error")


@query(
    "task_ids",
    """SELECT c_custkey,
              CASE c_mktsegment WHEN 'BUILDING' THEN 'task-' || c_custkey WHEN 'MACHINERY' THEN 'id-' || c_custkey END AS task_id,
              CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL
                   WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN 'error parsing response'
                   ELSE 'task id not found' END AS error
       FROM customer""",
)
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    task = F.concat(F.lit("task-"), F.col("c_custkey"))
    ident = F.concat(F.lit("id-"), F.col("c_custkey"))
    response = (
        F.when(segment == "BUILDING", F.to_json(F.struct(task.alias("task"), ident.alias("id"))))
        .when(segment == "MACHINERY", F.to_json(F.struct(F.lit("").alias("task"), ident.alias("id"))))
        .when(segment == "HOUSEHOLD", F.lit('{"task":"t'))
        .when(segment == "AUTOMOBILE", F.to_json(F.struct(F.col("c_custkey").alias("task"))))
        .otherwise(F.lit("{}"))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", response.alias("response"))
    return extract_task_id(rows).drop("response")


@query(
    "rule_rows",
    """SELECT c_custkey, position, CASE position WHEN 0 THEN 'load' ELSE 'drop' END AS type,
              CASE position WHEN 0 THEN '{"tieredReplicants":{"hot":' || c_nationkey || '},"type":"load"}'
                   ELSE '{"interval":"2012-01-01/2013-01-01","type":"drop"}' END AS rule,
              CAST(NULL AS VARCHAR) AS error
       FROM customer, (VALUES (0), (1)) v(position) WHERE c_acctbal >= 0""",
)
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_to_rows(rule_documents(spark, sf_dir), "c_custkey")


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = F.to_json(
        F.struct(F.lit("load").alias("type"), F.struct(F.col("c_nationkey").alias("hot")).alias("tieredReplicants"))
    )
    drop = F.lit('{"type":"drop","interval":"2012-01-01/2013-01-01"}')
    rules = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("["), load, F.lit(","), drop, F.lit("]"))).otherwise(F.lit("[]"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.alias("rules"))


@query(
    "rule_texts",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0
                THEN '[{"tieredReplicants":{"hot":' || c_nationkey || '},"type":"load"},{"interval":"2012-01-01/2013-01-01","type":"drop"}]'
                ELSE 'null' END AS rules
       FROM customer""",
)
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_documents(spark, sf_dir).select("c_custkey", rules_text(F.col("rules")).alias("rules"))


@query(
    "content_hash",
    """SELECT o_orderkey, to_base64(unhex(sha1('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
              ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}'))) AS hash
       FROM orders""",
)
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", content_hash("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("hash")
    )
