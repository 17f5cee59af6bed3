"""Tables of JSON documents: comparing, choosing, reading and enriching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.documents import canonical_json, drift_items, json_includes, map_like

# Error texts.
NO_SPEC = "no valid ingestion spec provided"
BAD_NATIVE = "error unmarshalling nativeSpec"
BAD_SPEC = "error unmarshalling Spec"
NO_DATASOURCE = "dataSource not found in spec"
BAD_COMPACTION = "error unmarshalling compaction"
COMPACTION_NO_DATASOURCE = "error getting dataSource"
NO_TASK_ID = "task id not found"
BAD_RULE = "error unmarshalling rule"


def _list(cols: str | Iterable[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _kind_at(node: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def compare_includes(df: DataFrame, current: str, desired: str) -> DataFrame:
    """Add ``included`` and, where a document is no JSON map, ``error``."""
    included = df.withColumn("included", json_includes(F.col(current), F.col(desired)))
    return included.withColumn("error", F.when(F.col("included").isNull(), F.lit("error parsing JSON")))


def json_drift(df: DataFrame, key: str | Iterable[str], current: str, desired: str) -> DataFrame:
    """One row per path of desired that current lacks or holds differently.

    ``path`` reads ``["a"]["b"]``, ``state`` is ``missing`` or ``differs``. A
    list differs if current lacks one of its members. A pair of which one is no
    JSON map gives one row without a path, of state ``error``.
    """
    keys = _list(key)
    unequal = df.where(~F.col(current).eqNullSafe(F.col(desired)) | ~map_like(F.col(desired)))
    items = unequal.select(*keys, drift_items(F.col(current), F.col(desired)).alias("__items"))
    none = F.lit(None).cast("string")
    unreadable = F.array(F.struct(none.alias("path"), F.lit("error").alias("state"), none.alias("desired")))
    opened = items.select(*keys, F.explode(F.coalesce("__items", unreadable)).alias("__item"))
    return opened.select(*keys, "__item.*")


def resolve_spec(df: DataFrame, native: str = "native", text: str = "text") -> DataFrame:
    """Add ``spec``, the native document or else the text one, and ``error``."""
    first, second = F.nullif(F.col(native), F.lit("")), F.nullif(F.col(text), F.lit(""))
    chosen = F.coalesce(first, second)
    return df.withColumn("spec", F.when(map_like(chosen), canonical_json(chosen))).withColumn(
        "error",
        F.when(chosen.isNull(), F.lit(NO_SPEC))
        .when(~map_like(chosen) & first.isNotNull(), F.lit(BAD_NATIVE))
        .when(~map_like(chosen), F.lit(BAD_SPEC)),
    )


def datasource_of(spec: Column) -> Column:
    """``spec.dataSchema.dataSource`` if it is a text, else null."""
    node = F.try_variant_get(F.try_parse_json(spec), "$.spec.dataSchema.dataSource", "variant")
    return F.when(_kind_at(node) == "STRING", F.try_variant_get(node, "$", "string"))


def extract_datasource(df: DataFrame, spec: str = "spec") -> DataFrame:
    name = datasource_of(F.col(spec))
    return df.withColumn("dataSource", name).withColumn(
        "error", F.when(name.isNull(), F.lit(NO_DATASOURCE))
    )


def enrich_compaction(df: DataFrame, compaction: str = "compaction", spec: str = "spec") -> DataFrame:
    """Add ``document``: the compaction document with the datasource put in.

    No compaction gives ``{}`` whatever the spec says.
    """
    doc = F.nullif(F.col(compaction), F.lit(""))
    name = datasource_of(F.col(spec))
    none = F.create_map().cast("map<string,variant>")
    members = F.coalesce(F.from_json(canonical_json(doc), "map<string,variant>"), none)
    put = F.map_concat(
        F.map_filter(members, lambda k, _: k != "dataSource"),
        F.create_map(F.lit("dataSource"), name.cast("variant")),
    )
    ok = map_like(doc) & name.isNotNull()
    return df.withColumn(
        "document", F.when(doc.isNull(), F.lit("{}")).when(ok, canonical_json(F.to_json(put)))
    ).withColumn(
        "error",
        F.when(doc.isNull(), F.lit(None).cast("string"))
        .when(~map_like(doc), F.lit(BAD_COMPACTION))
        .when(name.isNull(), F.lit(COMPACTION_NO_DATASOURCE)),
    )


def extract_task_id(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``task_id``: ``task`` unless empty, else ``id`` unless empty, else an error."""
    members = F.map_entries(F.from_json(F.col(response), "map<string,variant>"))

    def member(name: str) -> Column:
        """Names match without case; of several the last counts."""
        return F.try_element_at(F.filter(members, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]

    def text_at(name: str) -> Column:
        node = member(name)
        return F.when(_kind_at(node) == "STRING", F.nullif(F.try_variant_get(node, "$", "string"), F.lit("")))

    def well_typed(name: str) -> Column:
        node = member(name)
        return node.isNull() | _kind_at(node).isin("STRING", "VOID")

    readable = map_like(F.col(response)) & well_typed("task") & well_typed("id")
    found = F.when(readable, F.coalesce(text_at("task"), text_at("id")))
    return df.withColumn("task_id", found).withColumn(
        "error",
        F.when(~readable, F.lit("error parsing response")).when(found.isNull(), F.lit(NO_TASK_ID)),
    )


def rules_to_rows(df: DataFrame, key: str | Iterable[str], rules: str = "rules") -> DataFrame:
    """One row per rule document of a JSON list, in its order; no rules, no rows.

    A text that is no JSON list gives one row without position, with the error.
    """
    opened = df.where(~rules_broken(F.col(rules))).select(
        *_list(key), F.posexplode(F.from_json(F.col(rules), "array<variant>")).alias("position", "__rule")
    )
    broken = df.where(rules_broken(F.col(rules))).select(
        *_list(key),
        F.lit(None).cast("int").alias("position"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(BAD_RULE).alias("error"),
    )
    rows = opened.select(        *_list(key),
        "position",
        F.try_variant_get("__rule", "$.type", "string").alias("type"),
        F.to_json("__rule").alias("rule"),
        F.when(~_kind_at(F.col("__rule")).isin("OBJECT", "VOID"), F.lit(BAD_RULE)).alias("error"),
    )
    return rows.unionByName(broken)


def rules_broken(rules: Column) -> Column:
    """True if there is a text that is neither a JSON list nor ``null``."""
    kind = _kind_at(F.try_parse_json(rules))
    return F.coalesce(F.btrim(rules) != "", F.lit(False)) & ~F.coalesce(kind.isin("ARRAY", "VOID"), F.lit(False))


def rules_text(rules: Column) -> Column:
    """The list as one text for the store; an empty list is ``null``, not ``[]``.

    A text that is no JSON list gives a null column, not the text ``null``.
    """
    size = F.size(F.from_json(rules, "array<variant>"))
    return F.when((size > 0), canonical_json(rules)).when(~rules_broken(rules), F.lit("null"))
