"""Rules of many datasources as rows: which rule of its own datasource decides each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import stamp
from tidemark.operators.retention import ACTIONS, KEEP
from tidemark.spec import CHUNK

END = "__end"
_FIELDS = "type string, period string, interval string, includeFuture boolean"


def period_column(text: Column) -> Column:
    """ISO-8601 period texts as intervals; null for what is none."""
    # ISO-8601 period layout, in the order of make_interval.
    layout = r"^P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(?:T(?=.)(\d+H)?(\d+M)?(\d+(?:\.\d+)?S)?)?$"

    def number(group: int, kind: str) -> Column:
        found = F.regexp_extract(text, layout, group)
        return F.coalesce(F.rtrim(found, F.lit("YMWDHS")).try_cast(kind), F.lit(0).cast(kind))

    whole = [number(i, "int") for i in range(1, 7)]
    return F.when(text.rlike(layout), F.make_interval(*whole, number(7, "decimal(18,6)")))


def rule_bounds(rules: DataFrame, key: str, as_of: str) -> DataFrame:
    """Rule rows (``key, position, type, rule, error``) as time bounds.

    ``inside`` rules want a chunk within ``low`` and ``high``, the others an
    overlap; a null bound is open. A broken rule, one of an unknown type or
    without its period or interval matches nothing, and ``fault`` says so.
    """
    now = stamp(as_of)
    told = rules.select(key, "position", "error", F.from_json("rule", _FIELDS).alias("r"))
    kind, period = F.col("r.type"), period_column(F.col("r.period"))
    future = F.coalesce("r.includeFuture", F.lit(False))
    parts = F.split("r.interval", "/", 2)
    low, high = F.get(parts, F.lit(0)).try_cast("timestamp"), F.get(parts, F.lit(1)).try_cast("timestamp")
    periodic = kind.isin("dropByPeriod", "broadcastByPeriod")
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(kind.isin(*ACTIONS), F.lit(False)), F.lit("unknown rule type"))
        .when(periodic & period.isNull(), F.lit("rule needs a period"))
        .when((kind == "drop") & (low.isNull() | high.isNull()), F.lit("rule needs an interval"))
    )
    return told.select(
        key,
        "position",
        kind.alias("rule_type"),
        kind.isin("drop", "dropByPeriod").alias("inside"),
        F.when(kind == "drop", low).when(periodic, now - period).alias("low"),
        F.when(kind == "drop", high).when(periodic & ~future, now).alias("high"),
        fault.alias("fault"),
    )


def _months(low: Column, high: Column) -> Column:
    month = lambda t: (F.year(t) * 12 + F.month(t)).cast("int")
    return F.sequence(month(low), F.greatest(month(low), month(high)))


def assign_rules_by_source(chunks: DataFrame, rules: DataFrame, key: str, as_of: str) -> DataFrame:
    """Add ``rule_index, rule_type, action`` of the first matching rule of each chunk's datasource; no match is ``keep``.

    ``chunks`` have ``key``, ``__chunk`` and ``__end``; ``rules`` are rows as
    ``rules_to_rows`` gives them. A rule with both bounds meets only chunks that
    touch the same months; a rule with an open bound meets its datasource's
    chunks. The first match is a minimum, taken in each task before the shuffle.
    """
    sound = rule_bounds(rules, key, as_of).where("fault IS NULL").drop("fault").withColumnRenamed(key, "__k")
    bounded = F.col("low").isNotNull() & F.col("high").isNotNull()
    places = chunks.select(F.col(key).alias("__k2"), CHUNK, END).distinct()
    inside = (F.col("low").isNull() | (F.col(CHUNK) >= F.col("low"))) & (F.col("high").isNull() | (F.col(END) <= F.col("high")))
    overlap = (F.col("low").isNull() | (F.col(END) > F.col("low"))) & (F.col("high").isNull() | (F.col(CHUNK) < F.col("high")))
    hit = F.when(F.col("inside"), inside).otherwise(overlap)
    same = F.col("__k") == F.col("__k2")
    slotted = places.withColumn("__slot", F.explode(_months(F.col(CHUNK), F.col(END))))
    cut = sound.where(bounded & (F.col("low") < F.col("high"))).withColumn("__slot2", F.explode(_months(F.col("low"), F.col("high"))))
    near = slotted.join(cut, same & (F.col("__slot") == F.col("__slot2"))).where(hit)
    open_ = places.join(sound.where(~bounded), same).where(hit)
    met = near.select("__k", CHUNK, END, "position", "rule_type").unionByName(open_.select("__k", CHUNK, END, "position", "rule_type"))
    first = met.groupBy("__k", F.col(CHUNK).alias("__c"), F.col(END).alias("__e")).agg(
        F.min("position").alias("rule_index"), F.min_by("rule_type", "position").alias("rule_type")
    )
    joined = chunks.join(first, (chunks[key] == first["__k"]) & (chunks[CHUNK] == first["__c"]) & (chunks[END] == first["__e"]), "left")
    action = F.lit(KEEP)
    for name, what in ACTIONS.items():
        action = F.when(F.col("rule_type") == name, F.lit(what)).otherwise(action)
    return joined.drop("__k", "__c", "__e").withColumn("action", action)
