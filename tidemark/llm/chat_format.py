"""Chat formatting: each participant's view of a dialogue, with that speaker as assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table

TURNS_PER_SAMPLE = 1024
# The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "unknown"


def perspectives(turns: DataFrame, turns_per_sample: int = TURNS_PER_SAMPLE) -> DataFrame:
    """One row per sample and speaker: ``conv_id, part, speaker, n_turns, n_own, text, mask``.

    A sample is a run of ``turns_per_sample`` turn numbers of a conversation, so
    that a conversation of any length is split among tasks and no turn is lost.
    Every speaker of the sample but the system gets a rendering in which their
    own turns are the assistant's, the others' are users named by role, and the
    system's stay. ``mask`` lists the code points to train on, ``start:end``
    with exclusive ends: the own texts with their closing mark.

    A repeated row is one utterance; different ones of the same turn follow by
    role, then text. A null role is called ``unknown``, a null text is empty, and
    null turns form a part of their own with null as number. The opening of a
    mark inside a text is split by a space, so that no text can end a turn.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / turns_per_sample).alias("part"),
        "turn",
        F.coalesce("role", F.lit(UNNAMED)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()
    samples = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t.role), lambda r: r != SYSTEM))
    views = samples.withColumn("speaker", F.explode(speakers))

    def head(t: Column) -> Column:
        named = F.concat(F.lit(f"{OPEN}user name="), t.role, F.lit("\n"))
        return (
            F.when(t.role == F.col("speaker"), F.lit(f"{OPEN}assistant\n"))
            .when(t.role == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n"))
            .otherwise(named)
        )

    segments = F.transform(
        "turns",
        lambda t: F.struct(
            (t.role == F.col("speaker")).alias("own"),
            F.length(head(t)).alias("head"),
            F.concat(head(t), t.text, F.lit(CLOSE)).alias("text"),
        ),
    )
    views = views.withColumn("turns", segments)
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask")),
        lambda a, t: F.struct(
            (a.at + F.length(t.text) + 1).alias("at"),
            F.when(
                t.own,
                F.array_append(
                    a.mask,
                    F.concat_ws(":", (a.at + t.head).cast("string"), (a.at + F.length(t.text)).cast("string")),
                ),
            )
            .otherwise(a.mask)
            .alias("mask"),
        ),
    )
    return views.select(
        "conv_id",
        "part",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t.own)).cast("long").alias("n_own"),
        F.concat(F.array_join(F.transform("turns", lambda t: t.text), "\n"), F.lit("\n")).alias("text"),
        F.array_join(walked.mask, ",").alias("mask"),
    )


SQL = r"""
WITH t AS (
    SELECT DISTINCT conv_id, turn // 1024 AS part, turn, coalesce(role, 'unknown') AS role,
        replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations
), v AS (
    SELECT t.*, speaker, t.role = speaker AS own,
        CASE WHEN t.role = speaker THEN '<|im_start|>assistant' || chr(10)
             WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
             ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head
    FROM t JOIN (SELECT DISTINCT conv_id, part, role AS speaker FROM t WHERE role <> 'system') s
        ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.part IS NOT DISTINCT FROM s.part
), p AS (
    SELECT *, length(head) + length(text) + 10 AS size,
        sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text
            ROWS UNBOUNDED PRECEDING) - (length(head) + length(text) + 11) AS begins
    FROM v
)
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
    string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
    string_agg((begins + length(head))::BIGINT || ':' || (begins + size)::BIGINT, ',' ORDER BY turn NULLS FIRST, role, text)
        FILTER (own) AS mask
FROM p GROUP BY conv_id, part, speaker
"""


@query("op4_chat_format", SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views of all conversations."""
    return perspectives(table(spark, sf_dir, "conversations"))
