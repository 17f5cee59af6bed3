"""Ordered rules that keep, drop, place or broadcast time chunks.

A rule looks only at a chunk's start and end, so a decision is an expression
on the partition column: applying rules to a table prunes its files and joins
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import grain_length, period, stamp
from tidemark.spec import CHUNK, Rule, parse_interval

# What each rule type does with the chunks it matches.
ACTIONS = {
    "load": "load",
    "loadForever": "load",
    "drop": "drop",
    "dropByPeriod": "drop",
    "broadcastByPeriod": "broadcast",
}
KEEP = "keep"


def rule_matches(rule: Rule, start: Column, end: Column, as_of: str) -> Column:
    if rule.type not in ACTIONS:
        raise ValueError(f"unknown rule type: {rule.type!r}")
    if rule.type in ("load", "loadForever"):
        return F.lit(True)
    if rule.type == "drop":
        low, high = parse_interval(rule.interval)
        return (start >= stamp(low)) & (end <= stamp(high))
    now = stamp(as_of)
    low = now - period(rule.period)
    if rule.type == "dropByPeriod":
        inside = start >= low
        return inside if rule.include_future else inside & (end <= now)
    overlap = end > low
    return overlap if rule.include_future else overlap & (start < now)


def _chain(
    rules: Sequence[Rule], grain: str | Column, as_of: str, value: Callable[[int, Rule], Column], other: Column
) -> Column:
    """The first match's value. ``grain`` is the length of all chunks, or a column with the end of each."""
    start = F.col(CHUNK)
    end = start + grain_length(grain) if isinstance(grain, str) else grain
    # built from the last rule outwards, so that the first match decides
    decision = other
    for i in reversed(range(len(rules))):
        decision = F.when(rule_matches(rules[i], start, end, as_of), value(i, rules[i])).otherwise(decision)
    return decision


def decided_action(rules: Sequence[Rule], grain: str | Column, as_of: str) -> Column:
    return _chain(rules, grain, as_of, lambda _, r: F.lit(ACTIONS[r.type]), F.lit(KEEP))


def assign_rules(chunks: DataFrame, rules: Sequence[Rule], as_of: str, grain: str | Column) -> DataFrame:
    """Add the deciding rule's place, type and action; no match is ``keep``."""
    return chunks.select(
        "*",
        _chain(rules, grain, as_of, lambda i, _: F.lit(i), F.lit(None).cast("int")).alias("rule_index"),
        _chain(rules, grain, as_of, lambda _, r: F.lit(r.type), F.lit(None).cast("string")).alias("rule_type"),
        decided_action(rules, grain, as_of).alias("action"),
    )


def assign_tiers(chunks: DataFrame, rules: Sequence[Rule], as_of: str, grain: str | Column) -> DataFrame:
    """One row per chunk, tier and replica count, for chunks that a rule loads."""

    def tiers(_: int, rule: Rule) -> Column:
        if ACTIONS[rule.type] != "load":
            return F.lit(None).cast("map<string,int>")
        return F.create_map(*[F.lit(x) for pair in rule.tiers.items() for x in pair]).cast("map<string,int>")

    placed = _chain(rules, grain, as_of, tiers, F.lit(None).cast("map<string,int>"))
    return chunks.select("*", F.explode(placed).alias("tier", "replicas"))


def apply_retention(df: DataFrame, rules: Sequence[Rule], as_of: str, grain: str | Column) -> DataFrame:
    """Only rows of chunks that no rule drops."""
    return df.where(decided_action(rules, grain, as_of) != "drop")


def broadcast_chunks(df: DataFrame, rules: Sequence[Rule], as_of: str, grain: str | Column) -> DataFrame:
    """Only rows of chunks that a rule wants on every worker."""
    return df.where(decided_action(rules, grain, as_of) == "broadcast")


def broadcast_lookup(fact: DataFrame, lookup: DataFrame, on: str | Iterable[str], how: str = "inner") -> DataFrame:
    """Join a lookup that is sent to every worker while it is small.

    AQE knows the lookup's size once it is read: below the session's broadcast
    threshold it is sent out, beyond it both sides are shuffled and hot keys split.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return fact.join(lookup, keys, how)
