"""Scopes and labels: one scope overrides, extends or selects another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_empty(narrow: Column, wide: Column) -> Column:
    """The narrow text unless it is null or empty, else the wide one."""
    return F.coalesce(F.nullif(narrow, F.lit("")), wide)


def first_non_null(narrow: Column, wide: Column) -> Column:
    return F.coalesce(narrow, wide)


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _put_over(under: Column, top: Column) -> Column:
    rest = F.map_filter(under, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(rest, top)


def merge_maps(wide: Column, narrow: Column, forced: Column | None = None) -> Column:
    """Union of maps; on the same key forced wins over narrow, narrow over wide."""
    merged = _put_over(F.coalesce(wide, _no_map()), F.coalesce(narrow, _no_map()))
    return merged if forced is None else _put_over(merged, F.coalesce(forced, _no_map()))


def concat_scopes(wide: Column, narrow: Column) -> Column:
    """Wide items, then narrow items; repeated items stay."""
    empty = F.array()
    return F.concat(F.coalesce(wide, empty), F.coalesce(narrow, empty))


def labels_match(labels: Column, selector: Mapping[str, str]) -> Column:
    hit = F.lit(True)
    for key, value in selector.items():
        hit = hit & F.try_element_at(labels, F.lit(key)).eqNullSafe(F.lit(value))
    return hit


def flag_set(annotations: Column, key: str) -> Column:
    return F.try_element_at(annotations, F.lit(key)).eqNullSafe(F.lit("true"))


def sorted_map_json(col: Column) -> Column:
    """A map as JSON text with sorted keys, so that it can be a grouping key."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(col))))
