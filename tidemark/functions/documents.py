"""JSON documents: canonical text, equality, containment, content hash.

Comparing whole documents needs recursion to any depth and numbers that are
equal when their doubles are. Column functions have neither, so these three
run as Arrow-batched functions on a small helper; that was also measured to be
several times faster than opening documents by nested higher-order functions.
All else is built from Spark's own functions.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIFT = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("path", "state", "desired")]))

# Send the helper functions along with a job, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def canonical_json(doc: Column) -> Column:
    """Text with sorted keys and no spaces; null if it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(doc))


def map_like(doc: Column) -> Column:
    """True if the text is a JSON object or null, the two that read as a map."""
    shape = doc.rlike(r"^\s*(\{|null\s*$)")
    return F.coalesce(shape & F.try_parse_json(doc).isNotNull(), F.lit(False))


def ordered_maps(col: Column, kind: T.DataType) -> Column:
    """The same value with the entries of maps at any depth in the order of their keys."""
    if "map" not in kind.simpleString():
        return col
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(e["key"].alias("key"), ordered_maps(e["value"], kind.valueType).alias("value")),
        )
        return F.map_from_entries(
            F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: ordered_maps(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[ordered_maps(col[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(col.isNotNull(), fields)
    return col


def with_ordered_maps(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """These columns, each with its maps in order."""
    return [ordered_maps(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in names]


def content_hash(*cols: Column | str) -> Column:
    """Base64 of the SHA-1 of the row as JSON text. For columns with maps take ``row_hash``, which puts them in order."""
    return F.base64(F.unhex(F.sha1(F.to_json(F.struct(*cols)))))


def row_hash(df: DataFrame, names: Iterable[str]) -> Column:
    """``content_hash`` of these columns of a frame, whatever the order in which maps were filled."""
    return content_hash(*with_ordered_maps(df, names))


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _number(text: str) -> int | float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return int(value) if value.is_integer() and abs(value) < 2**53 else value


def _whole(text: str) -> int | float:
    # a whole number of up to 15 digits is the same as a double
    return int(text) if len(text) < 16 else _number(text)


def _no_constant(text: str) -> None:
    raise ValueError(f"not JSON: {text}")


class _Reader:
    """Reads documents; made once per batch, as its decoder cannot travel with a job."""

    def __init__(self) -> None:
        self.decode = json.JSONDecoder(parse_float=_number, parse_int=_whole, parse_constant=_no_constant).decode

    def read(self, text: str | None) -> tuple[bool, object]:
        """Whether the text is JSON, and what it says; of a repeated key the last counts."""
        try:
            return True, self.decode(text)
        except (TypeError, ValueError, RecursionError):
            return False, None

    def map_pair(self, current: str | None, desired: str | None) -> tuple[object, object] | None:
        """Both documents, or nothing if one of them is no JSON map."""
        first = self.read(current)
        second = first if current == desired else self.read(desired)
        if all(ok and (doc is None or isinstance(doc, dict)) for ok, doc in (first, second)):
            return first[1], second[1]
        return None


def _mark(member: object) -> object:
    """A hashable stand-in; scalars keep their kind, as Python takes true for 1."""
    return _ENCODER.encode(member) if isinstance(member, (dict, list)) else (member.__class__, member)


def _holds(have: object, want: object) -> bool:
    """Whether a value that is not a pair of objects satisfies the wanted one."""
    if have.__class__ is not want.__class__:
        return False
    if isinstance(want, list):
        return {_mark(m) for m in want} <= {_mark(m) for m in have}
    return have == want


def _gaps(current: object, desired: object) -> Iterator[tuple[tuple, str, object]]:
    """Path, state and wanted node of all that current lacks or holds differently.

    A null document is an empty map: it wants nothing and holds nothing.
    """
    absent = object()
    todo = [((), current or {}, desired or {})]
    while todo:
        at, have, want = todo.pop()
        for key, node in want.items():
            found = have.get(key, absent)
            if found is absent:
                yield (*at, key), "missing", node
            elif isinstance(node, dict) and isinstance(found, dict):
                todo.append(((*at, key), found, node))
            elif not _holds(found, node):
                yield (*at, key), "differs", node


def _equal(reader: _Reader, a: str | None, b: str | None) -> bool | None:
    (ok_a, left), (ok_b, right) = reader.read(a), reader.read(b)
    if not (ok_a and ok_b):
        return None
    if left != right:
        return False
    # Python takes true for 1 and false for 0: where these words occur, compare as text too
    words = "true" in a or "false" in a or "true" in b or "false" in b
    return not words or _ENCODER.encode(left) == _ENCODER.encode(right)


def _drift_rows(pair: tuple[object, object] | None) -> list[dict[str, str]] | None:
    return None if pair is None else [
        {
            "path": "".join(f"[{_ENCODER.encode(key)}]" for key in path),
            "state": state,
            "desired": _ENCODER.encode(node),
        }
        for path, state, node in sorted(_gaps(*pair), key=lambda gap: gap[0])
    ]


def _included(pair: tuple[object, object] | None) -> bool | None:
    return None if pair is None else pair[0] is pair[1] or next(_gaps(*pair), None) is None


@F.pandas_udf(T.BooleanType())
def _json_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    reader = _Reader()
    return pd.Series([_equal(reader, a, b) for a, b in zip(left, right)], dtype="object")


@F.pandas_udf(T.BooleanType())
def _json_includes(current: pd.Series, desired: pd.Series) -> pd.Series:
    pair = _Reader().map_pair
    return pd.Series([_included(pair(c, d)) for c, d in zip(current, desired)], dtype="object")


@F.pandas_udf(DRIFT)
def _json_drift(current: pd.Series, desired: pd.Series) -> pd.Series:
    pair = _Reader().map_pair
    return pd.Series([_drift_rows(pair(c, d)) for c, d in zip(current, desired)], dtype="object")


def json_equal(a: Column, b: Column) -> Column:
    """Deep equality, key order ignored, ``1`` equal to ``1.0``; null if a side is no JSON."""
    return _json_equal(a, b)


def json_includes(current: Column, desired: Column) -> Column:
    """True if current holds every pair of desired; null if a side is no JSON map."""
    return _json_includes(current, desired)


def drift_items(current: Column, desired: Column) -> Column:
    """``array<struct<path, state, desired>>`` of what current lacks or holds differently; null if a side is no JSON map."""
    return _json_drift(current, desired)
