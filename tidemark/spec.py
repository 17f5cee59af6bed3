"""What an ingestion declares: time, dimensions, metrics, chunks, rules.

The reading of declared names is ours where the declaration itself leaves it
open. These choices are kept here, in one place:

* intervals are half-open, ``[start, end)``;
* an empty metric list means "no roll-up" unless ``rollup`` is set;
* a dimension value that is no whole number loses its fraction in a ``long``
  dimension, and text that is no number becomes null;
* retention rules: the first matching rule decides, no match keeps the chunk;
* a drop rule needs the chunk inside its interval or period, a broadcast rule
  needs an overlap;
* ``gauge`` keeps the last value, ``count`` the sum, ``timer`` a summary;
* without ``late_rejection`` late stream rows still go into their chunk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TIME = "__time"
CHUNK = "__chunk"
SEGMENT = "__segment"

# Default tier and replica count, and rows per segment.
DEFAULT_TIERS = {"_default_tier": 2}
MAX_ROWS_PER_SEGMENT = 5_000_000

# ISO-8601 period layout, names in the order make_interval takes them.
_PERIOD = re.compile(
    r"P(?:(?P<years>\d+)Y)?(?:(?P<months>\d+)M)?(?:(?P<weeks>\d+)W)?(?:(?P<days>\d+)D)?"
    r"(?:T(?:(?P<hours>\d+)H)?(?:(?P<mins>\d+)M)?(?:(?P<secs>\d+(?:\.\d+)?)S)?)?"
)


def parse_period(text: str) -> dict[str, int | float]:
    """``P1M``, ``P7D``, ``PT1H`` -> keyword arguments of ``make_interval``."""
    match = _PERIOD.fullmatch(text)
    if not match or not any(match.groups()):
        raise ValueError(f"not an ISO-8601 period: {text!r}")
    parts = {k: v for k, v in match.groupdict().items() if v is not None}
    return {k: float(v) if k == "secs" else int(v) for k, v in parts.items()}


def parse_interval(text: str) -> tuple[str, str]:
    """``start/end`` -> the two ISO-8601 texts."""
    start, slash, end = text.partition("/")
    if not (slash and start and end):
        raise ValueError(f"not an interval start/end: {text!r}")
    return start, end


def normal_grain(grain: str | None) -> str | None:
    """Grain name for ``date_trunc``; ``none`` in any case means no truncation."""
    if grain is None or grain.lower() == "none":
        return None
    name = grain.lower()
    if name not in ("second", "minute", "hour", "day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown granularity: {grain!r}")
    return name


@dataclass(frozen=True)
class Dimension:
    name: str
    type: str = "string"


@dataclass(frozen=True)
class Metric:
    """One aggregate column.

    ``scale`` asks ``doubleSum`` to add as decimals of that scale, so that the
    sum does not depend on the order in which partitions are merged.
    """

    name: str
    type: str
    field: str | None = None
    scale: int | None = None


@dataclass(frozen=True)
class Rule:
    type: str
    tiers: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_TIERS))
    period: str | None = None
    interval: str | None = None
    include_future: bool = False

    @staticmethod
    def parse(doc: dict) -> Rule:
        return Rule(
            type=doc["type"],
            tiers=dict(doc.get("tieredReplicants") or DEFAULT_TIERS),
            period=doc.get("period"),
            interval=doc.get("interval"),
            include_future=bool(doc.get("includeFuture", False)),
        )


@dataclass(frozen=True)
class IngestSpec:
    data_source: str
    time_column: str
    time_format: str = "iso"
    dimensions: tuple[Dimension, ...] = ()
    exclusions: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    segment_granularity: str = "day"
    query_granularity: str | None = None
    intervals: tuple[str, ...] = ()
    rollup: bool | None = None
    append: bool = False
    max_rows_per_segment: int = MAX_ROWS_PER_SEGMENT
    io: dict = field(default_factory=dict)

    @property
    def rolls_up(self) -> bool:
        return bool(self.metrics) if self.rollup is None else self.rollup

    @property
    def dimension_names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    @staticmethod
    def parse(doc: dict) -> IngestSpec:
        """Read the nested document form of a declaration."""
        body = doc["spec"]
        schema = body["dataSchema"]
        stamp = schema["timestampSpec"]
        dims = schema.get("dimensionsSpec", {})
        grain = schema.get("granularitySpec", {})
        io = body.get("ioConfig", {})
        return IngestSpec(
            data_source=schema["dataSource"],
            time_column=stamp["column"],
            time_format=stamp.get("format", "auto"),
            dimensions=tuple(
                Dimension(d) if isinstance(d, str) else Dimension(d["name"], d.get("type", "string"))
                for d in dims.get("dimensions", [])
            ),
            exclusions=tuple(dims.get("dimensionExclusions", [])),
            metrics=tuple(
                Metric(m["name"], m["type"], m.get("fieldName")) for m in schema.get("metricsSpec", [])
            ),
            segment_granularity=grain.get("segmentGranularity", "day"),
            query_granularity=grain.get("queryGranularity"),
            intervals=tuple(grain.get("intervals", [])),
            rollup=grain.get("rollup"),
            append=bool(io.get("appendToExisting", "topic" in io)),
            max_rows_per_segment=body.get("tuningConfig", {}).get("maxRowsPerSegment", MAX_ROWS_PER_SEGMENT),
            io=io,
        )
