"""Change-only events of a stream.

The rule is the one of the batch operator: a row counts when its status
differs from the one before it of the same key. Within a micro-batch rows are
ordered; between micro-batches the order is that of arrival. The last status
of a key is keyed state: a micro-batch reads and writes its own keys only,
however many there are, and the state store (RocksDB) keeps them on disk.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.sources.streams import period_seconds

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Send the processor along with a job, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rank(value: object) -> tuple:
    """Nulls first, as Spark sorts."""
    return value is not None, value


class LastStatus(StatefulProcessor):
    """Holds a key's last status; gives the rows that change it."""

    def __init__(self, order: list[str], status: str, names: list[str], kind: T.StructType, forget_ms: int | None) -> None:
        self.order, self.status, self.names, self.kind, self.forget_ms = order, status, names, kind, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kind, self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before, changed = self.last.get(), Row(*self.names)
        for row in sorted(rows, key=lambda r: [_rank(r[c]) for c in self.order]):
            now = row[self.status]
            if before is None or before[0] != now:
                yield changed(*row, None if before is None else before[0], before is None)
            before = (now,)
        self.last.update(before)

    def close(self) -> None:
        pass


def read_changes(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/changes")


def stream_status_changes(
    source: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    status: str,
    sink: str,
    checkpoint: str,
    forget_after: str | None = None,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Write changes to ``sink/changes``, with ``previous`` and ``is_first``.

    The last status of each key is in the state store below ``checkpoint``. With
    ``forget_after`` a key that is silent for that time (by the clock) leaves the
    state, and its next row is a first one; such a query looks at the clock again
    and again, so it needs a trigger that repeats. A key's rows of one micro-batch are
    sorted in one task: the source's limit for a micro-batch bounds them.
    """
    if forget_after and not (trigger and "processingTime" in trigger):
        raise ValueError("forget_after needs a processingTime trigger: with any other the query would not end")
    field = source.schema[status]
    kind = T.StructType([T.StructField("status", field.dataType, True)])
    out = T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in source.schema], T.StructField("previous", field.dataType), T.StructField("is_first", T.BooleanType())]
    )
    forget = None if forget_after is None else 1000 * period_seconds(forget_after)
    changed = source.groupBy(*key).transformWithState(
        LastStatus(list(order), status, out.names, kind, forget),
        outputStructType=out,
        outputMode="Append",
        timeMode="None" if forget is None else "ProcessingTime",
    )
    # keyed state of transformWithState needs RocksDB, whatever store the session names;
    # the query takes its own copy of the settings when it starts
    conf = source.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return (
            changed.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start(f"{sink}/changes")
        )
    finally:
        if before is None:
            conf.unset(STORE)
        else:
            conf.set(STORE, before)
