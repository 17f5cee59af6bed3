"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# A shuffle partition of about this size fits an executor's task with room to sort.
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions(shuffle_bytes: int) -> int:
    """Partitions for the largest shuffle that is expected."""
    return max(200, -(-shuffle_bytes // PARTITION_BYTES))


def build_session(
    app: str = "tidemark", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators count on.

    Only UTC is required for right results. AQE merges small shuffle
    partitions and splits skewed joins and writes, but makes no more partitions
    than it starts with: ``shuffle_bytes`` sets that number for a large run.
    Stream state is kept in RocksDB, so that it need not fit in memory.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        # of a repeated key in a document the last counts
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    if shuffle_bytes:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions(shuffle_bytes))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used. Without that setting
    a local temporary folder is taken, and only for a local master: executors
    on other machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
