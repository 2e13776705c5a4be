"""Session settings and the shared folder for checkpoints and derived tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.caseSensitive": "false",
}


def build_session(master: str | None = None, app: str = "attestra", **extra: str) -> SparkSession:
    """Start (or reuse) a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply to a session made elsewhere those SETTINGS that can change while it runs."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    context) wins. Where neither is set, a local master gets a local folder; on
    a cluster that would lie on another disk for each executor, so it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    if configured or context.getCheckpointDir():
        return configured or context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def derived_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one derived table."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the shared folder and read back: pruned when read, and safe from lost executors."""
    path = derived_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Written and read back, so that the data survives the loss of any executor and is pruned when read again."""
    return materialise(frame, "lineage")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input with fewer splits than cores, such as one file of one row group.

    A large table has more splits than cores and is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if frame.rdd.getNumPartitions() < cores else frame


def small_side(frame: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """The frame marked for broadcast if, once materialised, it is small; else as it is.

    Beyond the bound the caller's join stays a shuffle join, which adaptive
    execution splits where a key is hot.
    """
    kept = cut_lineage(frame)
    return F.broadcast(kept) if kept.count() <= max_rows else kept
