"""Session helpers: defaults for a local run, and checkpoints on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may be asked to sort for a single key before the key is split.
HOT_ROWS = 2_000_000
HOT_ROWS_CONF = "runlens.hotRows"


def local_session(cpus: int | str = "*", app: str = "runlens") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def hot_rows(spark: SparkSession) -> int:
    """The group size beyond which a group is split over several tasks."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Only where none is named and the driver and its executors are one machine, as in a test, a local one is made.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.getCheckpointDir() and not context.master.startswith("local["):
        raise ValueError("name a folder that every executor can reach in spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="runlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/runlens-{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
