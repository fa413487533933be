"""Session helpers: a local builder for tests, and shared-folder handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "netloom") -> SparkSession:
    """A single-machine session with the settings the cluster should also have."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # call sites of column expressions cost more than the analysis of large plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # pages deeper than this are sorted by the cluster, not held in memory
        .config("spark.sql.execution.topKSortFallbackThreshold", "100000")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    On a cluster this is ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a fresh temporary folder is made and recorded.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("netloom.local.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
        folder = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("netloom.local.shared", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, kept when executors are
    lost, and of a size that the optimizer knows when it picks a join."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_in(spark: SparkSession, parts: int) -> Iterator[None]:
    """At least ``parts`` shuffle partitions for what is written within; adaptive execution merges small ones."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if int(before) < parts:
        spark.conf.set(name, str(parts))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage so that lost executors do not force a full recompute.

    Reliable ``checkpoint()`` into the shared folder; partitioning and ordering
    of the plan survive it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(os.path.join(shared_folder(df.sparkSession), "rdd"))
    return df.checkpoint()
