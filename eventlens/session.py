"""Session construction and access to the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "eventlens", master: str | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew handling).

    On a cluster the master, memory and shuffle parallelism come from the
    submit configuration; only a local session gets small-data defaults here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")  # the last one wins, as in other JSON readers
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = (
                b.config("spark.sql.shuffle.partitions", "8")
                .config("spark.driver.memory", os.environ.get("EVENTLENS_DRIVER_MEMORY", "12g"))
            )
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local master without that
    setting (tests, laptops) gets a temporary folder; a cluster without it is
    an error, because a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="eventlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several jobs read.

    The rows are written once as a table in the shared scratch folder, so a
    lost executor costs a re-read, and later jobs scan only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by key into a fixed number of tasks.

    For grouped functions that compute much on few bytes: adaptive execution
    sizes tasks by bytes and would merge such groups into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
