"""Session settings and helpers for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: tasks at most that list the folders of a batch
LISTING_TASKS = 256


def build_session(app: str = "sunledger", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on (wall-clock columns are UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # small cached tables need not keep the full number of shuffle partitions
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    # a task of the listing job serves many folders; one a folder costs more to start than to list
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    # run files written with nanosecond timestamps are converted by the scan
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a scratch folder only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sunledger-checkpoint-"))


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table that several jobs read, and read it back.

    The table lies in the shared folder, so it outlives executors, and readers prune its
    columns.  With ``by`` it is laid out in one folder per value, large values in several
    files, so that a reader of one value scans only that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    if by:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path, compression="zstd")
    else:
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
