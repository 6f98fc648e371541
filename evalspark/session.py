"""Session, durable intermediate tables and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .functions.text import fold_name


# Python workers get batches of at most this size, however wide the rows are: a row of two tiles has a megabyte, and a batch
# of 10,000 of them, Spark's default, would hold all that a task reads.
BATCH_BYTES = "4m"


def get_session(app: str = "evalspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; named by the cluster in spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="evalspark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return os.path.join(shared_dir(spark), f"{fold_name(label)}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Write a reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a file scan only when it has fewer splits than the cluster has cores.

    Large tables have many splits and pass through unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
