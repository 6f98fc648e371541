"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

# White space of the word definition: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder, through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # the session is gone; the shared folder's owner clears what is left
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the program ends."""
    path = work_dir(spark, label)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and lets the planner see the measured size,
    so that a join broadcasts the table only when it is small.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_IDS = 2_000_000  # some 50 MB in an executor


def join_ids(rows: DataFrame, ids: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a narrow table of ids, however many: it is broadcast up to BROADCAST_IDS rows, so that no text is
    shuffled, and beyond that both sides are shuffled by id."""
    ids = stored(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Python workers get batches of at most 4 MB, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
