"""Sinks: versioned corpora, month-sharded result rows, merged suites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key, with_scalars


def manifest(df: DataFrame, registry: DataFrame, version: str, mix: str) -> DataFrame:
    """Kept count, teacher and weight per admitted source, plus the total."""
    kept = df.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    rows = registry.join(kept, "source", "left").select(
        F.lit(version).alias("version"), F.lit(mix).alias("mix"), "source", "teacher", "weight",
        F.coalesce("kept", F.lit(0)).alias("kept"),
    )
    total = kept.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("total"))
    return with_scalars(rows, total)


def write_versioned(df: DataFrame, registry: DataFrame, out: str, version: str, mix: str = "blend") -> DataFrame:
    """JSON lines by source plus a manifest table; returns the manifest of what was written."""
    target = f"{out}/{version}"
    df.write.mode("errorifexists").partitionBy("source").json(f"{target}/train")
    written = df.sparkSession.read.schema("source string").json(f"{target}/train")
    table = manifest(written, registry, version, mix)
    table.write.mode("errorifexists").json(f"{target}/manifest")
    return df.sparkSession.read.schema(table.schema).json(f"{target}/manifest")


def append_results(df: DataFrame, out: str, ts: str = "timestamp") -> None:
    """Append rows below profile=<p>/month=<yyyy-MM>; a large shard is split over several tasks."""
    rows = df.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", "profile", "month")
    rows.write.mode("append").partitionBy("profile", "month").parquet(out)


def read_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(out)


def merge_suite_results(existing: DataFrame, new: DataFrame, key: Sequence[str] = ("suite",)) -> DataFrame:
    """Suites of the new table replace suites of the same name; one row per task remains.

    The suite list is reduced to names first, so the anti join moves no task rows twice.
    """
    replaced = new.select(*key).distinct()
    return existing.join(replaced, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def suite_summary(tasks: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("all_passed"))
    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        passed.alias("passed_tasks"),
        F.round(F.coalesce(passed / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 6).alias("pass_rate"),
    )


def write_table(df: DataFrame, out: str) -> None:
    """Label tables and other plain Parquet outputs."""
    df.write.mode("errorifexists").parquet(out)


def latest_by_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in newest])
