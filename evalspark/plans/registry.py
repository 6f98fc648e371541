"""Query registry and the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet inputs by attribute; nothing is read until a query touches the table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # also in a session that is not ours

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """documents for work that is heavy per row: a table of few files is spread over all cores."""
        return spread(self.documents)

    @property
    def event_rows(self) -> DataFrame:
        """events, spread like texts: for JSON work on every row."""
        return spread(self.events)

    @property
    def events(self) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp"))


def query(name: str, oracle: str | None = None):
    """Register a function of Tables under ``name``; ``oracle`` is the same result in plain SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap
