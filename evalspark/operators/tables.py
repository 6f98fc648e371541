"""Joins and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from .ranking import first_per_key


def enrich_labels(attrs: DataFrame, prose: DataFrame, key: str) -> DataFrame:
    return attrs.join(prose, key, "left")


def lookup_dim(df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """Value from a dimension, or the default. Spark broadcasts the dimension only while it is small."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def inherit_parent(parent: DataFrame, child: DataFrame, key: str, parent_key: str, columns: Sequence[str]) -> DataFrame:
    """Children appended to their parents; they inherit the named columns only, the rest stays NULL."""
    facts = parent.select(F.col(key).alias(parent_key), *columns)
    inherited = child.join(facts, parent_key, "left").drop(parent_key)
    return parent.unionByName(inherited, allowMissingColumns=True)


def inner_on_keys(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Keys present on both sides; of repeated keys the last row wins on each side."""
    last = lambda df: first_per_key(df, [key], [F.col(order).desc()]).drop(order)
    return last(a).join(last(b), key)


def intersect_ids(key: str, tables: Sequence[DataFrame]) -> DataFrame:
    """Ids every table has, in one shuffle: each table sets its own bit, all bits must be set."""
    flagged = [t.select(key, F.lit(1 << i).alias("_bit")) for i, t in enumerate(tables)]
    bits = reduce(DataFrame.unionByName, flagged).groupBy(key).agg(F.bit_or("_bit").alias("_bits"))
    return bits.filter(F.col("_bits") == (1 << len(tables)) - 1).select(key)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def semi_holdout(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, rows whose key is not)."""
    return df.join(ids.select(key), key, "left_semi"), df.join(ids.select(key), key, "left_anti")


def union_by_name(tables: Sequence[DataFrame], as_text: Sequence[str] = ()) -> DataFrame:
    """Rows of all tables, missing columns NULL; id columns of mixed types become text first."""
    def fixed(df):
        return df.withColumns({c: F.col(c).cast("string") for c in as_text if c in df.columns})

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), map(fixed, tables))


def freq_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two frequency tables over the union of their keys, missing = 0."""
    left, right = a.select(key, F.col("n").alias("n_a")), b.select(key, F.col("n").alias("n_b"))
    return left.join(right, key, "full_outer").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")})


def pattern_hits(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Rows x patterns that match, for a pattern list given as code. No join: one pass per row."""
    c = F.col(text)
    hits = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return df.withColumn("pattern", F.explode(hits))


def pattern_join(df: DataFrame, text: str, patterns: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Rows x patterns that match, for a table (pattern, rx) read at run time; rx that do not compile match nothing.

    An automaton over the literals of all patterns picks those that are tried on a row; no rows are shuffled.
    """
    parts = [df.withColumn("pattern", F.explode(names)) for names in automaton.pattern_names(df, F.col(text), patterns, ignore_case)]
    return reduce(DataFrame.unionByName, parts) if parts else df.withColumn("pattern", F.lit(None).cast(dict(patterns.dtypes)["pattern"])).limit(0)


def pair_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Items measured validly (value > 0) on both sides."""
    left = a.filter(F.col(value) > 0).select(key, F.col(value).alias("base"))
    return left.join(b.filter(F.col(value) > 0).select(key, F.col(value).alias("other")), key)


def compare_topk(a: DataFrame, b: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Overlap of two top-k lists per query; queries without overlap count 0."""
    top_a, top_b = (x.filter(F.col(rank) <= k).select(query, item) for x in (a, b))
    shared = top_a.join(top_b, [query, item]).groupBy(query).agg(F.count(F.lit(1)).alias("overlap"))
    return top_a.select(query).distinct().join(shared, query, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
