"""Chunking, keyword and vector search, rank fusion and context assembly - all queries in one job."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, words
from . import keyword_index, tiles
from .ranking import top_k
from .tables import pattern_hits, pattern_join

RRF_K = 60


def chunk_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 512) -> DataFrame:
    """Greedy packing of sentences: a chunk closes when the next sentence would pass ``size`` characters.

    Joining blanks are not counted. Runs inside the row, no shuffle.
    """
    sentences = F.split(text, r"(?<=[.!?])\s+", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc, s):
        full = acc["cur"].isNotNull() & (acc["n"] + F.length(s) > size)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["cur"].isNull(), s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"),
            F.when(full, F.length(s)).otherwise(acc["n"] + F.length(s)).alias("n"))

    packed = F.aggregate(sentences, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))
    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, F.posexplode(packed).alias("idx", "content"))
    return rows.select(F.concat(col(doc_id).cast("string"), F.lit("::chunk_"), F.col("idx").cast("string")).alias("chunk_id"), doc_id, "idx", "content")


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Distinct query terms present / (words + 50), positive scores only, ties by chunk id.

    Chunks stay where they are: each task turns its chunks into inverted segments, scores the blocks of them that can
    still win (``keyword_index``), and passes on k rows per query. (query, chunk) pairs are never rows, however common a
    term is.
    """
    return keyword_index.search(queries, keyword_index.index_rows(chunks), k).drop("read", "scored")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, item: str = "chunk_id", exclude: str | None = None) -> DataFrame:
    """Best inner products per query, exact. queries: query_id, vector (and excluded ids); vectors: item, vector."""
    item_type, query_type = dict(vectors.dtypes)[item], dict(queries.dtypes)["query_id"]
    if exclude is None:
        queries = queries.withColumn("_exclude", F.array().cast(f"array<{item_type}>"))
    else:
        queries = queries.withColumn("_exclude", F.coalesce(F.col(exclude), F.array().cast(f"array<{item_type}>")))
    pairs = tiles.tile_pairs(tiles.pack_vectors(vectors, item, "vector"), tiles.pack_queries(queries, "_exclude"))
    best = tiles.top_scores(pairs, k, tiles.inner_products, item_type, query_type).withColumnRenamed("item", item)
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col(item)], k)


def rrf(rankings: Sequence[DataFrame], k: int, item: str = "chunk_id", rrf_k: int = RRF_K, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    votes = reduce(DataFrame.unionByName, [r.select(*key, item, (1.0 / (rrf_k + F.col("rank"))).alias("_v")) for r in rankings])
    fused = votes.groupBy(*key, item).agg(F.round(F.sum("_v"), 12).alias("score"))
    return top_k(fused, list(key), [F.col("score").desc(), F.col(item)], k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Keyword and dense lists of 2k, fused. queries: query_id, query, vector."""
    return rrf([keyword_search(queries, chunks, 2 * k), dense_search(queries, vectors, 2 * k)], k)


def multi_query(variants: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, reranked: bool = False) -> DataFrame:
    """One hybrid list per variant, fused per query; 2k are kept when a reranker follows."""
    keyed = variants.withColumn("_q", F.struct("query_id", "variant"))
    ids = keyed.withColumn("query_id", F.concat_ws("\u0001", F.col("_q.query_id").cast("string"), F.col("_q.variant").cast("string")))
    found = hybrid_search(ids.select("query_id", "query", "vector"), chunks, vectors, k)
    parts = F.split("query_id", "\u0001")
    per_variant = found.withColumn("variant", parts[1]).withColumn("query_id", parts[0].cast(dict(variants.dtypes)["query_id"]))
    return rrf([per_variant], 2 * k if reranked else k)


def fuse_hypothetical(queries: DataFrame, hypothetical: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Results of the question and of a supplied hypothetical answer, fused."""
    both = queries.select("query_id", F.lit("q").alias("variant"), "query", "vector").unionByName(
        hypothetical.select("query_id", F.lit("h").alias("variant"), "query", "vector"))
    return multi_query(both, chunks, vectors, k)


def rerank(candidates: DataFrame, scores: DataFrame | None, k: int, item: str = "chunk_id") -> DataFrame:
    """Best k by a supplied score; without scores the input order."""
    if scores is None:
        return candidates.filter(F.col("rank") <= k)
    joined = candidates.withColumnRenamed("rank", "_was").drop("score").join(
        scores.select("query_id", item, F.col("score").alias("score")), ["query_id", item], "left")
    return top_k(joined, ["query_id"], [F.col("score").desc_nulls_last(), F.col("_was")], k).drop("_was")


def adaptive_route(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, scores: DataFrame | None, k: int) -> DataFrame:
    """By column complexity: SIMPLE dense only (k <= 5), COMPLEX hybrid of 2k reranked, else hybrid."""
    kind = F.coalesce(F.col("complexity"), F.lit(""))
    simple = dense_search(queries.filter(kind == "SIMPLE"), vectors, min(k, 5))
    deep = rerank(hybrid_search(queries.filter(kind == "COMPLEX"), chunks, vectors, 2 * k), scores, k)
    rest = hybrid_search(queries.filter(~kind.isin("SIMPLE", "COMPLEX")), chunks, vectors, k)
    out = ("query_id", "chunk_id", "rank")
    return simple.select(*out, F.lit("simple").alias("route")).unionByName(
        deep.select(*out, F.lit("complex").alias("route"))).unionByName(rest.select(*out, F.lit("default").alias("route")))


def valid_patterns(patterns: Mapping[str, str]) -> dict[str, str]:
    kept = {}
    for name, pattern in patterns.items():
        try:
            re.compile(pattern)
        except re.error:
            continue
        kept[name] = pattern
    return kept


def grep_chunks(patterns: Mapping[str, str], chunks: DataFrame, n: int = 5, order: Sequence[str] = ("doc_id", "idx")) -> DataFrame:
    """First n chunks per pattern, ignoring case; invalid patterns give no rows."""
    usable = {name: f"(?i){p}" for name, p in valid_patterns(patterns).items()}
    if not usable:
        return chunks.withColumn("pattern", F.lit("")).withColumn("rank", F.lit(0)).limit(0)
    return top_k(pattern_hits(chunks, "content", usable), ["pattern"], [F.col(c) for c in order], n)


def grep_table(patterns: DataFrame, chunks: DataFrame, n: int = 5, order: Sequence[str] = ("doc_id", "idx")) -> DataFrame:
    """grep_chunks for a table (pattern, rx) of patterns."""
    return top_k(pattern_join(chunks, "content", patterns, ignore_case=True), ["pattern"], [F.col(c) for c in order], n)


def fetch_documents(ids: DataFrame, docs: DataFrame, max_chars: int = 8000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents by id; the budget of the tool that shows them cuts longer texts behind a marker."""
    found = ids.select(doc_id).distinct().join(docs.select(doc_id, text), doc_id)
    cut = F.concat(F.substring(text, 1, max_chars), F.lit("\n... [truncated]"))
    return found.withColumn(text, F.when(F.length(text) > max_chars, cut).otherwise(F.col(text)))


def enrich_chunks(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """A supplied context in front of the chunk; the chunk alone where none is given."""
    added = F.nullif(F.trim("context"), F.lit(""))
    return chunks.join(contexts.select("chunk_id", "context"), "chunk_id", "left").withColumn(
        "content", F.concat_ws(" ", added, "content")).drop("context")


def assemble_context(ranked: DataFrame, chunks: DataFrame, order: str = "rank", separator: str = "\n\n---\n\n") -> DataFrame:
    """One context text per query from its ranked list (a top-k, so a short list)."""
    text = F.concat(F.lit("["), "chunk_id", F.lit("]\n"), "content")
    rows = ranked.join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", F.struct(order, text.alias("t")).alias("s"))
    listed = F.array_sort(F.collect_list("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda s: s["t"]), separator).alias("context"))


def keyword_overlap(expected, answer):
    """Share of distinct expected words found in the answer."""
    want, got = F.array_distinct(words(F.lower(col(expected)))), F.array_distinct(words(F.lower(col(answer))))
    return F.round(F.size(F.array_intersect(want, got)) / F.greatest(F.size(want), F.lit(1)), 3)


def compare_modes(results: DataFrame, baseline: str) -> DataFrame:
    from .ranking import with_scalars

    sums = results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("answer_length"), 6).alias("avg_length"), F.round(F.avg("elapsed_s"), 6).alias("avg_elapsed_s"),
        F.round(F.avg("search_ms"), 6).alias("avg_search_ms"))
    base = sums.filter(F.col("mode") == baseline).select(F.col("avg_length").alias("_b"))
    return with_scalars(sums, base).withColumn(
        "length_delta_percent", F.round((F.col("avg_length") / F.nullif("_b", F.lit(0.0)) - 1) * 100, 6)).drop("_b")


def recall_at_k(truth: DataFrame, pred: DataFrame, k: int, item: str = "chunk_id") -> DataFrame:
    """Mean share of the true top k that was found; queries without results count 0."""
    from .tables import compare_topk

    overlap = compare_topk(truth, pred, k, "query_id", item)
    return overlap.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("overlap") / k), 6).alias("recall"))
