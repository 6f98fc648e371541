"""Inverted keyword index over chunks: postings by term within segments, block bounds, and top-k search.

A segment holds up to SEGMENT chunks of one task, ordered by length, so shorter chunks, whose scores can be higher, come
first. For every term it has the places of the chunks that hold it, and one 64-bit map of the blocks of BLOCK places in
which it occurs. A query reads the postings of its own terms only. A block's bound is the number of query terms that
occur in it over the length of its shortest chunk; blocks below the k-th best score found so far are not scored.

A segment's postings are bounded by its chunks, so a term that every chunk holds has no larger list than any other
segment's, and segments spread over the cluster. A stored index is cut into buckets of term hashes: a search reads the
buckets of its terms, not the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from . import tiles
from .ranking import top_k

SEGMENT, BLOCK = 8192, 128  # 64 blocks a segment: one bit each
BUCKETS = 32
PRIOR = 50  # words added to a chunk's length in the score


def term_hashes(text) -> F.Column:
    """Different words of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def bucket_of(term: F.Column, buckets: int = BUCKETS) -> F.Column:
    """Number of the hash range that holds a term; ranges ascend, so buckets side by side stay sorted."""
    shift = 64 - (buckets.bit_length() - 1)
    return (F.shiftright(term, shift) + buckets // 2).cast("int")


class _Segment:
    """The inverted form of up to SEGMENT chunks."""

    def __init__(self, ids: pa.Array, n_words: np.ndarray, offsets: np.ndarray, terms: np.ndarray):
        order = np.argsort(n_words, kind="stable")
        self.ids, self.n_words = ids.take(pa.array(order)), n_words[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(place, np.diff(offsets))
        by_term = np.lexsort((owner, terms))
        terms, self.places = terms[by_term], owner[by_term].astype(np.uint16)
        self.starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        self.terms = terms[self.starts]
        bit = np.uint64(1) << (self.places // BLOCK).astype(np.uint64)
        self.blocks = np.bitwise_or.reduceat(bit, self.starts) if len(terms) else np.zeros(0, np.uint64)

    def rows(self, number: int, buckets: int) -> Iterator[tuple]:
        """One row a bucket: the chunks stand in the first, the postings in the bucket of their term."""
        ends = np.append(self.starts[1:], len(self.places))
        top = buckets.bit_length() - 1
        bucket = (self.terms >> (64 - top)) + buckets // 2 if top else np.zeros(len(self.terms), np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            low, high = edges[b], edges[b + 1]
            if low < high or b == 0:
                first = self.starts[low] if low < len(self.starts) else 0
                last = ends[high - 1] if high > low else first
                yield (number, b, self.ids.to_pylist() if b == 0 else [], self.n_words.astype(np.int64).tobytes() if b == 0 else b"",
                       self.terms[low:high].tobytes(), (ends[low:high] - self.starts[low:high]).astype(np.int32).tobytes(), self.places[first:last].tobytes(), self.blocks[low:high].tobytes())


COLUMNS = ["tile", "bucket", "ids", "n_words", "terms", "sizes", "places", "blocks"]


def index_rows(chunks: DataFrame, buckets: int = 1) -> DataFrame:
    """The index of chunks (chunk_id, content): a row for each segment and bucket of terms. Nothing is shuffled."""
    id_type = dict(chunks.dtypes)["chunk_id"]
    held = chunks.select("chunk_id", words(F.lower("content")).alias("_w"))
    held = held.select("chunk_id", F.size("_w").cast("long").alias("n"), F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w))).alias("terms")).filter(F.size("terms") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, SEGMENT - size)
                kept.append(some)
                at, size = at + some.num_rows, size + some.num_rows
                if size == SEGMENT:
                    yield packed(kept, number)
                    kept, size, number = [], 0, number + 1
        if size:
            yield packed(kept, number)

    def packed(kept: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        lists = table.column("terms").combine_chunks()
        segment = _Segment(table.column("chunk_id").combine_chunks(), table.column("n").to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten().to_numpy())
        columns = list(zip(*segment.rows(number, buckets)))
        kinds = [pa.int64(), pa.int32(), pa.list_(table.schema.field("chunk_id").type), *[pa.binary()] * 5]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=COLUMNS)

    schema = f"tile long, bucket int, ids array<{id_type}>, n_words binary, terms binary, sizes binary, places binary, blocks binary"
    return held.mapInArrow(run, schema)


def write_index(chunks: DataFrame, path: str) -> None:
    """Store the index of chunks, one folder a bucket."""
    index_rows(chunks, BUCKETS).write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """The part of a stored index that queries (query_id, query) need: a row a segment.

    Only the folders of the queries' terms are read, at most BUCKETS names go through the driver.
    """
    asked = queries.select(F.explode(term_hashes(F.col("query"))).alias("term")).select(bucket_of(F.col("term")).alias("bucket")).distinct()
    wanted = sorted({0, *(r.bucket for r in asked.collect())})
    parts = spark.read.parquet(path).filter(F.col("bucket").isin(wanted))
    fields = ["n_words", "terms", "sizes", "places", "blocks"]
    gathered = parts.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids", *fields))).alias("p"))
    joined = lambda name: F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x[name])).alias(name)
    return gathered.select("tile", F.col("p")[0]["ids"].alias("ids"), *map(joined, fields))


def _query_tiles(queries: DataFrame, rows: int = 256) -> DataFrame:
    asked = queries.select("query_id", F.lit(0).alias("n"), term_hashes(F.col("query")).alias("terms")).filter(F.size("terms") > 0)
    return tiles.pack_terms(asked, "query_id", "n", "terms", rows, 1 << 14)


class _Reader:
    """One segment as the search sees it."""

    def __init__(self, row):
        self.ids, self.n_words = np.asarray(row.l_ids), np.frombuffer(row.l_n_words, np.int64)
        self.terms, sizes = np.frombuffer(row.l_terms, np.int64), np.frombuffer(row.l_sizes, np.int32)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        self.places, self.blocks = np.frombuffer(row.l_places, np.uint16), np.frombuffer(row.l_blocks, np.uint64)
        self.shortest = self.n_words[::BLOCK] + PRIOR

    def best(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Places and scores of the k best chunks, postings of the query's terms, and how many of them were scored."""
        at = np.searchsorted(self.terms, asked)
        inside = at < len(self.terms)
        at = at[inside][self.terms[at[inside]] == asked[inside]]  # the place of an absent term is that of the next one
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        postings = np.concatenate([self.places[self.starts[t]: self.ends[t]] for t in at])
        occurs = np.unpackbits(self.blocks[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little").sum(axis=0)[: len(self.shortest)]
        bound = occurs / self.shortest
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[: -(-k // BLOCK) + 1]] = True
        scores = self._scores(postings, first)
        if np.count_nonzero(scores) >= k:
            rest = bound >= np.partition(scores, len(scores) - k)[len(scores) - k]  # equal scores may win by id
        else:
            rest = occurs > 0
        if (rest & ~first).any():
            scores = self._scores(postings, rest | first)
        found = np.flatnonzero(scores > 0)
        chosen = found[tiles.best_of(scores[found], self.ids[found], k)]
        return chosen, scores[chosen], len(postings), int((rest | first)[postings // BLOCK].sum())

    def _scores(self, postings: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        hits = np.bincount(postings[blocks[postings // BLOCK]], minlength=len(self.n_words))
        return hits / (self.n_words + PRIOR)


def search(queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """Best k chunks per query by different query terms present / (words + 50); ties by chunk id, positive scores only.

    queries: query_id, query. segments: ``index_rows`` with one bucket, or ``read_index``. Each segment meets each tile of
    queries; k rows a query leave it, with the number of postings read and scored.
    """
    id_type, query_type = dict(segments.dtypes)["ids"][6:-1], dict(queries.dtypes)["query_id"]
    pairs = tiles.tile_pairs(segments, _query_tiles(queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                segment, asked = _Reader(row), np.frombuffer(row.r_terms, np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row.r_sizes, np.int64))])
                found = [segment.best(asked[a:b], k) for a, b in zip(bounds[:-1], bounds[1:])]
                counts = [len(f[0]) for f in found]
                yield pd.DataFrame({
                    "query_id": np.repeat(np.asarray(row.r_ids), counts), "chunk_id": segment.ids[np.concatenate([f[0] for f in found])],
                    "score": np.concatenate([f[1] for f in found]), "read": np.repeat([f[2] for f in found], counts), "scored": np.repeat([f[3] for f in found], counts)})

    best = pairs.mapInPandas(run, f"query_id {query_type}, chunk_id {id_type}, score double, read long, scored long")
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
