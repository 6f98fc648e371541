"""Blocked all-pairs work: rows are packed into bounded tiles and tile pairs are computed with numpy.

A tile is a slice of one Arrow batch, so packing needs no shuffle and no tile grows with a key.
Tile pairs come from an equi-join on a block number, and only sums, counts or top-k rows leave a task - never the pairs themselves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import mixed
from ..session import durable, shuffle_width

ROWS = 1024


def pack_vectors(df: DataFrame, id_col: str, vec_col: str, rows: int = ROWS) -> DataFrame:
    """Tiles of ids, n and data (row-major float64 bytes)."""
    id_type = dict(df.dtypes)[id_col]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start : start + rows]
                data = np.stack(part["vec"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "n": [len(part)], "data": [data.tobytes()]})

    chosen = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    schema = f"ids array<{id_type}>, n int, data binary"
    return chosen.mapInPandas(pack, schema).withColumn("tile", F.monotonically_increasing_id())


BROADCAST_BYTES = 64 << 20


def tile_bytes(tiles: DataFrame) -> int:
    """Bytes of all columns: binaries as they are, lists of ids by their text."""
    sizes = [F.octet_length(name) if kind == "binary" else F.octet_length(F.to_json(F.struct(name))) for name, kind in tiles.dtypes if kind == "binary" or kind.startswith("array")]
    return tiles.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("long")), F.lit(0))).first()[0]


def tile_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left tile next to every right tile, columns prefixed l_ and r_.

    The right side is measured: up to 64 MB it is broadcast and the left side never moves. Beyond that the tiles meet in a
    square of blocks, about as many as there are shuffle partitions: a left tile goes to every block of its row, a right
    one to every block of its column, so each side is copied about as often as the root of that number.
    """
    small = tile_bytes(right) <= BROADCAST_BYTES
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    if small:
        one = lambda tile: F.pmod(F.xxhash64(tile), F.lit(1))
        return a.withColumn("_block", one("l_tile")).join(F.broadcast(b.withColumn("_block", one("r_tile"))), "_block").drop("_block")
    side = math.ceil(shuffle_width(left.sparkSession) ** 0.5)
    every = F.sequence(F.lit(0), F.lit(side - 1))
    own = lambda tile: F.pmod(F.xxhash64(tile), F.lit(side)).cast("int")
    rows = a.withColumn("_own", own("l_tile")).withColumn("_block", F.explode(F.transform(every, lambda x: F.col("_own") * side + x)))
    columns = b.withColumn("_own", own("r_tile")).withColumn("_block", F.explode(F.transform(every, lambda x: x * side + F.col("_own"))))
    return rows.drop("_own").join(columns.drop("_own"), "_block").drop("_block")


PART_BYTES = 64 << 20


def self_pairs(tiles: DataFrame) -> DataFrame:
    """Unordered tile pairs, a tile with itself included. Tiles are made durable so both sides agree.

    Beyond 64 MB each task reads two parts of the checkpoint, of which it holds one (64 MB or a partition). Nothing is
    shuffled: tiles lie on disk once, however many tasks meet them. There are about as many tasks as shuffle partitions.
    """
    fixed = durable(tiles)
    size = tile_bytes(fixed)
    if size <= BROADCAST_BYTES:
        pairs = tile_pairs(fixed, fixed)
    else:
        parts = fixed.coalesce(max(math.ceil(shuffle_width(fixed.sparkSession) ** 0.5), math.ceil(size / PART_BYTES)))
        left, right = (parts.select(*[F.col(c).alias(f"{side}_{c}") for c in parts.columns]) for side in "lr")
        pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return pairs.filter(F.col("l_tile") <= F.col("r_tile"))


def matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(n, -1)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id. Everything tied with the k-th score is ordered exactly."""
    if len(scores) > k:
        floor = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_scores(pairs: DataFrame, k: int, score: Callable[[pd.Series], np.ndarray], id_type: str, query_type: str,
               digits: int | None = 9) -> DataFrame:
    """Best k of each tile pair per query: (query_id, item, score). Left tiles are items, right are queries.

    ``score`` gets one row of the pair table and returns the (queries x items) score matrix; items
    scored -inf are left out. Float scores are rounded so that equal vectors tie on every machine.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                items = np.asarray(row.l_ids)
                s = score(row) if digits is None else np.round(score(row), digits)
                for j, barred in enumerate(row.r_exclude):
                    if len(barred):
                        s[j] = np.where(np.isin(items, np.asarray(barred)), -np.inf, s[j])
                near = s > -np.inf
                if len(items) > k:  # everything tied with the k-th score is ordered exactly
                    near &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                q, at = np.nonzero(near)
                order = np.lexsort((items[at], -s[q, at], q))
                q, at = q[order], at[order]
                kept = (np.arange(len(q)) - np.searchsorted(q, q) < k) & np.isfinite(s[q, at])
                q, at = q[kept], at[kept]
                yield pd.DataFrame({"query_id": np.asarray(row.r_ids)[q], "item": items[at], "score": s[q, at]})

    return pairs.mapInPandas(run, f"query_id {query_type}, item {id_type}, score double")


def inner_products(row) -> np.ndarray:
    return matrix(row.r_data, row.r_n) @ matrix(row.l_data, row.l_n).T


# --- sets of grams --------------------------------------------------------------------------------

SETS, GRAMS = 4096, 1 << 22  # of a tile, before its grams are cut
DEALT = "tile long, bucket int, ids binary, weights binary, totals binary, counts binary, grams binary"


def _tile_in_buckets(tile: int, held: list, buckets: int) -> pa.RecordBatch:
    """One row that names the sets of a tile, and one for each bucket with the grams that fall into it, set by set."""
    ids, weights = (np.array([row[i] for row in held], np.int64) for i in (0, 1))
    sizes = np.array([len(row[2]) for row in held], np.int64)
    flat = np.concatenate([row[2] for row in held])
    bucket = (flat % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # small numbers sort faster
    order = np.argsort(bucket, kind="stable")
    owner, rest = np.repeat(np.arange(len(held)), sizes)[order], flat[order] // np.uint64(buckets)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(tile, tile % buckets, ids.tobytes(), weights.tobytes(), sizes.tobytes(), None, None)]
    rows += [(tile, b, None, None, None, zlib.compress(np.bincount(owner[lo:hi], minlength=len(held)).astype(np.int32).tobytes(), 1),
              rest[lo:hi].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()) for b, lo, hi in zip(range(buckets), edges, edges[1:]) if hi > lo]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["tile", "bucket", "ids", "weights", "totals", "counts", "grams"])


def _cut_bucket(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The rows of a bucket with the grams that occur twice; a set holds a gram once, so another set holds it too.

    A gram is replaced by a hash of the sets that hold it: grams of the same sets become one, which ``_tile_again`` counts.
    """
    names, rows = pdf[pdf["ids"].notna()], pdf[pdf["ids"].isna()]
    if not len(rows):
        return names
    lengths = np.array([len(g) // 7 for g in rows["grams"]])
    wide = np.zeros((int(lengths.sum()), 8), np.uint8)
    wide[:, :7] = np.frombuffer(b"".join(rows["grams"]), np.uint8).reshape(-1, 7)
    grams = wide.view(np.uint64).ravel()
    counts = [np.frombuffer(zlib.decompress(packed), np.int32) for packed in rows["counts"]]
    holder = np.concatenate([mixed(mixed(np.arange(len(n), dtype=np.uint64) + np.uint64(tile + 1) * np.uint64(0x9E3779B97F4A7C15))).repeat(n)
                             for tile, n in zip(rows["tile"], counts)])
    order = np.argsort(grams)
    first = np.flatnonzero(np.diff(grams[order], prepend=~grams[order[:1]]))
    held = np.diff(first, append=len(grams))
    holders = mixed(np.add.reduceat(holder[order], first) + held.astype(np.uint64))
    twice, lists = np.zeros(len(grams), bool), np.zeros(len(grams), np.uint64)
    twice[order], lists[order] = np.repeat(held > 1, held), np.repeat(holders, held)
    left, kept, at = [], [], 0
    for n, length in zip(counts, lengths):
        mine = twice[at : at + length]
        left.append(zlib.compress(np.bincount(np.repeat(np.arange(len(n)), n)[mine], minlength=len(n)).astype(np.int32).tobytes(), 1))
        kept.append(lists[at : at + length][mine].tobytes())
        at += length
    return pd.concat([names, rows.assign(counts=left, grams=kept)[[len(k) > 0 for k in kept]]])


def _tile_again(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile from its rows; sets without a shared gram go, they have no pair but those of their ``copies``."""
    name, rows = pdf[pdf["ids"].notna()].iloc[0], pdf[pdf["ids"].isna()]
    ids, weights, totals = (np.frombuffer(name[c], np.int64) for c in ("ids", "weights", "totals"))
    owner = np.concatenate([np.zeros(0, np.int64)] + [np.repeat(np.arange(len(ids)), np.frombuffer(zlib.decompress(c), np.int32)) for c in rows["counts"]])
    lists = np.frombuffer(b"".join(rows["grams"]), np.int64)
    order = np.lexsort((lists, owner))
    owner, lists = owner[order], lists[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(lists) != 0)])[: len(lists)])
    sizes = np.bincount(owner[first], minlength=len(ids))
    kept = sizes > 0
    times, lists = np.diff(first, append=len(lists)), lists[first]
    return pd.DataFrame({
        "ids": [ids[kept]], "weights": [weights[kept]], "totals": [totals[kept].tobytes()], "sizes": [sizes[kept].tobytes()], "grams": [lists.tobytes()],
        "ranks": [np.unique(lists, return_inverse=True)[1].astype(np.int32).tobytes()], "times": [times.astype(np.int32).tobytes()],
        "copies": [float((weights * (weights - 1) // 2).sum())], "tile": [name["tile"]]})


def shared_tiles(sets: DataFrame, grams: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """Sets (id, weight, text) as tiles of up to SETS, cut to the grams that another set holds too: their ids, weights,
    totals (sizes of the whole sets), sizes and flat grams with their ranks in the tile. Grams that the same sets hold are one,
    with its ``times``. ``copies`` are the pairs of texts of one set, of all sets that were dealt to the tile.

    ``grams`` gives the distinct grams of texts. They travel once, 7 bytes each, to the bucket of their hash, where those of
    one set only go; the rest return to their tile. Neither a row nor a set number goes along with each gram. There are four
    buckets to a shuffle partition.
    """
    buckets = max(256, 4 * shuffle_width(sets.sparkSession))  # 256 at least: then 7 bytes hold a hash divided by it

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, load = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("weight").to_pylist(), grams(batch.column("text"))):
                if held and (len(held) == SETS or load + len(row[2]) > GRAMS):
                    yield _tile_in_buckets(tile, held, buckets)
                    tile, held, load = tile + 1, [], 0
                held.append(row)
                load += len(row[2])
        if held:
            yield _tile_in_buckets(tile, held, buckets)

    dealt = sets.select("id", "weight", "text").mapInArrow(deal, DEALT)
    cut = dealt.groupBy("bucket").applyInPandas(lambda pdf: _cut_bucket(pdf, buckets), DEALT)
    return cut.groupBy("tile").applyInPandas(_tile_again, "ids array<long>, weights array<long>, totals binary, sizes binary, grams binary, ranks binary, times binary, copies double, tile long")


MEETINGS = 1 << 21  # of grams, held at once
CELLS = 1 << 18  # pairs of sets counted at once: they and their meetings stay in a core's cache


def _ranked(grams: bytes, ranks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a tile in order, and the place of each of its grams among them."""
    flat = np.frombuffer(grams, np.int64)
    if ranks is None:
        return np.unique(flat, return_inverse=True)
    places = np.frombuffer(ranks, np.int32).astype(np.int64)
    distinct = np.empty(int(places.max()) + 1 if len(places) else 0, np.int64)
    distinct[places] = flat
    return distinct, places


class Postings:
    """The grams of a tile in order, with the sets that hold each, and room to count."""

    def __init__(self, sizes: bytes, grams: bytes, ranks: bytes | None, tile: int):
        self.tile, self.sets = tile, len(sizes) // 8
        self.grams, places = _ranked(grams, ranks)
        self.owners = np.repeat(np.arange(self.sets), np.frombuffer(sizes, np.int64))[np.argsort(places)]
        self.held = np.bincount(places, minlength=len(self.grams))
        self.first = np.cumsum(self.held) - self.held
        self.bits = max(self.sets - 1, 0).bit_length()
        self.wide = max(1, CELLS >> self.bits)  # right sets of a slice
        self.counts, self.seen = (np.zeros(self.wide << self.bits, np.int32) for _ in range(2))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting and number of postings of each gram; grams in order are found fastest."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return self.first[at], np.where(self.grams[at] == grams, self.held[at], 0)


def shared_pairs(row, postings: Postings | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one tile pair that share a gram: left and right place, shared grams, size of the union.

    The left tile's grams are postings (made here unless given); each gram of the right tile meets those of its own only, as
    many times as its sets have such grams. The right sets are taken in slices of at most MEETINGS (a set with more is a slice
    of its own) and CELLS, so that a tile of near copies stays bounded. Cells that nothing meets are not looked at.
    """
    left = postings or Postings(row.l_sizes, row.l_grams, getattr(row, "l_ranks", None), row.l_tile)
    size_r = np.frombuffer(row.r_sizes, np.int64)
    distinct, places = _ranked(row.r_grams, getattr(row, "r_ranks", None))
    low, count = (found[places] for found in left.find(distinct))
    times = np.frombuffer(row.r_times, np.int32) if hasattr(row, "r_times") else np.ones(len(places), np.int32)
    owner_r = np.repeat(np.arange(len(size_r)), size_r)
    edges = np.concatenate([[0], np.cumsum(size_r)])  # of the right sets among their grams
    met = np.concatenate([[0], np.cumsum(count)])[edges]  # meetings before each right set
    total_l, total_r = np.frombuffer(row.l_totals, np.int64), np.frombuffer(row.r_totals, np.int64)
    first = 0
    while first < len(size_r):
        last = max(first + 1, min(first + left.wide, int(np.searchsorted(met, met[first] + MEETINGS, "right")) - 1))
        some = np.flatnonzero(count[edges[first] : edges[last]]) + edges[first]
        n = count[some]
        # positions of every met gram's postings, laid out one after the other
        nth = np.arange(n.sum())
        cell = left.owners[nth + np.repeat(low[some] - (np.cumsum(n) - n), n)]
        cell += np.repeat((owner_r[some] - first) << left.bits, n)
        np.add.at(left.counts, cell, np.repeat(times[some], n))
        left.seen[cell] = nth  # of the meetings of a pair one is seen
        pair = cell[left.seen[cell] == nth]
        shared = left.counts[pair].astype(np.int64)
        left.counts[pair] = 0
        at_l, at_r = pair & ((1 << left.bits) - 1), (pair >> left.bits) + first
        if row.l_tile == row.r_tile:
            upper = at_l < at_r
            at_l, at_r, shared = at_l[upper], at_r[upper], shared[upper]
        yield at_l, at_r, shared, total_l[at_l] + total_r[at_r] - shared
        first = last


def all_shared_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row of two tiles, its ``shared_pairs``); a left tile is sorted once for the right tiles that follow."""
    postings = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if postings is None or postings.tile != row.l_tile:
                postings = Postings(row.l_sizes, row.l_grams, row.l_ranks, row.l_tile)
            yield row, shared_pairs(row, postings)


def pack_queries(queries: DataFrame, exclude_col: str, rows: int = 256) -> DataFrame:
    """Query tiles: query_id as id, vector, excluded item ids."""
    query_type, item_type = dict(queries.dtypes)["query_id"], dict(queries.dtypes)[exclude_col]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start : start + rows]
                data = np.stack(part["vector"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({
                    "ids": [part["query_id"].to_numpy()], "n": [len(part)], "data": [data.tobytes()],
                    "exclude": [[list(x) for x in part["exclude"]]]})

    chosen = queries.select("query_id", "vector", F.col(exclude_col).alias("exclude"))
    schema = f"ids array<{query_type}>, n int, data binary, exclude array<{item_type}>"
    return chosen.mapInPandas(pack, schema).withColumn("tile", F.monotonically_increasing_id())


def pack_terms(df: DataFrame, id_col: str, weight: str, terms: str, rows: int, most_terms: int) -> DataFrame:
    """Tiles of ids, a number per row and its set of term hashes, closed by rows or by terms."""
    id_type = dict(df.dtypes)[id_col]

    def tile(part):
        sizes = np.array([len(x) for x in part["terms"]], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["terms"]])
        return pd.DataFrame({
            "ids": [part["id"].to_numpy()], "n": [len(part)], "weights": [part["weight"].to_numpy(np.int64).tobytes()],
            "sizes": [sizes.tobytes()], "terms": [flat.tobytes()], "exclude": [[[] for _ in range(len(part))]]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, load = 0, 0
            for i, x in enumerate(pdf["terms"]):
                if i > start and (i - start >= rows or load + len(x) > most_terms):
                    yield tile(pdf.iloc[start:i])
                    start, load = i, 0
                load += len(x)
            if start < len(pdf):
                yield tile(pdf.iloc[start:])

    chosen = df.select(F.col(id_col).alias("id"), F.col(weight).cast("long").alias("weight"), F.col(terms).alias("terms"))
    schema = f"ids array<{id_type}>, n int, weights binary, sizes binary, terms binary, exclude array<array<{id_type}>>"
    return chosen.mapInPandas(pack, schema).withColumn("tile", F.monotonically_increasing_id())


def shared_terms(row) -> np.ndarray:
    """(queries x items) counts of shared terms: two 0/1 matrices over the terms of the query tile."""
    size_q, size_i = np.frombuffer(row.r_sizes, np.int64), np.frombuffer(row.l_sizes, np.int64)
    vocab, spot_q = np.unique(np.frombuffer(row.r_terms, np.int64), return_inverse=True)
    asked = np.zeros((len(size_q), len(vocab)), dtype=np.float32)
    asked[np.repeat(np.arange(len(size_q)), size_q), spot_q] = 1.0
    terms = np.frombuffer(row.l_terms, np.int64)
    held = np.zeros((len(size_i), len(vocab)), dtype=np.float32)
    if len(vocab):
        spot_i = np.minimum(np.searchsorted(vocab, terms), len(vocab) - 1)
        known = vocab[spot_i] == terms
        held[np.repeat(np.arange(len(size_i)), size_i)[known], spot_i[known]] = 1.0
    return asked @ held.T
