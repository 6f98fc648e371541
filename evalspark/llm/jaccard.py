"""Similarity join on word n-grams by signature trees.

A document's set holds the hashes of its distinct ``n``-word shingles. Two documents link when their sets' Jaccard
similarity is at least ``percent`` hundredths. Documents with equal sets form a class and are compared once.

Finding candidates. Linked sets share a token among the first ``size - ceil(size * percent / 100) + 1`` in any common
order, so classes are brought together by those tokens: the top of the tree is a shuffle, not a traversal. The order
puts the corpus' frequent tokens last (a bounded table, found by counting all documents), so passages that many
documents share bring few of them together. Blocks with the same members count once. The classes of a token that more
than ``tile`` documents hold are dealt over tiles, and every pair of tiles is a block of its own.

Pruning. Every class carries a bitmap of its tokens, about a bit for each, and its size. In a block, classes of
neighbouring sizes are packed into a tree whose nodes hold OR-combined bitmaps and size ranges, and the tree is
traversed against itself: a pair of nodes is given up when its sizes cannot meet or the largest overlap that the
bitmaps allow is too small. What survives connects classes into clusters; a block emits a spanning forest, not pairs.

Checking. The texts of each cluster are read again, once per class; a tree with eight bits a token and then the sets
themselves decide, skipping pairs that are connected already. A cluster beyond ``tile`` classes, or some millions of
tokens, is cut into tiles that meet pairwise in tasks of their own. The result is exact but for collisions of 64-bit hashes.

Edge cases. Fewer than ``n`` words make one shingle; no words or a null text make an empty set, linked with nothing.
A component is named by its smallest doc_id; rows with a null doc_id link like others and are named by their partners.
Repeated rows and ids keep a row each. Columns other than doc_id and text are ignored by the join; ``keep_one`` keeps
all columns.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

N, PERCENT = 4, 85
MAX_FREQUENT = 1 << 17
FREQUENT_FROM = 32
TOKENS_PER_BUCKET = 400_000
TOKENS_AT_ONCE = 2_000_000
TILE = 4096
LEAF, FANOUT = 32, 8
BLOCK_BYTES = 1 << 17
U = np.uint64

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


# ---- tokens ----

@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of an odd number and of its inverse modulo 2**64."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    base = 0x9E3779B97F4A7C15
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every run without white space, A to Z as a to z; memory is bounded by the block."""
    data, at, starts, hashes = data.lower(), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not SPACES[data[end]]:
            end = min(len(data), end + 1) if end - at < 2 * BLOCK_BYTES else _next_space(data, end)
        part = np.frombuffer(data, np.uint8, end - at, at)
        size = 1 << max(12, len(part).bit_length())
        values, up, down = _powers(size)
        space = SPACES[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[part] * up[: len(part)], dtype=np.uint64)))
        h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        starts.append(first + at)
        hashes.append(mixed(h))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def _next_space(data: bytes, at: int) -> int:
    ends = [k for c in b" \t\n\x0b\x0c\r" if (k := data.find(bytes([c]), at)) >= 0]
    return min(ends, default=len(data))


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mixed(h * U(0x9FB21C651E98DF25) + p)
    return h


def token_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(raw)
    begin = 0
    while begin < len(raw):  # groups of texts of about a block
        end, size = begin, 0
        while end < len(raw) and (end == begin or size + len(raw[end]) <= BLOCK_BYTES):
            size += len(raw[end]) + 1
            end += 1
        starts, h = word_hashes(b"\n".join(raw[begin:end]))
        limits = np.cumsum([0] + [len(r) + 1 for r in raw[begin:end]])
        bounds = np.searchsorted(starts, limits)
        shingles = _fold([h[k : len(h) - n + 1 + k] for k in range(n)]) if len(h) >= n else h[:0]
        for i in range(begin, end):
            a, b = bounds[i - begin], bounds[i - begin + 1]
            if b - a >= n:
                out[i] = np.unique(shingles[a : b - n + 1])
            elif b > a:
                out[i] = _fold([h[k : k + 1] for k in range(a, b)])
        begin = end
    return out


def class_of(tokens: np.ndarray) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix_of(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens of which linked sets share one: frequent ones last, else by hash."""
    size = len(tokens)
    if not size:
        return tokens
    count = size - (percent * size + 99) // 100 + 1
    if not len(frequent):
        return tokens[:count]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    late = frequent[at] == tokens
    return np.concatenate((tokens[~late], tokens[late]))[:count]


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    words = np.zeros(bits // 64, np.uint64)
    at = tokens & U(bits - 1)
    np.bitwise_or.at(words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return words


def width_for(size: int, per_token: int = 1) -> int:
    return max(64, 1 << (max(1, size * per_token) - 1).bit_length())


def narrowed(words: np.ndarray, bits: int) -> np.ndarray:
    """The same tokens' bitmap of fewer bits."""
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


# ---- trees ----

class Forest:
    """Union-find over positions; the smaller position becomes the root."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[self.up[at]]
            if (r == self.up[at]).all():
                return r
            self.up[at] = r


class SignatureTree:
    """Items in size order under nodes with OR-combined bitmaps, size ranges and the most tokens that share a bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, percent: int = PERCENT):
        self.sizes, self.bits, self.percent = sizes.astype(np.int64), bits, percent
        self.shared = self.sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        cut = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut), np.maximum.reduceat(self.shared, cut))
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)

    def may_meet(self, depth: int, i: int, j: int) -> bool:
        bits, low, high, shared = self.levels[depth]
        if 100 * high[min(i, j)] < self.percent * low[max(i, j)]:  # in size order, i is the smaller side
            return False
        overlap = int(np.bitwise_count(bits[i] & bits[j]).sum()) + int(min(shared[i], shared[j]))
        return (100 + self.percent) * overlap >= self.percent * int(low[i] + low[j])

    def leaf_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs of two leaves that the items' own bitmaps allow."""
        p, q = np.arange(a * LEAF, min((a + 1) * LEAF, len(self.sizes))), np.arange(b * LEAF, min((b + 1) * LEAF, len(self.sizes)))
        both = np.bitwise_count(self.bits[p][:, None, :] & self.bits[q][None, :, :]).sum(2, dtype=np.int64)
        overlap = both + np.minimum(self.shared[p][:, None], self.shared[q][None, :])
        fits = (100 + self.percent) * overlap >= self.percent * (self.sizes[p][:, None] + self.sizes[q][None, :])
        fits &= 100 * self.sizes[p][:, None] >= self.percent * self.sizes[q][None, :]
        if a == b:
            fits &= p[:, None] < q[None, :]
        i, j = np.nonzero(fits)
        return p[i], q[j]

    def join_self(self, forest: Forest, linked=None) -> None:
        """Connect every pair that survives (and for which ``linked`` holds); connected pairs are not looked at again."""
        stack = [(len(self.levels) - 1, i, j) for i in range(len(self.levels[-1][1])) for j in range(i, len(self.levels[-1][1]))]
        while stack:
            depth, i, j = stack.pop()
            if i != j and not self.may_meet(depth, i, j):
                continue
            if depth:
                n = len(self.levels[depth - 1][1])
                left, right = range(i * FANOUT, min(n, (i + 1) * FANOUT)), range(j * FANOUT, min(n, (j + 1) * FANOUT))
                stack += [(depth - 1, x, y) for x in left for y in right if x <= y]
                continue
            at = np.unique(np.concatenate((np.arange(i * LEAF, min((i + 1) * LEAF, len(self.sizes))), np.arange(j * LEAF, min((j + 1) * LEAF, len(self.sizes))))))
            if len(at) < 2 or (forest.roots(at) == forest.up[at[0]]).all():
                continue
            p, q = self.leaf_pairs(i, j)
            open_ = forest.roots(p) != forest.roots(q) if len(p) else np.zeros(0, bool)
            for x, y in zip(p[open_].tolist(), q[open_].tolist()):
                if forest.root(x) != forest.root(y) and (linked is None or linked(x, y)):
                    forest.join(x, y)


def connect(sizes: np.ndarray, maps: list[np.ndarray], percent: int = PERCENT, linked=None) -> np.ndarray:
    """Root position of every item, after joining each band of neighbouring sizes to itself.

    Bands reach over sizes that can link with their smallest quarter at most, so that bitmaps are narrowed little.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    forest = Forest(len(sizes))
    step = math.log(100 / percent)
    band = np.floor(np.log(np.maximum(ordered, 1)) / step + 1e-9).astype(np.int64)
    present = np.unique(band)
    for k in present.tolist():
        a, b = np.searchsorted(band, k), np.searchsorted(band, k + 2)  # the band and the one above it
        if k - 1 in present and b == np.searchsorted(band, k + 1):
            continue  # nothing above; the band below has joined this one to itself
        if b - a < 2:
            continue
        at = order[a:b]
        bits = min(64 * len(maps[i]) for i in at)
        tree = SignatureTree(sizes[at], np.stack([narrowed(maps[i], bits) for i in at]), percent)
        part = Forest(b - a)
        part.up = _compact(forest.roots(at))
        tree.join_self(part, None if linked is None else (lambda x, y, at=at: linked(int(at[x]), int(at[y]))))
        for x, r in enumerate(part.roots(np.arange(b - a)).tolist()):
            forest.join(int(at[x]), int(at[r]))
    return forest.roots(np.arange(len(sizes)))


def _compact(roots: np.ndarray) -> np.ndarray:
    """Roots as positions within the part: the first item with the same root."""
    _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
    return first[inverse]


def linked_sets(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (100 + percent) * both >= percent * (len(a) + len(b))


# ---- Spark ----

def _gathered(lists, limit: int):
    """Lists of arrays, joined until they hold about ``limit`` elements."""
    held, size = [], 0
    for arrays in lists:
        held += arrays
        size += sum(map(len, arrays))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def frequent_tokens(docs: DataFrame, n: int = N, limit: int = MAX_FREQUENT, least: int = FREQUENT_FROM) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` tokens, those in most documents, and how many. Tasks send what they see three times in some millions of tokens.

    Any choice leaves the join exact; it only decides which tokens come last in the order.
    """

    def count(batches):
        for sets in _gathered((token_sets(b.column("text").to_pylist(), n) for b in batches), TOKENS_AT_ONCE):
            tokens, sizes = np.unique(np.concatenate(sets), return_counts=True)
            often = sizes >= 3
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(sizes[often].astype(np.int64))], names=["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    tokens, sizes = best.column("token").to_numpy().astype(np.int64).view(np.uint64), best.column("n").to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], sizes[order]


def tiles_of(tokens: np.ndarray, frequent: np.ndarray, sizes: np.ndarray, tile: int) -> np.ndarray:
    """Over how many tiles the classes of each token are dealt: a power of two, so that like tokens have like blocks."""
    tiles = np.ones(len(tokens), np.int64)
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hot = (frequent[at] == tokens) & (sizes[at] > tile)
        tiles[hot] = 1 << np.ceil(np.log2(sizes[at][hot] / tile)).astype(np.int64)
    return tiles


def dealt(tokens: np.ndarray, cls: np.ndarray, tiles: np.ndarray):
    """(token, cls) with a row for every pair of tiles that a class takes part in, the token renamed by the pair; in bounded parts."""
    part = np.cumsum(tiles) // TOKENS_AT_ONCE
    for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(tokens)])))):
        t = tiles[a:b]
        if (t == 1).all():
            yield tokens[a:b], cls[a:b]
            continue
        own = np.repeat((mixed(cls[a:b].view(np.uint64)) % t.astype(np.uint64)).astype(np.int64), t)
        other = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
        every = np.repeat(tokens[a:b], t)
        yield np.where(np.repeat(t, t) > 1, mixed(every + mixed(pair + U(1))), every), np.repeat(cls[a:b], t)


def profiles(docs: DataFrame, frequent, n: int = N, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Per document: key (id and text hash), class, size, bitmap, packed prefix tokens and how many rows of blocks they make."""
    names = ["doc_id", "doc_key", "text_key", "cls", "size", "bits", "prefix", "spread"]

    def profile(batches):
        late, held = frequent.value
        for batch in batches:
            sets = token_sets(batch.column("text").to_pylist(), n)
            prefixes = [prefix_of(s, late, percent) for s in sets]
            columns = [
                pa.array([class_of(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s, width_for(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                pa.array([p.tobytes() for p in prefixes], pa.binary()), pa.array([int(tiles_of(p, late, held, tile).sum()) for p in prefixes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *columns], names=names)

    return keyed(docs).mapInArrow(profile, "doc_id bigint, doc_key bigint, text_key bigint, cls bigint, size bigint, bits binary, prefix binary, spread bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_key"),
        F.xxhash64("text").alias("text_key"), "text")


def _rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    """All prefix tokens of a batch, and the class of each."""
    prefixes = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
    tokens = np.concatenate(prefixes or [np.zeros(0, np.int64)])
    return [tokens, np.repeat(batch.column("cls").to_numpy(), [len(p) for p in prefixes])]


def blocks(rows: DataFrame, buckets: int, frequent, tile: int = TILE) -> DataFrame:
    """(block, cls): the distinct member lists of tokens that two classes or more have in their prefixes.

    A hot token's classes are dealt over pairs of tiles before they travel, so no list is much longer than two tiles.
    Tokens travel packed, a bucket of them in a row per batch, twelve to sixteen bytes each and no row overhead.
    """

    def pack(batches):
        late, held = frequent.value
        for rows in _gathered((_rows(b) for b in batches), TOKENS_AT_ONCE):
            found, holders = np.concatenate(rows[0::2]).view(np.uint64), np.concatenate(rows[1::2])
            if not len(found):
                continue
            order = np.lexsort((holders, found))
            found, holders = found[order], holders[order]
            fresh = np.concatenate(([True], (found[1:] != found[:-1]) | (holders[1:] != holders[:-1])))
            found, holders = found[fresh], holders[fresh]
            for tokens, cls in dealt(found, holders, tiles_of(found, late, held, tile)):
                bucket = (mixed(tokens) % U(buckets)).astype(np.int64)
                order = np.lexsort((cls, tokens, bucket))
                bucket, tokens, cls = bucket[order], tokens[order], cls[order]
                cut = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cut[:-1]], pa.int64()), pa.array([tokens[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([cls[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "tokens", "cls"])

    def meet(group: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()])
        cls = np.concatenate([np.frombuffer(c, np.int64) for c in group.column("cls").to_pylist()])
        order = np.lexsort((cls, tokens))
        tokens, cls = tokens[order], cls[order]
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])))
        tokens, cls = tokens[fresh], cls[fresh]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sizes = np.diff(np.concatenate((first, [len(tokens)])))
        name = np.add.reduceat(mixed(cls.view(np.uint64)), first) + sizes.astype(np.uint64)  # of the member list, in any order
        keep = sizes > 1
        _, chosen = np.unique(name[keep], return_index=True)
        first, sizes, name = first[keep][chosen], sizes[keep][chosen], name[keep][chosen]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(first) else np.zeros(0, np.int64)
        return pa.table({"block": np.repeat(mixed(name).view(np.int64), sizes), "cls": cls[at]})

    packed = rows.select("cls", "prefix").mapInArrow(pack, "bucket bigint, tokens binary, cls binary")
    return packed.groupBy("bucket").applyInArrow(meet, "block bigint, cls bigint").distinct()


def _groups(batches, key: str):
    """Whole groups of rows with equal key, from batches in key order; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edge_batches(found):
    left, right = [], []
    for cls, roots in found:
        apart = roots != np.arange(len(roots))
        left.append(cls[apart])
        right.append(cls[roots[apart]])
        if sum(map(len, left)) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
            left, right = [], []
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def prune_blocks(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (block, cls, size, bits) in block order -> spanning edges (a, b) of the pairs that the bitmaps allow."""

    def prune(batches):
        def found():
            for group in _groups(batches, "block"):
                sizes = group.column("size").to_numpy()
                maps = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
                yield group.column("cls").to_numpy(), connect(sizes, maps, percent)

        yield from _edge_batches(found())

    return members.mapInArrow(prune, "a bigint, b bigint").distinct()


def check_clusters(rows: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """rows (task, cls, text) in task order -> spanning edges (a, b) of the links between different sets."""

    def check(batches):
        def found():
            for group in _groups(batches, "task"):
                named: dict[int, np.ndarray] = {}
                texts, wanted = group.column("text").to_pylist(), group.column("cls").to_numpy()
                for tokens, cls in zip(token_sets(texts, n), wanted.tolist()):
                    if len(tokens) and class_of(tokens) == cls:
                        named[cls] = tokens
                sets = list(named.values())
                if len(sets) < 2:
                    continue
                sizes = np.array([len(s) for s in sets])
                maps = [bitmap(s, width_for(len(s), 8)) for s in sets]
                yield np.array(list(named), np.int64), connect(sizes, maps, percent, lambda i, j: linked_sets(sets[i], sets[j], percent))

        yield from _edge_batches(found())

    return rows.mapInArrow(check, "a bigint, b bigint").distinct()


def _tiled(clusters: DataFrame, tile: int) -> DataFrame:
    """(id, component, size, ...) -> (id, task, ...): small clusters as they are, of large ones every pair of tiles in a task of its own."""
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("size") / TOKENS_AT_ONCE)).cast("int")
    sized = clusters.groupBy("component").agg(tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.xxhash64("component", F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    placed = clusters.join(sized, "component").withColumn("own", own)
    tasks = F.explode(F.when(F.col("tiles") == 1, F.array("component")).otherwise(others))
    return placed.withColumn("task", tasks).drop("component", "size", "tiles", "own")


def similarity_classes(docs: DataFrame, n: int = N, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, n))
    every = stored(profiles(docs.select("doc_id", "text"), frequent, n, percent, tile), "profiles")
    sets = every.where("size > 0")
    classes = stored(sets.groupBy("cls").agg(
        F.min(F.struct("doc_key", "text_key")).alias("first"), F.min("doc_id").alias("least"), F.max("size").alias("size"), F.max("bits").alias("bits")), "classes")

    tokens = sets.agg(F.coalesce(F.sum("spread"), F.lit(0))).first()[0]
    together = stored(blocks(sets, max(width, int(tokens // TOKENS_PER_BUCKET)), frequent, tile), "blocks")
    members = together.join(classes.select("cls", "size", "bits"), "cls").repartition("block").sortWithinPartitions("block")
    clusters = components(prune_blocks(members, percent))

    wanted = _tiled(stored(clusters.join(classes.select(F.col("cls").alias("id"), "size", "first.*"), "id"), "clusters"), tile)
    # the wanted rows grow with the corpus, so this join is a shuffle of both sides at every size
    texts = keyed(docs).join(stored(wanted, "wanted").hint("merge"), ["doc_key", "text_key"]).select("task", F.col("id").alias("cls"), "text")
    links = check_clusters(texts.repartition("task").sortWithinPartitions("task"), n, percent)

    linked = components(links)
    least = linked.join(classes.select(F.col("cls").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(linked.join(least, "component").select(F.col("id").alias("cls"), "component_id"), "named")
    alone = classes.select("cls", "least").join(named, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    found = every.join(alone, (every["cls"] == alone["cls"]) & (every["size"] > 0), "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns; of rows that repeat id and text one stays.

    Rows that share an id but not the text all stay if one of them does: none stands for another. Rows with a null doc_id
    cannot be told apart by it and all stay.
    """
    heads = similarity_classes(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stored(heads, "heads"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
