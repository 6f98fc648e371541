"""Approximate nearest neighbours by stable projections under a kd-tree, verified until a chi-square test stops.

Largest inner products are turned into smallest distances: a vector gets one more component, sqrt(M^2 - |x|^2) with M
the largest norm, a query gets 0 there. All vectors are then projected to ``dims`` Gaussian directions. For a pair at
true distance r, the squared projected distance is r^2 times a chi-square variable with ``dims`` degrees of freedom. So
with d the distance of the worst neighbour held so far, whatever lies beyond d * sqrt(quantile(``confidence``)) in the
projection is nearer than d with probability 1 - ``confidence`` at most: there the search stops.

The index is a kd-tree in the projection. Its upper part is fitted on a bounded sample (``sample`` vectors) and cuts
space into cells; every vector is assigned to its cell. A query first searches the cell that holds it, which bounds d.
In a second step it is sent to the cells within the stopping radius, which is tested against their boxes. In a cell
the rows lie under a local kd-tree and are verified in the order of their projected distance, leaf by leaf, with d
shrinking as they come.

Equal vectors are one indexed vector with its ``k + 1`` smallest ids, since no search can return more of them, and
equal queries are searched once; so a vector that a third of all rows share is one row of the index. A cell that has
more than ``cell_limit`` distinct vectors is dealt over several tasks, each with a tree of its own.

Edge cases. Vectors that are null, zero or hold null or non-finite components take no part, as rows or as queries. So do
those whose length differs from that of most vectors. With fewer than k candidates all are returned. Ties go to the
smaller id. Rows with a null id take no part. Ids that repeat are separate rows with the same id; a query skips every
row of its own id. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DIMS, CONFIDENCE = 12, 0.95
SAMPLE, CELL_ROWS, CELL_LIMIT, MAX_CELLS = 20_000, 8_000, 20_000, 4_096
LEAF, BLOCK = 256, 512


def chi_square_quantile(p: float, dims: int) -> float:
    """Inverse of the chi-square distribution, by bisection on the series of its regularised gamma function."""

    def below(x: float) -> float:
        a, h = dims / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= h / k
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    low, high = 1e-9, 10.0 * dims + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points: leaves as slices of an order, each with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.cuts: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            part = points[self.order[a:b]]
            spread = np.ptp(part, 0) if b - a > leaf else None
            if spread is None or spread.max() <= 0:
                self.cuts.append((a, b))
                continue
            axis, mid = int(spread.argmax()), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.cuts])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.cuts])

    def reach(self, query: np.ndarray) -> np.ndarray:
        """Squared projected distance from a query to every leaf's box."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0.0)
        return (gap * gap).sum(1)


class Cells:
    """The upper tree: cuts fitted on a sample; every point of space belongs to one cell."""

    def __init__(self, sample: np.ndarray, count: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; children below 0 are cells
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        dims = sample.shape[1]
        self._grow(sample, count, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])

    def _grow(self, part: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = np.ptp(part, 0) if len(part) > 1 else np.zeros(1)
        if count <= 1 or spread.max() <= 0:
            self.boxes.append((low, high))
            return -len(self.boxes)
        axis = int(spread.argmax())
        cut = float(np.median(part[:, axis]))
        left = part[:, axis] < cut
        if not left.any():
            cut = float(np.nextafter(cut, np.inf))
            left = part[:, axis] < cut
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        self.nodes[at] = (axis, cut, self._grow(part[left], count // 2, low, below), self._grow(part[~left], count - count // 2, above, high))
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0 if self.nodes else -1, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, cut, left, right = self.nodes[node]
                side = points[rows, axis] < cut
                stack += [(left, rows[side]), (right, rows[~side])]
        return out

    def within(self, query: np.ndarray, radius2: float) -> np.ndarray:
        """Cells whose boxes come within a squared distance of the query."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0.0)
        return np.flatnonzero((gap * gap).sum(1) <= radius2)


class Projection:
    """Query and data mappings: the added component and the Gaussian directions."""

    def __init__(self, length: int, norm: float, dims: int = DIMS, seed: int = 11):
        self.directions = np.random.default_rng(seed).standard_normal((length + 1, dims))
        self.norm2 = norm * norm

    def data(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0.0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to the norm of the data, which changes no order and makes distances small."""
        scale = math.sqrt(self.norm2) / np.sqrt(np.einsum("ij,ij->i", q, q))
        return (q * scale[:, None]) @ self.directions[:-1]

    def distance2(self, q_norm, product: np.ndarray) -> np.ndarray:
        """Squared distance of scaled query and lengthened vectors, from the inner products of the originals."""
        return np.maximum(2 * self.norm2 - 2 * product * math.sqrt(self.norm2) / q_norm, 0.0)


class Cell:
    """The vectors of one cell under a kd-tree of their projections."""

    def __init__(self, p: Projection, vectors: np.ndarray, ids: list[list[int]]):
        self.p, self.vectors, self.ids = p, vectors, ids
        self.smallest = np.array([x[0] for x in ids] + [np.iinfo(np.int64).max], np.int64)  # ids ascend; the last stands for no row
        self.points = p.data(vectors)
        self.tree = Tree(self.points)

    def search(self, queries: np.ndarray, k: int, stop: float, bound2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query number and row of the best rows for a block of queries; ``bound2`` is each one's worst useful distance.

        Every query visits the leaves in the order of their distance from it. The chi-square test ends its search
        before the first leaf that fails, and skips rows of a leaf that fail by themselves. Queries that visit the
        same leaf in the same round are verified by one matrix product.
        """
        keep = k
        digits = 12 - int(np.ceil(np.log10(max(np.sqrt(self.p.norm2 * (queries**2).sum(axis=1).max()), 1e-300))))  # equal products that differ in rounding are equal
        projected = self.p.query(queries)
        reach = np.stack([self.tree.reach(q) for q in projected])
        order = np.argsort(reach, axis=1, kind="stable")
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        rows = np.full((len(queries), keep), -1, np.int64)
        products = np.full((len(queries), keep), -np.inf)
        limit = bound2.copy()
        searching = np.ones(len(queries), bool)
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            searching &= reach[np.arange(len(leaf)), leaf] <= stop * limit
            for at in np.unique(leaf[searching]).tolist():
                mine = np.flatnonzero(searching & (leaf == at))
                a, b = self.tree.cuts[at]
                inside = self.tree.order[a:b]
                gap = ((projected[mine][:, None, :] - self.points[inside][None, :, :]) ** 2).sum(2)
                found = np.where(gap <= stop * limit[mine][:, None], queries[mine] @ self.vectors[inside].T, -np.inf)
                both = np.concatenate((products[mine], found), axis=1)
                names = np.concatenate((rows[mine], np.broadcast_to(inside, found.shape)), axis=1)
                best = np.lexsort((self.smallest[names], -np.round(both, digits)), axis=1)[:, :keep]
                products[mine], rows[mine] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                worst = -np.partition(-products[mine], k - 1, axis=1)[:, k - 1]
                full = np.isfinite(worst)
                far = self.p.distance2(norms[mine][full], worst[full]) * (1 + 1e-9) + 1e-12
                limit[mine[full]] = np.minimum(limit[mine[full]], far)
        useful = np.isfinite(products)
        useful[useful] = self.p.distance2(np.repeat(norms, useful.sum(1)), products[useful]) <= np.repeat(bound2, useful.sum(1))
        who, column = np.nonzero(useful)
        return who, rows[who, column]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): rows that can take part, as doubles."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    dims: int = DIMS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every row for which ``is_query(id)`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    usual = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if usual is None:
        return empty
    length = usual["length"]
    rows = rows.where(F.size("v") == length)

    # One row per distinct vector: its k + 1 smallest ids, whatever its number of copies.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    distinct = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.xxhash64("v")), "distinct-vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2")).first()
    count = min(MAX_CELLS, max(1, facts["n"] // cell_rows))
    sample = distinct.orderBy("key").limit(SAMPLE).select("v").toArrow()  # a bounded sample for the upper tree
    p = Projection(length, math.sqrt(facts["norm2"]) * (1 + 1e-9), dims)
    shared = spark.sparkContext.broadcast((p, Cells(p.data(_matrix(sample)), count)))
    stop = chi_square_quantile(confidence, dims)
    parts = max(1, math.ceil(facts["n"] / count / CELL_LIMIT))

    def assign(batches):
        p, cells = shared.value
        for batch in batches:
            cell = cells.cell_of(p.data(_matrix(batch)))
            part = batch.column("key").to_numpy().view(np.uint64) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell * parts + part.astype(np.int64)), batch.column("ids"), batch.column("v")], names=["cell", "ids", "v"])

    index = stored(distinct.select("key", "ids", "v").mapInArrow(assign, "cell bigint, ids array<bigint>, v array<double>"), "cells")

    asked = rows.where(is_query(F.col("id")))
    queries = stored(asked.select("v").distinct().withColumn("q", F.xxhash64("v")), "queries")

    def home(batches):
        p, cells = shared.value
        for batch in batches:
            cell = np.repeat(cells.cell_of(p.query(_matrix(batch))) * parts, parts) + np.tile(np.arange(parts), batch.num_rows)
            at = np.repeat(np.arange(batch.num_rows), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), batch.column("q").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.nulls(len(at), pa.float64())], names=["cell", "q", "v", "bound2"])

    visit = "cell bigint, q bigint, v array<double>, bound2 double"
    first = stored(_search(index, queries.select("q", "v").mapInArrow(home, visit), shared, k, stop), "home-hits")

    # The k-th best of the home cell bounds the distance; the test's radius then names the other cells.
    worst = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    bound = first.withColumn("n", worst).where(F.col("n") == k + 1).select("q", F.col("score").alias("floor"))
    bounded = queries.join(bound, "q", "left")

    def outward(batches):
        p, cells = shared.value
        for batch in batches:
            v, floors = _matrix(batch), batch.column("floor").to_numpy(zero_copy_only=False)
            projected, own = p.query(v), cells.cell_of(p.query(v))
            at, cell, limit = [], [], []
            for i, floor in enumerate(floors):
                d2 = np.inf if np.isnan(floor) else float(p.distance2(math.sqrt(float(v[i] @ v[i])), np.array([floor]))[0]) * (1 + 1e-9) + 1e-12
                near = cells.within(projected[i], stop * d2)
                near = np.repeat(near[near != own[i]] * parts, parts) + np.tile(np.arange(parts), (near != own[i]).sum())
                at += [i] * len(near)
                cell += near.tolist()
                limit += [d2] * len(near)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), batch.column("q").take(take), batch.column("v").take(take), pa.array(limit, pa.float64())], names=["cell", "q", "v", "bound2"])

    second = _search(index, bounded.select("q", "v", "floor").mapInArrow(outward, visit), shared, k, stop)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    hits = first.unionByName(second).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("q", "id", "score")

    named = asked.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q")).distinct()
    answers = named.join(stored(hits, "hits"), "q").where("query_id != id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _search(index: DataFrame, visits: DataFrame, shared, k: int, stop: float) -> DataFrame:
    """(q, id, score): at most k + 1 ids per query and cell, ties by id. Cell and its visitors meet in one task."""
    rows = index.select("cell", F.lit(0).alias("kind"), "ids", "v", F.lit(0).cast("bigint").alias("q"), F.lit(None).cast("double").alias("bound2"))
    both = rows.unionByName(visits.select("cell", F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("ids"), "v", "q", "bound2"))
    met = both.repartition("cell").sortWithinPartitions("cell", "kind")

    def search(batches):
        p, _ = shared.value
        at, held, cell = None, [], None
        for batch in batches:  # in a cell its rows come first, then those who visit it, a block at a time
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)]):
                if a == b:
                    continue
                if cells[a] != at:
                    at, held, cell = cells[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((_matrix(part), part.column("ids").to_pylist()))
                elif held or cell:
                    if cell is None:
                        cell = Cell(p, np.concatenate([v for v, _ in held]), [x for _, ids in held for x in ids])
                        held = []
                    for c in range(0, part.num_rows, BLOCK):
                        yield _answers(cell, part.slice(c, BLOCK), k, stop)

    return met.mapInArrow(search, "q bigint, id bigint, score double")


def _answers(cell: Cell, asked: pa.RecordBatch, k: int, stop: float) -> pa.RecordBatch:
    """(q, id, score) of a block of queries: their k + 1 best ids in this cell."""
    q, names = _matrix(asked), asked.column("q").to_numpy()
    bounds = asked.column("bound2").to_numpy(zero_copy_only=False)
    who, row = cell.search(q, k + 1, stop, np.where(np.isnan(bounds), np.inf, bounds))
    exact = np.einsum("ij,ij->i", cell.vectors[row], q[who])
    copies = np.array([len(cell.ids[r]) for r in row.tolist()], np.int64)
    ids = np.array([i for r in row.tolist() for i in cell.ids[r]], np.int64)
    who, exact = np.repeat(who, copies), np.repeat(exact, copies)
    order = np.lexsort((ids, -exact, who))
    who, ids, exact = who[order], ids[order], exact[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    first = place <= k
    return pa.RecordBatch.from_arrays([pa.array(names[who[first]]), pa.array(ids[first]), pa.array(exact[first])], names=["q", "id", "score"])
