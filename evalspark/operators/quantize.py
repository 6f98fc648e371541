"""Vector quantization and approximate search: SQ8, PQ, OPQ, IVF-PQ and rotated low-bit codes.

Training reads all vectors, packed into tiles once; each round is one Spark job whose state is bounded by
dimension x codes, and with a learned rotation by dimension squared. Rounds go on until the measured distortion
stands still. Codes are scored tile by tile, only top-k rows leave a task. Lossy rankings can be scored again from
the stored vectors, to a depth that is measured against a recall target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shuffle_width
from . import tiles
from .ranking import top_k, with_scalars

MOST_ROUNDS, STILL = 100, 0.005  # a round that gains less than STILL of the distortion is the last
SAMPLE = 64  # stored vectors that stand in for queries when a depth or a number of probes is measured


def dimension(df: DataFrame, vec: str = "vector") -> int:
    return int(df.select(F.size(vec)).first()[0])


def flat_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, item: str = "vec_id") -> DataFrame:
    """Exact inner-product ground truth."""
    from .retrieval import dense_search

    return dense_search(queries, vectors, k, item)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


# --- quantizers: encode rows to codes, score queries against codes ------------------------------------

@dataclass(frozen=True)
class ScalarQuantizer:
    """One byte per dimension between the smallest and largest value; decodes to the cell middle."""

    lo: np.ndarray
    width: np.ndarray

    @property
    def bits_per_vector(self) -> int:
        return 8 * len(self.lo)

    def encode(self, x: np.ndarray) -> np.ndarray:
        unit = np.divide(x - self.lo, self.width, out=np.zeros_like(x), where=self.width > 0)
        return np.clip(np.floor(unit * 255.0), 0, 255).astype(np.uint8)

    def score(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return q @ ((codes + 0.5) / 255.0 * self.width + self.lo).T


@dataclass(frozen=True)
class ProductQuantizer:
    """Codebooks (m, codes, d/m); scores through one lookup table per query and subspace."""

    books: np.ndarray
    rotation: np.ndarray | None = None
    history: tuple[float, ...] = ()  # mean squared error at the start of each training round
    converged: bool = True

    @property
    def bits_per_vector(self) -> int:
        return self.books.shape[0] * max(1, int(np.ceil(np.log2(self.books.shape[1]))))

    def _turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        return nearest(self._turn(x), self.books).astype(np.min_scalar_type(self.books.shape[1] - 1))

    def score(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        parts = self._turn(q).reshape(len(q), m, width)
        table = np.einsum("qmw,mcw->qmc", parts, self.books)
        out = np.zeros((len(q), len(codes)))
        for j in range(m):
            out += table[:, j, codes[:, j]]
        return out


@dataclass(frozen=True)
class RotatedQuantizer:
    """Random rotation, (bits-1)-bit scalar codes, and a sign sketch of the residual.

    The sketch makes the inner product unbiased: sqrt(pi/2)/d * |r| * <S q, sign(S r)>.
    """

    rotation: np.ndarray
    sketch: np.ndarray
    levels: np.ndarray

    @property
    def bits_per_vector(self) -> int:
        d = len(self.rotation)
        return (int(np.log2(len(self.levels))) + 1) * d + 16

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.rotation
        cell = np.abs(y[:, :, None] - self.levels).argmin(axis=2)
        rest = y - self.levels[cell]
        signs = (rest @ self.sketch.T >= 0).astype(np.uint8)
        norms = np.linalg.norm(rest, axis=1).astype(np.float16)
        return np.hstack([cell.astype(np.uint8), signs, norms[:, None].view(np.uint8).reshape(len(x), 2)])

    def score(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        d = len(self.rotation)
        y = q @ self.rotation
        base = y @ self.levels[codes[:, :d]].T
        signs = codes[:, d : 2 * d].astype(np.float64) * 2.0 - 1.0
        norms = np.ascontiguousarray(codes[:, 2 * d :]).view(np.float16).astype(np.float64).ravel()
        return base + np.sqrt(np.pi / 2.0) / d * ((y @ self.sketch.T) @ signs.T) * norms


def nearest(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Nearest code per row and subspace."""
    m, _, width = books.shape
    parts = x.reshape(len(x), m, width)
    out = np.empty((len(x), m), dtype=np.int64)
    for j in range(m):
        gap = (books[j] ** 2).sum(1)[None, :] - 2.0 * parts[:, j] @ books[j].T
        out[:, j] = gap.argmin(axis=1)
    return out


# --- training --------------------------------------------------------------------------------------------

def train_scalar(vectors: DataFrame, vec: str = "vector") -> ScalarQuantizer:
    """Per-dimension range: folded inside each task, then over one row per task and dimension."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo = hi = None
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["v"])
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pd.DataFrame({"dim": np.arange(len(lo)), "lo": lo, "hi": hi})

    folded = vectors.select(F.col(vec).alias("v")).mapInPandas(fold, "dim int, lo double, hi double")
    rows = folded.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect()  # one row per dimension
    lo = np.array([r["lo"] for r in rows])
    return ScalarQuantizer(lo, np.array([r["hi"] for r in rows]) - lo)


def _round(packed: DataFrame, books: np.ndarray, rotation: np.ndarray | None, cross: bool) -> tuple[dict[int, np.ndarray], float]:
    """One pass over all vectors: sums and counts by code, distortion, and if asked for the covariance of the vectors with
    what their codes stand for. Keys: subspace, -1 for (squared error, vectors), m + i for row i of the covariance."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    m, k, width = books.shape

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, error, n, both = np.zeros((m, k, width + 1)), 0.0, 0, 0.0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = tiles.matrix(row.data, row.n)
                y = x if rotation is None else x @ rotation
                code, parts = nearest(y, books), y.reshape(len(y), m, width)
                stood = np.empty_like(parts)
                for j in range(m):
                    owner = np.zeros((k, len(y)))
                    owner[code[:, j], np.arange(len(y))] = 1.0
                    sums[j, :, :width] += owner @ parts[:, j]
                    sums[j, :, width] += owner.sum(axis=1)
                    stood[:, j] = books[j][code[:, j]]
                error, n = error + float(((parts - stood) ** 2).sum()), n + len(y)
                if cross:
                    both = both + x.T @ stood.reshape(len(y), -1)
        if n:
            rows = [(j, sums[j].ravel()) for j in range(m)] + [(-1, np.array([error, n]))] + ([(m + i, line) for i, line in enumerate(both)] if cross else [])
            yield pd.DataFrame(rows, columns=["part", "s"])

    partial = packed.select("n", "data").mapInPandas(fold, "part int, s array<double>")
    total = partial.groupBy("part").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect()  # m + 1 + d rows of bounded size
    found = {r["part"]: r["s"].toArray() for r in total}
    error, n = found.pop(-1)
    return found, error / n


def train_codebooks(vectors: DataFrame, m: int, codes: int, item: str = "vec_id", rotation: np.ndarray | None = None,
                    learn_rotation: bool = False, most_rounds: int = MOST_ROUNDS, still: float = STILL) -> ProductQuantizer:
    """k-means in every subspace at once: Lloyd rounds over all vectors from a repeatable start, until they gain no more.

    With ``learn_rotation`` every second round turns the space instead: the orthogonal matrix that brings the vectors
    closest to what their codes stand for, from the singular vectors of their covariance (orthogonal Procrustes). Both
    kinds of round can only lower the distortion. ``history`` and ``converged`` of the result tell how training went.
    """
    spread = F.xxhash64(F.col(item), F.lit(17))
    start = vectors.select(item, F.col("vector").alias("v"), spread.alias("_h")).orderBy("_h", item).limit(codes).collect()  # at most `codes` rows
    first = np.array([r["v"] for r in start], dtype=np.float64)
    d = first.shape[1]
    if d % m:
        raise ValueError(f"dimension {d} is not divisible by {m}")
    if learn_rotation and rotation is None:
        rotation = np.eye(d)
    turned = first if rotation is None else first @ rotation
    width = d // m
    books = np.stack([turned[:, j * width : (j + 1) * width] for j in range(m)])
    packed = durable(tiles.pack_vectors(vectors, item, "vector"))
    history: list[float] = []
    kinds = 2 if learn_rotation else 1
    for step in range(most_rounds):
        turning = learn_rotation and step % 2 == 1
        found, error = _round(packed, books, rotation, turning)
        history.append(error)
        if len(history) > kinds and history[-1 - kinds] - error <= still * kinds * history[-1 - kinds]:
            return ProductQuantizer(books, rotation, tuple(history), True)
        if turning:
            u, _, v = np.linalg.svd(np.stack([found[m + i] for i in range(d)]))
            rotation = u @ v
        else:
            books = books.copy()
            for j in range(m):
                s = found[j].reshape(-1, width + 1)
                filled = s[:, width] > 0
                books[j][filled] = s[filled, :width] / s[filled, width:]
    return ProductQuantizer(books, rotation, tuple(history), False)


def train_pq(vectors: DataFrame, m: int, bits: int = 8, item: str = "vec_id") -> ProductQuantizer:
    return train_codebooks(vectors, m, 1 << bits, item)


def balanced_axes(vectors: DataFrame, m: int) -> np.ndarray:
    """Principal axes dealt to the subspaces so that each gets a similar share of variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    d = dimension(vectors)
    rows = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("x"))
    model = PCA(k=d, inputCol="x", outputCol="y").fit(rows)
    axes = model.pc.toArray()
    share = np.maximum(model.explainedVariance.toArray(), 1e-12)
    load, groups = np.zeros(m), [[] for _ in range(m)]
    for axis in np.argsort(-share):
        open_groups = [g for g in range(m) if len(groups[g]) < d // m]
        best = min(open_groups, key=lambda g: load[g])
        groups[best].append(axis)
        load[best] += np.log(share[axis]) - np.log(1e-12)
    return axes[:, np.concatenate(groups).astype(int)]


def train_opq(vectors: DataFrame, m: int, bits: int = 8, item: str = "vec_id") -> ProductQuantizer:
    """PQ in a learned rotation, which starts from the balanced principal axes."""
    return train_codebooks(vectors, m, 1 << bits, item, balanced_axes(vectors, m), learn_rotation=True)


def rotated_quantizer(d: int, bits: int, seed: int = 0) -> RotatedQuantizer:
    """Seeded rotation and sketch; levels are the optimal scalar levels of a normal coordinate with variance 1/d."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((d, d)))
    n = 1 << (bits - 1)
    sample = np.sort(rng.standard_normal(20_000))
    levels = np.quantile(sample, (np.arange(n) + 0.5) / n)
    for _ in range(60):
        cell = np.abs(sample[:, None] - levels).argmin(1)
        levels = np.array([sample[cell == i].mean() if (cell == i).any() else levels[i] for i in range(n)])
    return RotatedQuantizer(q * np.sign(np.diag(r)), rng.standard_normal((d, d)), levels / np.sqrt(d))


# --- search ------------------------------------------------------------------------------------------------

def compress(vectors: DataFrame, quantizer, item: str = "vec_id") -> DataFrame:
    """Tiles of (ids, n, codes)."""
    id_type = dict(vectors.dtypes)[item]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), tiles.ROWS):
                part = pdf.iloc[start : start + tiles.ROWS]
                codes = quantizer.encode(_stack(part["v"]))
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "n": [len(part)], "data": [codes.tobytes()]})

    packed = vectors.select(F.col(item).alias("id"), F.col("vector").alias("v")).mapInPandas(pack, f"ids array<{id_type}>, n int, data binary")
    return packed.withColumn("tile", F.monotonically_increasing_id())


def cell_tiles(coded: DataFrame, quantizer, item: str) -> DataFrame:
    """Tiles of (x, ids, n, codes), each of one cell x. Codes are brought together by ranges of cells, so that tiles are full
    however many cells there are, and a crowded cell lies in several ranges."""
    id_type = dict(coded.dtypes)[item]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "code": [c.tobytes() for c in quantizer.encode(_stack(pdf["v"]))]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, group in pdf.groupby("x", sort=False):
                for start in range(0, len(group), tiles.ROWS):
                    part = group.iloc[start : start + tiles.ROWS]
                    yield pd.DataFrame({"x": [int(cell)], "ids": [part["id"].to_numpy()], "n": [len(part)], "data": [b"".join(part["code"])]})

    rows = coded.select(F.col(item).alias("id"), F.col("cell").alias("x"), F.col("vector").alias("v"))
    codes = durable(rows.mapInPandas(encode, f"id {id_type}, x int, code binary"))
    ranged = codes.repartitionByRange(shuffle_width(codes.sparkSession), "x", F.xxhash64("id")).sortWithinPartitions("x")
    return ranged.mapInPandas(pack, f"x int, ids array<{id_type}>, n int, data binary").withColumn("tile", F.monotonically_increasing_id())


def _codes(row) -> np.ndarray:
    return np.frombuffer(row.l_data, dtype=np.uint8).reshape(row.l_n, -1)


def _plain_queries(queries: DataFrame, item_type: str) -> DataFrame:
    return queries.select("query_id", "vector", F.array().cast(f"array<{item_type}>").alias("_exclude"))


def _best(scored: DataFrame, k: int, item: str) -> DataFrame:
    return top_k(scored.withColumnRenamed("item", item), ["query_id"], [F.col("score").desc(), F.col(item)], k)


def quantized_search(queries: DataFrame, vectors: DataFrame, quantizer, k: int = 10, item: str = "vec_id") -> DataFrame:
    item_type, query_type = dict(vectors.dtypes)[item], dict(queries.dtypes)["query_id"]
    pairs = tiles.tile_pairs(compress(vectors, quantizer, item), tiles.pack_queries(_plain_queries(queries, item_type), "_exclude"))

    def score(row) -> np.ndarray:
        return quantizer.score(tiles.matrix(row.r_data, row.r_n), _codes(row))

    return _best(tiles.top_scores(pairs, k, score, item_type, query_type), k, item)


def sq8_search(queries, vectors, k: int = 10, item: str = "vec_id") -> DataFrame:
    return quantized_search(queries, vectors, train_scalar(vectors), k, item)


def pq_search(queries, vectors, m: int, bits: int = 8, k: int = 10, item: str = "vec_id") -> DataFrame:
    return quantized_search(queries, vectors, train_pq(vectors, m, bits, item), k, item)


def opq_search(queries, vectors, m: int, bits: int = 8, k: int = 10, item: str = "vec_id") -> DataFrame:
    return quantized_search(queries, vectors, train_opq(vectors, m, bits, item), k, item)


def rotated_lowbit_search(queries, vectors, bits: int, k: int = 10, item: str = "vec_id", seed: int = 0) -> DataFrame:
    return quantized_search(queries, vectors, rotated_quantizer(dimension(vectors), bits, seed), k, item)


def rerank_exact(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, item: str = "vec_id") -> DataFrame:
    """The k best of each query's candidates by the inner product of the stored vectors. Only candidates are joined."""
    held = found.select("query_id", item).join(vectors.select(item, F.col("vector").cast("array<double>").alias("_v")), item)
    both = held.join(queries.select("query_id", F.col("vector").cast("array<double>").alias("_q")), "query_id")
    product = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return top_k(both.select("query_id", item, F.round(product, 9).alias("score")), ["query_id"], [F.col("score").desc(), F.col(item)], k)


def sample_queries(vectors: DataFrame, item: str = "vec_id", n: int = SAMPLE) -> DataFrame:
    """The n stored vectors with the smallest hashes, as queries."""
    chosen = vectors.orderBy(F.xxhash64(F.col(item), F.lit(29)), item).limit(n)
    return durable(chosen.select(F.col(item).alias("query_id"), F.col("vector").cast("array<double>").alias("vector")))


def _reach(places: list[float], target: float) -> int:
    """The place within which the share ``target`` of all places lies."""
    return int(np.sort(places)[max(0, int(np.ceil(target * len(places))) - 1)])


def measured_depth(vectors: DataFrame, quantizer, k: int, target: float, item: str = "vec_id") -> int:
    """How many candidates of a lossy ranking hold the share ``target`` of the true k best, measured on sample queries.

    Both rankings are made over all vectors; k places a sample query come to the driver.
    """
    asked = sample_queries(vectors, item)
    n = vectors.count()
    truth = flat_topk(asked, vectors, k, item).select("query_id", item)
    depth, places = min(n, 16 * k), []
    while True:
        ranked = quantized_search(asked, vectors, quantizer, depth, item).select("query_id", item, "rank")
        places = [r["rank"] or n + 1 for r in truth.join(ranked, ["query_id", item], "left").select("rank").collect()]
        if _reach(places, target) <= depth or depth >= n:
            return min(n, _reach(places, target))
        depth = min(n, 4 * depth)


def reranked_search(queries: DataFrame, vectors: DataFrame, quantizer, k: int = 10, target: float = 0.95, item: str = "vec_id") -> DataFrame:
    """Lossy ranking to the measured depth, then exact order. The column ``depth`` tells how far it went."""
    depth = max(k, measured_depth(vectors, quantizer, k, target, item))
    found = quantized_search(queries, vectors, quantizer, depth, item)
    return rerank_exact(found, queries, vectors, k, item).withColumn("depth", F.lit(depth))


@dataclass(frozen=True)
class CellIndex:
    """Coarse cells with product codes of what lies in them, or of the residuals to their centers."""

    centers: np.ndarray
    quantizer: ProductQuantizer
    coded: DataFrame  # id, cell, and the vector that was coded
    item: str
    residual: bool


def cell_index(vectors: DataFrame, m: int, nlist: int | None = None, bits: int = 8, item: str = "vec_id", residual: bool = True,
               quantizer: ProductQuantizer | None = None) -> CellIndex:
    """By default there are as many cells as the root of the number of vectors; ``nlist`` sets another number."""
    if nlist is None:
        nlist = max(1, round(vectors.count() ** 0.5))
    centers = train_codebooks(vectors, 1, nlist, item).books[0]

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["v"])
                cell = nearest(x, centers[None])[:, 0]
                yield pd.DataFrame({"id": pdf["id"], "cell": cell, "r": list(x - centers[cell] if residual else x)})

    id_type = dict(vectors.dtypes)[item]
    coded = vectors.select(F.col(item).alias("id"), F.col("vector").alias("v")).mapInPandas(
        to_cells, f"id {id_type}, cell int, r array<double>").select(F.col("id").alias(item), "cell", F.col("r").alias("vector"))
    return CellIndex(centers, quantizer or train_pq(coded, m, bits, item), coded, item, residual)


def measured_probes(index: CellIndex, vectors: DataFrame, k: int, target: float) -> int:
    """How many cells, best first, hold the share ``target`` of the true k best of sample queries."""
    asked = sample_queries(vectors, index.item)
    own = {r["query_id"]: np.array(r["vector"]) for r in asked.collect()}  # SAMPLE vectors
    truth = flat_topk(asked, vectors, k, index.item).select("query_id", index.item).join(index.coded.select(index.item, "cell"), index.item)
    places = [int((index.centers @ own[r["query_id"]] > index.centers[r["cell"]] @ own[r["query_id"]]).sum()) + 1 for r in truth.collect()]
    return _reach(places, target)


def search_cells(index: CellIndex, queries: DataFrame, nprobe: int, k: int) -> DataFrame:
    """Best k by code among the nprobe best cells of each query. A crowded cell is many tiles, so it spreads over tasks.

    Few probes meet the tiles of their own cell by a join. If a query probes half of the cells or more, tiles of whole queries,
    with a bit for each cell, meet all tiles instead of a copy of the query for each of its cells.
    """
    centers, quantizer, item, residual = index.centers, index.quantizer, index.item, index.residual
    id_type, query_type = dict(index.coded.dtypes)[item], dict(queries.dtypes)["query_id"]
    left = cell_tiles(index.coded, quantizer, item)

    def near(x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :nprobe]

    def score(row) -> np.ndarray:
        q = tiles.matrix(row.r_data, row.r_n)
        return quantizer.score(q, _codes(row)) + ((q @ centers[row.l_x])[:, None] if residual else 0.0)

    def score_probed(row) -> np.ndarray:
        probed = np.unpackbits(np.frombuffer(row.r_cells, np.uint8).reshape(row.r_n, -1), axis=1)[:, row.l_x] > 0
        out = np.full((row.r_n, row.l_n), -np.inf)
        out[probed] = score(row)[probed]
        return out

    def pack_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, data in enumerate(pdf["data"]):
                x = tiles.matrix(data, pdf["n"].iloc[i])
                probed = np.zeros((len(x), len(centers)), dtype=np.uint8)
                np.put_along_axis(probed, near(x), 1, axis=1)
                yield pdf.iloc[i : i + 1].assign(cells=[np.packbits(probed, axis=1).tobytes()])

    if 2 * nprobe >= len(centers):
        asked = tiles.pack_queries(_plain_queries(queries, id_type), "_exclude").drop("tile")
        schema = ", ".join(f"{name} {kind}" for name, kind in asked.dtypes) + ", cells binary"
        pairs = tiles.tile_pairs(left, asked.mapInPandas(pack_cells, schema).withColumn("tile", F.monotonically_increasing_id()))
        return _best(tiles.top_scores(pairs, k, score_probed, id_type, query_type), k, item)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells = near(_stack(pdf["vector"]))
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), cells.shape[1]), "cell": cells.ravel(),
                                    "vector": [v for v in pdf["vector"] for _ in range(cells.shape[1])]})

    probes = queries.select("query_id", "vector").mapInPandas(probe, f"query_id {query_type}, cell int, vector array<double>")

    def pack_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, group in pdf.groupby("cell", sort=False):
                for start in range(0, len(group), 256):
                    part = group.iloc[start : start + 256]
                    yield pd.DataFrame({"x": [int(cell)], "ids": [part["query_id"].to_numpy()], "n": [len(part)],
                                        "data": [_stack(part["vector"]).tobytes()], "exclude": [[[] for _ in range(len(part))]]})

    right = probes.mapInPandas(pack_probes, f"x int, ids array<{query_type}>, n int, data binary, exclude array<array<{id_type}>>")
    small = tiles.tile_bytes(right) <= tiles.BROADCAST_BYTES  # then the codes stay spread over their ranges
    asked = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    pairs = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).join(F.broadcast(asked) if small else asked, F.col("l_x") == F.col("r_x"))
    return _best(tiles.top_scores(pairs, k, score, id_type, query_type), k, item)


def ivf_pq_search(queries: DataFrame, vectors: DataFrame, m: int, nlist: int | None = None, nprobe: int = 10, bits: int = 8,
                  k: int = 10, item: str = "vec_id") -> DataFrame:
    """Coarse cells, product codes of the residuals; a query meets only the tiles of its nprobe best cells."""
    return search_cells(cell_index(vectors, m, nlist, bits, item), queries, nprobe, k)


def ivf_reranked_search(queries: DataFrame, vectors: DataFrame, m: int, nlist: int | None = None, bits: int = 8, k: int = 10,
                        target: float = 0.95, item: str = "vec_id") -> DataFrame:
    """Cells and codes to a recall target: probes and depth are measured on stored vectors, the order is exact.

    ``probes`` and ``searched`` (share of the cells) tell what the target costs on these vectors.
    """
    index = cell_index(vectors, m, nlist, bits, item, residual=False)
    each = target**0.5  # both losses together stay within the target
    nprobe, depth = measured_probes(index, vectors, k, each), max(k, measured_depth(vectors, index.quantizer, k, each, item))
    found = rerank_exact(search_cells(index, queries, nprobe, depth), queries, vectors, k, item)
    return found.withColumns({"depth": F.lit(depth), "probes": F.lit(nprobe), "searched": F.lit(round(nprobe / len(index.centers), 6))})


# --- reports -------------------------------------------------------------------------------------------------

def storage_report(methods: DataFrame, size: DataFrame) -> DataFrame:
    """Bytes and compression against fp32 and fp16. methods: method, bits_per_vector; size: one row n, d."""
    m = with_scalars(methods, size)
    total = F.floor(F.col("n") * F.col("bits_per_vector") / 8)
    return m.select(
        "method", "bits_per_vector", total.alias("bytes"), (F.col("n") * F.col("d") * 4).alias("fp32_bytes"),
        F.round(F.col("n") * F.col("d") * 4 / total, 6).alias("compression_fp32"), F.round(F.col("n") * F.col("d") * 2 / total, 6).alias("compression_fp16"))


def rotated_bits(d: int, bits: int) -> int:
    return (bits - 1) * d + d + 16


def method_report(truth: DataFrame, found: dict[str, tuple[DataFrame, int]], vectors: DataFrame, item: str = "vec_id") -> DataFrame:
    """recall@1/5/10, size and compression per method, best = highest recall@10 among compression > 2."""
    from functools import reduce

    labelled = [df.select(F.lit(name).alias("method"), "query_id", item, "rank") for name, (df, _) in found.items()]
    every = reduce(DataFrame.unionByName, labelled)
    want = truth.select("query_id", item, F.col("rank").alias("_t"))
    cuts = [1, 5, 10]
    hits = every.join(want, ["query_id", item]).groupBy("method").agg(
        *[F.count_if((F.col("rank") <= c) & (F.col("_t") <= c)).alias(f"_h{c}") for c in cuts])
    asked = want.agg(F.countDistinct("query_id").alias("_q"))
    recall = with_scalars(hits, asked).select("method", *[F.round(F.col(f"_h{c}") / (c * F.col("_q")), 6).alias(f"recall_{c}") for c in cuts])
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(name, int(bits)) for name, (_, bits) in found.items()], "method string, bits_per_vector long")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"))
    table = recall.join(storage_report(sizes, size), "method")
    eligible = F.col("compression_fp32") > 2
    winner = table.agg(F.max_by(F.when(eligible, F.col("method")), F.when(eligible, F.struct("recall_10", "compression_fp32"))).alias("_best"))
    return with_scalars(table, winner).withColumn("best", F.col("method") == F.col("_best")).drop("_best")
