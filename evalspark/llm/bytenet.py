"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover the whole of it; the
last one is filled up with zeros. Bytes are embedded, learned filters of ``WIDTH`` bytes pass over every chunk in steps
of ``STRIDE``, and each filter's largest response in a chunk is kept. The chunks of a document are combined by the mean
of their pooled responses, weighted by the bytes they hold, and two dense layers turn it into one probability.

Training uses a bounded sample: of each label the ``max_rows`` different texts with the smallest hashes, and of each of
these up to ``PARTS`` chunks spread over the text, so the driver never holds more than 2 * max_rows * PARTS * CHUNK bytes.
Both labels weigh the same. Gradients flow through the largest response only; Adam takes the steps. Which texts are
learned from depends on the text alone; the network sees bytes and nothing else.

Scoring is one scan over all documents with the weights (some 20 kB) sent to the tasks; nothing is shuffled.

Edge cases. A null text counts as empty; an empty text is one chunk of zeros and gets that chunk's score. Long texts are
scored whole, a group of chunks at a time. Without labelled rows every score is 0.5; with one label only the network
learns that label's side. Several label rows of a document count as the lowest quality. Repeated rows are scored each on
their own. Columns of the input stay, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP = 1024, 64
WIDTH, STRIDE, DEPTH, FILTERS, HIDDEN = 16, 4, 8, 32, 16
PARTS = 4
MAX_ROWS = 2_000
STEPS, BATCH, RATE = 800, 32, 0.004
GROUP = 64  # chunks that go through the network together
AHEAD = CHUNK - OVERLAP
PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    """Weights: byte embedding, filters (WIDTH * DEPTH x FILTERS), and two dense layers."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            normal(256, DEPTH, scale=0.5), normal(WIDTH * DEPTH, FILTERS, scale=(2 / (WIDTH * DEPTH)) ** 0.5), np.zeros(FILTERS, np.float32),
            normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Responses of all filters at all places: (chunk, place, filter).

        A filter is applied as WIDTH / STRIDE slices, so each block of STRIDE bytes is multiplied once.
        """
        blocks, slices = CHUNK // STRIDE, WIDTH // STRIDE
        bytes_ = self.embed[chunks].reshape(len(chunks) * blocks, STRIDE * DEPTH)
        by_slice = self.filters.reshape(slices, STRIDE * DEPTH, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DEPTH, slices * FILTERS)
        parts = (bytes_ @ by_slice).reshape(len(chunks), blocks, slices, FILTERS)
        total = parts[:, :PLACES, 0].copy()
        for k in range(1, slices):
            total += parts[:, k: PLACES + k, k]
        return total

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each chunk, a group of chunks at a time."""
        found = [self.responses(chunks[at: at + GROUP]).max(axis=1) for at in range(0, len(chunks), GROUP)]
        return np.maximum(np.concatenate(found) + self.bias, 0)

    def probability(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(features @ self.dense + self.dense_bias, 0)
        return _sigmoid((hidden @ self.out + self.out_bias).astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of texts that lie one after the other in ``data``: start, bytes held and row of each chunk, chunks a row."""
    sizes = np.diff(offsets)
    each = np.maximum(-(-(sizes - OVERLAP) // AHEAD), 1)
    row = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return offsets[row] + nth * AHEAD, np.minimum(sizes[row] - nth * AHEAD, CHUNK), row, each


def scores(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of every text between the offsets."""
    starts, held, row, each = chunked(data, offsets)
    if not len(row):
        return np.zeros(0)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(CHUNK, np.uint8)]), CHUNK)
    features = np.zeros((len(each), FILTERS))
    for at in range(0, len(row), GROUP):
        some = slice(at, at + GROUP)
        chunks = windows[starts[some]]
        chunks[np.arange(CHUNK) >= held[some, None]] = 0
        np.add.at(features, row[some], network.pooled(chunks) * np.maximum(held[some], 1)[:, None])
    weight = np.zeros(len(each))
    np.add.at(weight, row, np.maximum(held, 1))
    return network.probability((features / weight[:, None]).astype(np.float32))


def train(chunks: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """Fit a network to rows whose chunks are given; ``row`` is ascending and numbers the rows of ``label``.

    Rows are taken in random order, BATCH at a time, over and over, for ``steps`` steps.
    """
    network, rng = Network.new(seed), np.random.default_rng(seed)
    if not len(label):
        return network
    first = np.searchsorted(row, np.arange(len(label) + 1))
    share = np.array([np.mean(label == 0), np.mean(label == 1)])
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)[label]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    queue = np.zeros(0, np.int64)
    for done in range(1, steps + 1):
        if len(queue) < min(BATCH, len(label)):
            queue = np.concatenate([queue, rng.permutation(len(label))])
        rows, queue = queue[:BATCH], queue[BATCH:]
        where = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
        grads = _gradients(network, chunks[where], first[rows + 1] - first[rows], label[rows], weight[rows])
        rate = RATE * (1 - (done - 1) / steps)
        for w, g, (mean, square) in zip(network.weights(), grads, moments):
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            w -= (rate * (mean / (1 - 0.9**done)) / (np.sqrt(square / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
    return network


def _gradients(network: Network, chunks: np.ndarray, each: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss of some rows, in the order of ``Network.weights``."""
    at, peak = [], []
    for start in range(0, len(chunks), GROUP):
        response = network.responses(chunks[start: start + GROUP])
        place = response.argmax(axis=1)
        at.append(place)
        peak.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0])
    place, peak = np.concatenate(at), np.concatenate(peak) + network.bias
    starts = np.cumsum(each) - each
    features = np.add.reduceat(np.maximum(peak, 0), starts) / each[:, None]
    before = features @ network.dense + network.dense_bias
    hidden = np.maximum(before, 0)
    error = ((_sigmoid(hidden @ network.out + network.out_bias) - label) * weight / len(label)).astype(np.float32)
    to_hidden = error[:, None] * network.out * (before > 0)
    to_features = to_hidden @ network.dense.T / each[:, None]
    to_peak = np.repeat(to_features, each, axis=0) * (peak > 0)  # (chunk, filter)
    seen = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]  # the bytes below each peak
    below = network.embed[seen].reshape(len(chunks), FILTERS, WIDTH * DEPTH)
    to_filters = np.einsum("cf,cfk->kf", to_peak, below)
    to_bytes = (to_peak[:, :, None] * network.filters.T[None]).reshape(-1, DEPTH)
    to_embed = np.stack([np.bincount(seen.reshape(-1), to_bytes[:, d], minlength=256) for d in range(DEPTH)], axis=1).astype(np.float32)
    return [to_embed, to_filters, to_peak.sum(axis=0), features.T @ to_hidden, to_hidden.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Up to ``max_rows`` different texts of each label as chunks: label, parts (array of binary).

    Texts are chosen by the smallest hashes among (id, hash) pairs; only the chosen ids, a bounded table, are broadcast to
    fetch texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("hash")).join(known, "doc_id")
    texts = keys.groupBy("hash").agg(F.min(F.struct("label", "doc_id")).alias("one")).select("hash", "one.label", "one.doc_id")
    chosen = [texts.where(F.col("label") == side).orderBy("hash").limit(max_rows) for side in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(body)
    many = F.least(F.lit(PARTS), F.greatest(F.ceil(size / F.lit(CHUNK)), F.lit(1)))
    begin = lambda k: F.when(many > 1, F.floor(k * (size - CHUNK) / (many - 1))).otherwise(0)
    parts = F.transform(F.sequence(F.lit(0), (many - 1).cast("int")), lambda k: F.substring(body, (begin(k) + 1).cast("int"), F.lit(CHUNK)))
    fetched = docs.select("doc_id", F.xxhash64("text").alias("hash"), parts.alias("parts")).join(F.broadcast(ids), ["doc_id", "hash"])
    return fetched.groupBy("hash").agg(F.first("label").alias("label"), F.first("parts").alias("parts"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, steps: int = STEPS) -> Network:
    """Train on the labelled rows of ``docs`` (doc_id, text); ``labels`` has doc_id and quality (0 or 1)."""
    rows = sorted(sample(docs, labels, max_rows).collect(), key=lambda r: r.hash)
    chunks = np.zeros((sum(len(r.parts) for r in rows), CHUNK), np.uint8)
    row = np.repeat(np.arange(len(rows)), [len(r.parts) for r in rows])
    for at, part in enumerate(p for r in rows for p in r.parts):
        chunks[at, : len(part)] = np.frombuffer(part, np.uint8)
    return train(chunks, row, np.array([r.label for r in rows], dtype=np.int64), steps)


def score(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """Every row with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from the threshold on)."""
    docs = docs.drop("score", "predicted")
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(place).cast(pa.large_string()), "")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            low, high = int(offsets[0]), int(offsets[-1])
            data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
            found = scores(network, data, offsets - low)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
