"""Toxicity by maximum-scoring segments over token log-odds.

Training. Words of labelled texts are counted once per group of near copies (texts with the same smallest bigram hash),
separately for toxic and clean ones; log-odds under a Dirichlet prior, whose pseudo-counts are shared as the labels are,
give each word a weight, near 0 for rare words. Word beginnings are weighted by the different words that start with
them, at most ``TYPE_CAP`` groups a word, and stand in for words that training has hardly seen. A constant is taken off
so that ordinary text has a negative mean, which makes segment scores follow the extreme-value law: lambda and K are
those of the background score distribution.

Scoring. One linear scan per text finds every maximal segment (Ruzzo and Tompa); those whose E-value is at most
``max_evalue`` are the significant passages. A document's evidence is the sum statistic of all its segments with an
E-value of at most 1, put through a logistic curve that is fitted on the training rows.

The model learns from every labelled row and has at most ``max_words`` weights, so what travels to the tasks is bounded.
Training looks at text and labels only, never at ids, languages or sources.

Edge cases. Null, empty and blank texts have no passages and get the score of a text without evidence. Without toxic or
without clean labelled rows every weight is 0 and every score is the base rate's (0 without rows). Repeated rows are
scored each on their own; a document with several label rows is toxic if one says so. Columns of the input stay, those
named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, join_ids, stored

MAX_WORDS = 50_000
STEMS = (3, 4, 5, 6)
TYPE_CAP = 3
CACHED = 100_000
PRIOR = 8.0
DRIFT = 1.0
MAX_EVALUE = 0.05
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}#*$%&|<>-_"


@dataclass
class Model:
    """Weights of words and of word beginnings, the law of background scores, and the logistic curve."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -3.0

    def weights(self) -> _Weights:
        """Weight of any word, remembered in each Python worker."""
        if "_known" not in self.__dict__:
            self._known = _Weights(self.words, self.stems)
        return self._known

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


class _Weights(dict):
    """The larger one of a word's weight and its beginnings'; 0 if neither is known. Bounded."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> float:
        known = [self.stems[s] for k in STEMS if len(word) > k and (s := word[:k]) in self.stems]
        if word in self.words:
            known.append(self.words[word])
        weight = max(known, default=0.0)
        if len(self) < CACHED:
            self[word] = weight
        return weight


# ---- one text ----

def token_weights(tokens: list[str], m: Model) -> np.ndarray:
    """Weight of each token less the drift. A word right after itself weighs nothing, so that one repeated word makes no
    passage."""
    out = np.fromiter(map(m.weights().__getitem__, tokens), float, len(tokens)) - DRIFT
    for i in np.flatnonzero(out > 0).tolist():
        if i and tokens[i] == tokens[i - 1]:
            out[i] = -DRIFT
    return out


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time (Ruzzo and Tompa 1999).

    Only positive weights can start or end a segment, so runs of the others are read off the cumulative sum.
    """
    total = np.concatenate(([0.0], np.cumsum(weights)))
    segments: list[list] = []  # start, end, sum before start, sum at end; sums before starts: see ``smaller``
    smaller: list[int] = []  # for each segment the nearest one before it whose left sum is smaller
    for i in np.flatnonzero(weights > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= new[2]:
                j = smaller[j]
            if j < 0 or segments[j][3] >= new[3]:
                segments.append(new)
                smaller.append(j)
                break
            new = [segments[j][0], new[1], segments[j][2], new[3]]
            del segments[j:], smaller[j:]
    return [(a, b, float(right - left)) for a, b, left, right in segments]


def passages(tokens: list[str], m: Model, max_evalue: float = MAX_EVALUE) -> list[tuple[int, int, float, float]]:
    """Segments of a text that are unlikely in ordinary text: first word, end, score and E-value."""
    if not tokens:
        return []
    found = [(a, b, s, m.k * len(tokens) * math.exp(-m.lam * s)) for a, b, s in maximal_segments(token_weights(tokens, m))]
    return [x for x in found if x[3] <= max_evalue]


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    """Sum statistic of the extreme-value law: the best r segments together, for the r that says most."""
    best = total = 0.0
    for r, e in enumerate(sorted(e for _, _, _, e in found), 1):
        total += -math.log(max(e, 1e-300)) + math.log(r)
        best = max(best, total)
    return best


def probability(x: float, m: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, m.slope * x + m.offset))))


def split(text: str | None) -> list[str]:
    """Lower-case words without the marks at their ends; every run without white space gives one."""
    return [w.strip(EDGES) for w in (text or "").lower().split()]


# ---- training ----

def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): distinct texts of all labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    copy = F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    texts = join_ids(texts, known, "doc_id").withColumn("copy", copy)
    kept = texts.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return join_ids(texts.drop("toxic"), kept, ["doc_id", "copy"]).select("text", "toxic")


def near_copy_key(words: Column) -> Column:
    """The smallest hash of two neighbouring words: the same for most near copies of a text."""
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.array_min(pairs)


def _counts(rows: DataFrame, key: Column) -> DataFrame:
    """(key, toxic, clean): in how many groups of either label a key occurs."""
    keys = rows.select("toxic", "copy", F.explode(F.array_distinct(key)).alias("key")).where(F.length("key") > 0).distinct()
    return keys.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def _stem_counts(counted: DataFrame) -> DataFrame:
    """(key, toxic, clean, words): capped groups of the words with each beginning, and how many of them are toxic ones."""
    starts = F.filter(F.array(*[F.when(F.length("key") > k, F.substring("key", 1, k)) for k in STEMS]), lambda x: x.isNotNull())
    rows = counted.select(F.explode(starts).alias("stem"), F.least("toxic", F.lit(TYPE_CAP)).alias("t"), F.least("clean", F.lit(TYPE_CAP)).alias("c"))
    return rows.groupBy(F.col("stem").alias("key")).agg(
        F.sum("t").alias("toxic"), F.sum("c").alias("clean"), F.sum((F.col("t") > 0).cast("int")).alias("words"))


def _weights(counts: DataFrame, n_toxic: int, n_clean: int, max_words: int, prior: float = PRIOR) -> dict[str, float]:
    """Log-odds of a key's groups under the prior, against the odds of the labels; the ``max_words`` farthest from 0 in
    standard deviations."""
    share = n_toxic / (n_toxic + n_clean)
    t, c = F.col("toxic") + F.lit(prior * share), F.col("clean") + F.lit(prior * (1 - share))
    odds = F.log(t / c) - math.log(n_toxic / n_clean)
    best = counts.select("key", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z")).where(F.abs("odds") > 0.25)
    rows = best.orderBy(F.abs("z").desc(), "key").limit(max_words).collect()  # at most max_words rows
    return {r["key"]: float(r["odds"]) for r in rows}


def background(scores: np.ndarray) -> tuple[float, float]:
    """lambda and a bound of K for independent scores with a negative mean.

    lambda solves mean(exp(lambda * s)) = 1; K is approximated from the drift and the tilted mean.
    """
    if not len(scores) or scores.max() <= 0 or scores.mean() >= 0:
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    moment = lambda x: float(np.mean(np.exp(np.minimum(x * scores, 500.0))))
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    lam = max(low, 0.05)
    tilted = float(np.mean(scores * np.exp(np.minimum(lam * scores, 500.0))))
    return lam, min(1.0, max(1e-3, float(-scores.mean()) ** 2 / max(tilted, 1e-6) * lam))


def fit(rows: DataFrame, max_words: int = MAX_WORDS, bins: int = 64) -> Model:
    """Learn a model from labelled (text, toxic) rows. Counting runs in Spark; only bounded tables reach the driver."""
    rows = rows.select(F.col("toxic").cast("int").alias("toxic"), "text")
    counts = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = int(counts["t"] or 0), int(counts["n"] - (counts["t"] or 0))
    if not n_toxic or not n_clean:
        rate = n_toxic / max(1, n_toxic + n_clean)
        return Model(slope=0.0, offset=math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE), lambda w: F.btrim(w, F.lit(EDGES)))
    parts = rows.select("toxic", words.alias("words")).select("toxic", "words", near_copy_key(F.col("words")).alias("copy"))
    counted = stored(_counts(parts, F.col("words")), "word-counts")
    m = Model(words=_weights(counted.where("toxic + clean >= 3"), n_toxic, n_clean, max_words))
    stems = _stem_counts(counted)
    every = stems.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if every["t"] and every["c"]:
        m.stems = {s: w for s, w in _weights(stems.where("words >= 3"), int(every["t"]), int(every["c"]), max_words).items() if w > DRIFT}

    # Background: distribution of the weights over clean texts, as counts per weight in steps of 1/16.
    def weigh(batches):
        tally = np.zeros(2 * 16 * bins, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                w = token_weights(split(text), m)
                tally += np.bincount(np.clip(np.rint(w * 16).astype(int) + 16 * bins, 0, len(tally) - 1), minlength=len(tally))
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at - 16 * bins, pa.int64()), pa.array(tally[at], pa.int64())], names=["step", "n"])

    spread = rows.where("toxic = 0").select("text").mapInArrow(weigh, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    steps, sizes = np.array([r["step"] for r in spread]) / 16, np.array([r["n"] for r in spread], dtype=float)
    sample = np.repeat(steps, np.maximum(1, np.rint(sizes / sizes.sum() * 200_000)).astype(int)) if len(sizes) else np.zeros(0)
    m.lam, m.k = background(sample)

    # The curve: evidence in half-unit steps against the label.
    def gather(batches):
        for batch in batches:
            x = [evidence(passages(split(text), m, 1.0)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.rint(np.array(x) * 2), 400), pa.int64()), batch.column("toxic")], names=["step", "toxic"])

    points = rows.mapInArrow(gather, "step bigint, toxic int").groupBy("step").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    m.slope, m.offset = _logistic(np.array([p["step"] / 2 for p in points]), np.array([p["t"] for p in points], float), np.array([p["n"] for p in points], float))
    return m


def _logistic(x: np.ndarray, hits: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps for a logistic curve on grouped points; the slope stays positive.

    A step is halved until the penalised likelihood rises: whole steps can leave the curve on one side of all points, where
    its curvature is 0 and nothing leads back.
    """
    x = np.log1p(x)

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(np.sum(n * np.logaddexp(0, z) - hits * z) + ridge / 2 * (a * a + b * b))

    a, b = 0.5, -2.0
    now = loss(a, b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([np.sum((hits - n * p) * x) - ridge * a, np.sum(hits - n * p) - ridge * b])
        w = n * p * (1 - p)
        if a <= 0.05 and g[0] < 0:  # the slope stands at its bound
            step = np.array([0.0, g[1] / (np.sum(w) + ridge)])
        else:
            step = np.linalg.solve(np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w) + ridge]]), g)
        size = 1.0
        while size > 1e-9 and (found := loss(max(0.05, a + size * step[0]), b + size * step[1])) > now + 1e-9 * abs(now):
            size /= 2
        if size <= 1e-9:
            break
        a, b, now = max(0.05, a + size * step[0]), b + size * step[1], found
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


# ---- scoring ----

def score(docs: DataFrame, m: Model, max_evalue: float = MAX_EVALUE) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (0/1) and ``passages`` (first word, end, score, e_value of each passage)."""
    own = ["score", "predicted", "passages"]
    kept = docs.drop(*own)
    piece = "array<struct<first:int,end:int,score:double,e_value:double>>"
    schema = T.StructType(kept.schema.fields + T.StructType.fromDDL(f"score double, predicted int, passages {piece}").fields)
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def scored(batches):
        for batch in batches:
            out, found = [], []
            for text in batch.column("text").to_pylist():
                hits = passages(split(text), m, max(1.0, max_evalue))
                out.append(probability(math.log1p(evidence(hits)), m))
                found.append([{"first": a, "end": b, "score": s, "e_value": e} for a, b, s, e in hits if e <= max_evalue])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64()), pa.array([int(p >= 0.5) for p in out], pa.int32()), pa.array(found, span)],
                names=[*batch.schema.names, *own])

    return kept.mapInArrow(scored, schema)
