"""Degeneration detectors, slop indices and distribution distances over text columns."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from hashlib import blake2b
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams, lists
from ..functions.arrow import arrow_udf
from ..functions.text import col, let, ngram_hashes, ngrams, occurrences, rstrip, strip, tokens, words
from ..session import durable
from . import automaton, tiles
from .curate import template_leak
from .ranking import with_scalars

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def token_counts(df: DataFrame, text: str, by: str) -> DataFrame:
    exploded = df.select(by, F.explode(tokens(text)).alias("word"))
    return exploded.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))


def token_l2(df: DataFrame, text: str, side: Column) -> DataFrame:
    """L2 distance of the unigram distributions of side = 'a' and side = 'b'. One shuffle by word."""
    exploded = df.select(side.alias("_side"), F.explode(tokens(text)).alias("word"))
    freq = exploded.groupBy("word").agg(
        F.count_if(F.col("_side") == "a").alias("a"), F.count_if(F.col("_side") == "b").alias("b"))
    total = freq.agg(F.greatest(F.sum("a"), F.lit(1)).alias("_na"), F.greatest(F.sum("b"), F.lit(1)).alias("_nb"))
    gap = F.col("a") / F.col("_na") - F.col("b") / F.col("_nb")
    return with_scalars(freq, total).agg(F.round(F.sqrt(F.sum(gap * gap)), 6).alias("token_l2"))


def slop_signs(text) -> dict[str, Column]:
    t, low = col(text), F.lower(col(text))
    phrases = F.lit(0)
    for p in lists.STOCK_PHRASES:
        phrases = phrases + occurrences(low, p)
    return {
        "em_dash": occurrences(t, "—") + F.regexp_count(t, F.lit(r"\s-\s")),
        "not_x_y": F.regexp_count(low, F.lit(lists.NOT_X_BUT_Y)),
        "phrases": phrases,
        "words": F.size(tokens(t)),
    }


def slop_rate(df: DataFrame, text: str, by: str) -> DataFrame:
    signs = slop_signs(text)
    sums = df.groupBy(by).agg(*[F.sum(c).alias(name) for name, c in signs.items()])
    hits = F.col("em_dash") + F.col("not_x_y") + F.col("phrases")
    return sums.withColumn("total_per_1k", F.round(hits * 1000.0 / F.greatest("words", F.lit(1)), 2)).drop("words")


def phrase_weights(ranked: DataFrame, lo: int = 0, hi: int = 600) -> DataFrame:
    """Phrases of a rank band with weight (1 - adjustment) / largest weight over all ranks.

    ranked: phrase, rank (from 0), adjustment.
    """
    top = ranked.agg(F.max(1.0 - F.col("adjustment")).alias("_mx"))
    band = ranked.filter((F.col("rank") >= lo) & (F.col("rank") < hi))
    return with_scalars(band, top).select(F.lower("phrase").alias("phrase"), "rank", ((1.0 - F.col("adjustment")) / F.col("_mx")).alias("weight"))


def phrase_hits(df: DataFrame, id_col: str, text: str, phrases: DataFrame) -> DataFrame:
    """(id, phrase, hits): whole-word, non-overlapping occurrences of a lexicon's phrases.

    Only hits leave a task, and no text is shuffled; ``automaton`` says how a long list is bounded.
    """
    parts = []
    for table in automaton.phrase_tables(df, phrases.select("phrase").distinct()):
        found = df.select(id_col, F.explode(_finder(table)(F.lower(text))).alias("_h"))
        parts.append(found.select(id_col, "_h.phrase", "_h.hits"))
    return reduce(DataFrame.unionByName, parts) if parts else df.select(id_col, F.lower(text).alias("phrase"), F.lit(0).cast("long").alias("hits")).limit(0)


def _finder(table):
    @arrow_udf("array<struct<phrase:string,hits:long>>")
    def find(texts: pd.Series) -> pd.Series:
        names = table.value.phrases
        return texts.map(lambda t: [{"phrase": names[i][0], "hits": n} for i, n in table.value.count(t or "").items()])

    return find


def _weigher(table, place: dict[str, int]):
    @arrow_udf("array<double>")
    def total(texts: pd.Series) -> pd.Series:
        def one(t):
            sums = [0.0] * len(place)
            for i, n in table.value.count(t or "").items():
                for label, weight in table.value.phrases[i][1]:
                    sums[place[label]] += n * weight
            return sums

        return texts.map(one)

    return total


def _phrase_sums(df: DataFrame, text: str, phrases: DataFrame, labels: Sequence[str]) -> Column:
    """Weighted hits of the phrases of each label (column ``label``), an array in the order of ``labels``.

    Weights travel with the phrases, so sums are made where the text is and nothing is joined or grouped.
    """
    place = {label: i for i, label in enumerate(labels)}
    columns = [_weigher(table, place)(F.lower(text)) for table in automaton.phrase_tables(df, phrases, "label", "weight")]
    nothing = F.array(*[F.lit(0.0) for _ in labels])
    return reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), columns) if columns else nothing


def _per_thousand(total: Column, text: str) -> Column:
    return F.round(total / F.greatest(F.size(words(text)), F.lit(1)) * 1000, 6)


def slop_index(df: DataFrame, id_col: str, text: str, phrases: DataFrame) -> DataFrame:
    """Weighted phrase hits per 1000 words; rows without hits score 0."""
    sums = _phrase_sums(df, text, phrases.select("phrase", F.lit("").alias("label"), "weight"), [""])
    return df.select(id_col, _per_thousand(sums[0], text).alias("slop_index"))


def slop_bands(df: DataFrame, id_col: str, text: str, ranked: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """The same index per rank band in one pass over the text: (id, band, slop_index)."""
    weights = phrase_weights(ranked, 0, max(hi for _, hi in bands))
    label = F.coalesce(*[F.when((F.col("rank") >= lo) & (F.col("rank") < hi), F.lit(f"{lo}-{hi}")) for lo, hi in bands])
    banded = weights.withColumn("label", label).filter(F.col("label").isNotNull())
    names = [f"{lo}-{hi}" for lo, hi in bands]
    sums = df.select(id_col, _phrase_sums(df, text, banded, names).alias("_s"), F.greatest(F.size(words(text)), F.lit(1)).alias("_n"))
    each = sums.select(id_col, "_n", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("band"), F.col("_s").alias("total"))).alias("_b"))
    return each.select(id_col, F.col("_b.band").alias("band"), F.round(F.col("_b.total") / F.col("_n") * 1000, 6).alias("slop_index"))


# --- repetition ------------------------------------------------------------------------------------

def max_repeat(grams: Column) -> Column:
    """Largest multiplicity in an array of hashes: run lengths over the sorted array, inside the row."""
    start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, g):
        run = F.when(acc["g"] == g, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("g"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    def counted(g: Column) -> Column:
        runs = F.aggregate(F.array_sort(g), start, step, lambda acc: acc["best"])
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.least(F.size(g), F.lit(1))).otherwise(runs)

    return let(grams, counted)


def worst_ngram(text, n: int = 4) -> Column:
    """Most repeated n-gram of lower-cased words without surrounding punctuation; grams are compared by 64-bit hashes."""
    bare = F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(""".,;:!?"'"""))))
    return max_repeat(ngram_hashes(bare, n))


def ngram_loop(text, n: int = 8, least_words: int = 24, legacy: bool = False) -> Column:
    """Most repeated word 8-gram of a longer text, else NULL. legacy leaves out the last window."""
    def looped(w: Column) -> Column:
        grams = ngram_hashes(w, n)
        if legacy:
            grams = F.slice(grams, F.lit(1), F.greatest(F.size(w) - n, F.lit(0)))
        return F.when(F.size(w) >= least_words, max_repeat(grams))

    return let(words(text), looped)


def char_run(text) -> Column:
    """Length of the longest run of one character (line feeds excluded)."""
    runs = F.regexp_extract_all(col(text), F.lit(r"([^\n])\1*"), 0)
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


@arrow_udf("double")
def compression_ratio(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        raw = t.encode("utf-8")
        return len(zlib.compress(raw)) / max(1, len(raw))

    return text.map(one).astype("float64")


def weird_char_frac(text) -> Column:
    odd = F.regexp_count(col(text), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F�]"))
    return F.when(F.length(text) > 0, odd / F.length(text))


def degenerate_flags(df: DataFrame, text: str, legacy: bool = False) -> DataFrame:
    """flags array; shorter than 10 characters is only 'empty'."""
    ready = (
        df.withColumn("_run", char_run(text))
        .withColumn("_loop", ngram_loop(text, legacy=legacy))
        .withColumn("_zip", F.round(compression_ratio(F.col(text)), 3))
        .withColumn("_odd", F.round(weird_char_frac(text), 4))
    )
    flags = F.array_compact(F.array(
        F.when(F.col("_run") > 12, F.concat(F.lit("char run x"), "_run")),
        F.when(F.col("_loop") > 4, F.concat(F.lit("8-gram loop x"), "_loop")),
        F.when(F.col("_zip") < 0.18, F.lit("compression")),
        F.when(F.col("_odd") > 0.005, F.lit("weird chars")),
        F.when(template_leak(text), F.lit("template leakage")),
    ))
    short = F.length(strip(F.coalesce(F.col(text), F.lit("")))) < 10
    return ready.withColumn("flags", F.when(short, F.array(F.lit("empty"))).otherwise(flags)).drop("_run", "_loop", "_zip", "_odd")


# --- pairwise similarity -----------------------------------------------------------------------------

def line_set(text) -> Column:
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), LINE_BREAK), lambda x: strip(x))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def line_jaccard(a, b) -> Column:
    def share(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        union = F.size(s["a"]) + F.size(s["b"]) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    return let(F.struct(line_set(a).alias("a"), line_set(b).alias("b")), share)


@arrow_udf("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two whole texts."""
    pairs = zip(a.fillna(""), b.fillna(""))
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")


def rstripped_ratio(a, b) -> Column:
    return sequence_ratio(rstrip(a), rstrip(b))


def needle_recall(df: DataFrame, answer: str, needle: str, length: str = "length", depth: str = "depth") -> DataFrame:
    """Share of answers that contain the needle per (length, depth)."""
    found = F.contains(F.col(answer), F.col(needle)).cast("double")
    return df.groupBy(length, depth).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(found), 6).alias("recall"))


def gram_sets(df: DataFrame, id_col: str, text: str, n: int = 4) -> DataFrame:
    """Distinct n-gram sets: smallest id, how many texts share exactly that set, its size and one of its texts in lower case.

    Copies collapse here, so a text repeated a billion times is one set with a weight. The text travels instead of its
    grams, which take twice the room; whoever needs them hashes them again.
    """
    low = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(blake2b(s.tobytes(), digest_size=16).digest(), len(s)) for s in grams.gram_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k for k, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], names=["id", "text", "_key", "total"])

    return low.mapInArrow(keyed, T.StructType([*low.schema.fields, *T.StructType.fromDDL("_key binary, total bigint").fields])).groupBy("_key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total"), F.first("text").alias("text")).drop("_key")


def gram_tiles(sets: DataFrame, n: int = 4) -> DataFrame:
    """Tiles of the sets, cut to the grams that another set holds too. Sorted, so that a task run again deals the same tiles."""
    ordered = sets.filter("total > 0").sortWithinPartitions("id")
    return tiles.shared_tiles(ordered.select("id", "weight", "text"), lambda texts: grams.gram_sets(texts, n))


def shared_ngram_pairs(df: DataFrame, id_col: str, text: str, n: int = 4) -> DataFrame:
    """Pairs of distinct gram sets with a shared n-gram: a < b, shared, union and the copies of each."""
    sets = gram_sets(df, id_col, text, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, found in tiles.all_shared_pairs(batches):
            ids_l, ids_r, weights_l, weights_r = map(np.asarray, (row.l_ids, row.r_ids, row.l_weights, row.r_weights))
            for at_l, at_r, shared, union in found:
                left, right, wl, wr = ids_l[at_l], ids_r[at_r], weights_l[at_l], weights_r[at_r]
                swap = left > right
                yield pd.DataFrame({
                    "a": np.where(swap, right, left), "b": np.where(swap, left, right), "shared": shared, "union_size": union,
                    "copies_a": np.where(swap, wr, wl), "copies_b": np.where(swap, wl, wr)})

    schema = "a long, b long, shared long, union_size long, copies_a long, copies_b long"
    return tiles.self_pairs(gram_tiles(sets, n)).mapInPandas(run, schema)


def self_bleu(df: DataFrame, id_col: str, text: str, n: int = 4) -> DataFrame:
    """Mean pairwise Jaccard of n-gram sets over all pairs of texts.

    Copies contribute in closed form. Only grams that two sets hold and sets with such a gram are compared, tile by tile;
    a sum leaves each task. All other pairs are 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = []
        for row, found in tiles.all_shared_pairs(batches):
            wl, wr = np.asarray(row.l_weights), np.asarray(row.r_weights)
            sums += [float((wl[at_l] * wr[at_r] * (shared / union)).sum()) for at_l, at_r, shared, union in found]
            if row.l_tile == row.r_tile:
                sums.append(row.l_copies)
        yield pd.DataFrame({"s": [math.fsum(sums)]})

    shared = tiles.self_pairs(gram_tiles(gram_sets(df, id_col, text, n), n)).mapInPandas(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("_s"))
    total = with_scalars(shared, df.agg(F.count(F.lit(1)).alias("_n")))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2.0
    return total.select(F.round(F.coalesce(F.col("_s") / F.nullif(pairs, F.lit(0.0)), F.lit(0.0)), 6).alias("self_bleu"))


MMD_ROWS, MMD_BLOCK = 2048, 64  # vectors of a tile, and of those met at once
CELLS = 1 << 16  # of a histogram of distances
LISTED = 1 << 18  # distances around the median that are listed by value
NARROW = 1e-5


def _distances(row, room: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Squared distances of the pairs of two tiles, a block of rows at a time; within a tile each pair once. Rounding may leave
    those of equal vectors below 0. They are written to ``room`` if given, since fresh memory takes longer than the product."""
    x, y = tiles.matrix(row.l_data, row.l_n), tiles.matrix(row.r_data, row.r_n)
    ones = lambda v: np.ones((len(v), 1))
    squares = lambda v: (v * v).sum(1, keepdims=True)
    left, right = np.hstack([-2.0 * x, squares(x), ones(x)]), np.hstack([y, ones(y), squares(y)]).T
    for start in range(0, len(x), MMD_BLOCK):
        part = left[start : start + MMD_BLOCK]
        d = np.matmul(part, right, out=None if room is None else room[: len(part) * len(y)].reshape(len(part), len(y)))
        yield d[np.arange(len(y)) > np.arange(start, start + len(d))[:, None]] if row.l_tile == row.r_tile else d.ravel()


def _bits(value: float) -> int:
    """Bit pattern of a float that is not negative; both have the same order."""
    return int(np.float64(value).view(np.int64))


def _value(bits: int) -> float:
    return float(np.int64(bits).view(np.float64))


def mmd2(x: DataFrame, y: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Unbiased MMD^2 with an RBF kernel and the exact median of all off-diagonal squared distances.

    Distances never leave their task. Passes over all pairs count those below and inside a bracket of bit patterns for each
    middle rank; a histogram narrows a bracket until at most LISTED distances lie in it, which are counted by value. Once
    brackets are that narrow, the pass also sums the kernels and their derivatives by the bandwidth, which carry the sums to
    the exact median: the error of a kernel is below NARROW squared. The first bracket comes from a few vectors. It decides only how
    many passes there are: ranks outside of it are found in a wider one.
    """
    sides = x.select(id_col, vec_col, F.lit(0).alias("_s")).unionByName(y.select(id_col, vec_col, F.lit(1).alias("_s")))
    packed = tiles.pack_vectors(sides.filter("_s = 0"), id_col, vec_col, MMD_ROWS).withColumn("side", F.lit(0)).unionByName(
        tiles.pack_vectors(sides.filter("_s = 1"), id_col, vec_col, MMD_ROWS).withColumn("side", F.lit(1)))
    packed = packed.withColumn("tile", F.col("tile") * 2 + F.col("side"))
    pairs = tiles.self_pairs(packed.select("tile", "side", "n", "data"))
    sizes = {r["_s"]: r["n"] for r in sides.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    m, n = sizes.get(0, 0), sizes.get(1, 0)
    if m < 2 or n < 2:
        raise ValueError("mmd2 needs at least two vectors on each side")
    total = (m + n) * (m + n - 1) // 2
    ranks = [(total - 1) // 2, total // 2]

    def measured(brackets: list[tuple[int, int]], shift: int | None, gamma: float | None) -> pd.DataFrame:
        """Counts (kind, bracket, key, c): distances below each bracket, and inside by cell, or by value without ``shift``;
        with ``gamma`` the sums s of the kernels by kind of pair and derivative."""

        def run(batches):
            below, inside, sums = np.zeros(len(brackets), np.int64), [{} for _ in brackets], np.zeros((3, 2))
            cells = np.zeros((len(brackets), CELLS), np.int64) if shift is not None else None
            ends = [(_value(lo) if lo else -math.inf, _value(hi)) for lo, hi in brackets]
            room, scaled, kernel = (np.empty(MMD_BLOCK * MMD_ROWS) for _ in range(3))
            low, within = (np.empty(MMD_BLOCK * MMD_ROWS, bool) for _ in range(2))
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    for d in _distances(row, room):
                        for i, (lo, hi) in enumerate(ends):
                            under, found = np.less(d, lo, out=low[: len(d)]), np.less(d, hi, out=within[: len(d)])
                            below[i] += np.count_nonzero(under)
                            if not np.not_equal(under, found, out=found).any():
                                continue
                            values = (np.maximum(d[found], 0.0) + 0.0).view(np.int64)  # no negative zero
                            if cells is not None:
                                cells[i] += np.bincount((values - brackets[i][0]) >> shift, minlength=CELLS)
                            else:
                                for v, c in zip(*map(np.ndarray.tolist, np.unique(values, return_counts=True))):
                                    inside[i][v] = inside[i].get(v, 0) + c
                        if gamma is not None:
                            t = np.multiply(d, -gamma, out=scaled[: len(d)])
                            k = np.exp(t, out=kernel[: len(d)])
                            sums[row.l_side + row.r_side] += k.sum(), np.dot(t, k) / gamma
            rows = [("below", i, 0, int(c), 0.0) for i, c in enumerate(below)]
            rows += [("sum", kind, order, 0, float(v)) for (kind, order), v in np.ndenumerate(sums)]
            if cells is not None:
                rows += [("in", int(i), int(at), int(cells[i, at]), 0.0) for i, at in zip(*np.nonzero(cells))]
            else:
                rows += [("in", i, v, c, 0.0) for i, held in enumerate(inside) for v, c in held.items()]
            yield pd.DataFrame(rows, columns=["kind", "i", "key", "c", "s"])

        out = pairs.mapInPandas(run, "kind string, i int, key long, c long, s double")
        return out.groupBy("kind", "i", "key").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).toArrow().to_pandas()  # CELLS or LISTED rows a bracket

    few = np.array([r[0] for r in sides.orderBy(F.xxhash64(F.col(id_col).cast("string"), "_s")).limit(1024).select(vec_col).collect()], float)
    near = np.concatenate([np.maximum(d, 0.0) for d in _distances(SimpleNamespace(l_data=few.tobytes(), r_data=few.tobytes(), l_n=len(few), r_n=len(few), l_tile=0, r_tile=0))])
    near, share = near[np.isfinite(near)], 0.5 / math.sqrt(len(few))
    everything = (0, _bits(math.inf))
    held = [everything] * 2
    if len(near):
        lower, upper = np.quantile(near, [0.5 - share, 0.5 + share])
        held = [(_bits(lower), _bits(upper) + 1)] * 2
    listed, middles = total <= LISTED, []
    while len(middles) < 2:
        brackets = sorted(set(held))
        shift = None if listed else max(0, max(hi - lo - 1 for lo, hi in brackets).bit_length() - CELLS.bit_length() + 1)
        middle = sum((_value(lo) + _value(hi - 1)) / 2 for lo, hi in held) / 2 + 1e-12
        narrow = listed and all(_value(hi - 1) - _value(lo) <= NARROW * middle for lo, hi in brackets)
        found = measured(brackets, shift, 1.0 / middle if narrow else None)
        below = dict(zip(found.i[found.kind == "below"], found.c[found.kind == "below"]))
        inside = found[found.kind == "in"].sort_values(["i", "key"])
        middles, crowd = [], 0
        for k, rank in enumerate(ranks):
            lo, hi = held[k]
            i = brackets.index(held[k])
            mine = inside[inside.i == i]
            upto = below[i] + mine.c.cumsum().to_numpy()
            at = int(np.searchsorted(upto, rank, "right"))
            if below[i] <= rank and at < len(upto):
                lo = int(mine.key.iloc[at]) if shift is None else lo + (int(mine.key.iloc[at]) << shift)
                held[k] = lo, min(lo + (1 << (shift or 0)), hi)
                crowd += int(mine.c.iloc[at])
            elif held[k] != everything:  # the rank is outside of the bracket
                held[k], crowd = everything, total
            else:  # not even there: the middle distance is no number
                middles.append(math.nan)
            if held[k][1] - held[k][0] == 1:
                middles.append(_value(held[k][0]))
        listed = crowd <= 2 * LISTED
    median = sum(middles) / 2
    gamma = 1.0 / (median + 1e-12)
    if not narrow:
        middle, found = median + 1e-12, measured([], None, gamma)
    sums = found[found.kind == "sum"].pivot(index="i", columns="key", values="s").to_numpy()
    step = gamma - 1.0 / middle
    xx, xy, yy = sums @ [1.0, step]
    value = 2.0 * xx / (m * (m - 1)) + 2.0 * yy / (n * (n - 1)) - 2.0 * xy / (m * n)
    return x.sparkSession.range(1, numPartitions=1).select(
        F.round(F.lit(float(max(value, 0.0))), 6).alias("mmd2"), F.round(F.lit(1.0 / gamma), 6).alias("bandwidth"))
