"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words are runs without white space. Word unigrams and bigrams are hashed into ``buckets`` slots each; two multinomials
over the slots are counted, one over documents with a trusted label and one over the whole corpus. A document's score
is the mean log ratio of its n-grams, and every document is kept or dropped by the same fixed threshold.

The ratios are rounded to whole millionths, so a sum does not depend on its order and verdicts are repeatable.
Counting folds n-grams in the map tasks: at most ``2 * buckets`` rows leave each of them and reach the driver. Both sides
count every document they have; the list of trusted ids is broadcast only while it is short (``common.join_ids``).

Edge cases. A null text has no words. Texts below the base rules are dropped whatever their score. Without any trusted
document all ratios are 0, and so is the score of a text without words. Repeated rows are judged, and counted, each
on their own. Columns other than doc_id and text pass through; ``score_documents`` replaces columns of its own names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE, join_ids

BUCKETS = 1 << 13
THRESHOLD = -0.08
PRIOR = 1.0
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _pair_up(hashes: Column, step: int) -> Column:
    """Hashes of the elements ``step`` apart; the last ``step`` of them have no partner and mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _first(array: Column, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def repeated_span(windows: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more; ``windows`` holds one hash per position."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(a: Column) -> Column:
        same = F.transform(a, lambda x, i: F.when(
            (F.get(a, i - 1)["h"] == x["h"]) | (F.get(a, i + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.array_compact(same))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(by_hash, twins), covered))


def base_rules(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the hash arrays _h1 and _h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.col("n_words").cast("int")

    def hashed(words: Column) -> Column:
        ones = F.transform(words, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(words).alias("n"), F.char_length(F.array_join(words, "")).alias("chars"), ones.alias("h1"))

    def rows(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_w", "_h1", "_h2", "_h4", "_h8", "_windows"]
    rest = docs.drop(*own)
    counted = rest.select(
        "*", let(words_of(F.col("text")), hashed).alias("_w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), rows).cast("long").alias("n_dup_lines"))
    paired = counted.select(
        *rest.columns, "n_symbols", "n_dup_lines", F.col("_w.n").cast("long").alias("n_words"), F.col("_w.chars").cast("long").alias("word_chars"),
        F.col("_w.h1").alias("_h1"), let(F.col("_w.h1"), lambda a: _pair_up(a, 1)).alias("_h2"))
    # Hashes of 2, 4 and 8 words; each array is used more than once, so the planner keeps it as a column.
    eights = paired.withColumn("_h4", _pair_up(F.col("_h2"), 2)).withColumn("_h8", _pair_up(F.col("_h4"), 4))
    windows = eights.withColumn("_windows", _first(F.col("_h8"), n - (WINDOW - 1)))
    repeats = windows.withColumn("n_repeat_words", repeated_span(F.col("_windows")).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return repeats.select(
        *rest.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_h1", "_h2")


def _slots(hashes: Column, buckets: int, offset: int = 0) -> Column:
    return F.transform(hashes, lambda h: (F.pmod(h, F.lit(buckets)) + offset).cast("int"))


def count_slots(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(slot, raw, trusted): how often each slot occurs in all documents, and in the trusted ones."""
    marked = join_ids(docs.select("doc_id", "text"), trusted_ids.withColumn("good", F.lit(1)), "doc_id", "left")
    grams = let(
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)),
        lambda a: F.concat(_slots(a, buckets), _slots(_first(_pair_up(a, 1), F.size(a) - 1), buckets, buckets)))
    slots = marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(grams).alias("slot"))
    return slots.groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("trusted"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that every label row calls good and none calls toxic."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id")


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[int]:
    """Log ratio of every slot in millionths: unigram slots, then bigram slots."""
    raw, good = [0] * (2 * buckets), [0] * (2 * buckets)
    for row in counts.collect():  # at most 2 * buckets rows
        raw[row["slot"]], good[row["slot"]] = row["raw"], row["trusted"]
    out: list[int] = []
    for a, b in ((0, buckets), (buckets, 2 * buckets)):
        n_good, n_raw = sum(good[a:b]), sum(raw[a:b])
        out += [
            round(1e6 * (math.log((g + prior) / (n_good + prior * buckets)) - math.log((r + prior) / (n_raw + prior * buckets)))) if n_good else 0
            for g, r in zip(good[a:b], raw[a:b])]
    return out


def score_documents(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Add the base columns, ``llr`` (mean log ratio of a document's n-grams) and ``kept``."""
    buckets = len(ratios) // 2
    numbers = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folded to a constant by the planner

    def total(hashes: Column, offset: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.get(numbers, (F.pmod(h, F.lit(buckets)) + offset).cast("int")))

    n = F.col("n_words").cast("int")
    sums = total(F.col("_h1"), 0) + total(_first(F.col("_h2"), n - 1), buckets)
    grams = F.greatest(2 * n - 1, F.lit(0))
    based = base_rules(docs.drop("llr", "kept"))
    scored = based.select("*", F.when(grams > 0, sums / grams / 1e6).otherwise(0.0).alias("llr")).drop("_h1", "_h2")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its base figures, score and verdict; ratios come from these documents and labels."""
    counts = count_slots(docs.select("doc_id", "text"), trusted_ids(labels), buckets)
    return score_documents(docs, log_ratios(counts, buckets), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns.

    The row number is there for the planner alone: without it the filter would be pushed below the projections, which
    would work out the hash arrays again for every use of them in the condition.
    """
    judged = judge(docs, labels, **options).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*docs.columns)
