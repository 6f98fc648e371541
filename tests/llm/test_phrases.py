"""Phrases against a plain count, summaries against their promise, and awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=2, most=3, threshold=10, share=50, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most + 1):
                count.update((lang, tuple(words[i: i + n])) for i in range(len(words) - n + 1))
    candidates = {key: f for key, f in count.items() if least <= len(key[1]) <= most and f >= threshold}
    covered = set()
    for (lang, p), f in candidates.items():
        for n in range(least, len(p)):
            for i in range(len(p) - n + 1):
                part = (lang, p[i: i + n])
                if 100 * f >= share * candidates[part]:
                    covered.add(part)
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, _, left, right = min((1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i): (p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, lang, text, 1, "f") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string")
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine(docs.repartition(3), **options).collect()}


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ÉTÉ", "é", "New", "york", "city", "x" * 300, "a-b", " ", " ", "日本", "z"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!?", "\x0b"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"threshold": 3, "top": 7}, {"most": 4, "threshold": 5, "share": 80}, {"least": 3, "most": 3, "threshold": 2}])
def test_against_plain_count(spark, options):
    rows = random_rows(len(options)) + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "only few words"), ("en", "new york city " * 40_000)]
    assert got(spark, rows, **options) == plain(rows, **options)


def test_small_parts(spark):
    """The same rows when every hash partition holds next to nothing."""
    rows = random_rows(5, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    some = {tuple(r) for r in phrases.frequent_ngrams(docs, threshold=4, part_bytes=200).collect()}
    assert some == {tuple(r) for r in phrases.frequent_ngrams(docs, threshold=4).collect()} and len(some) > 30


def test_empty(spark):
    assert got(spark, []) == {} and got(spark, [(None, None)]) == {}


def test_misra_gries_promise():
    """Whatever occurs as often as the threshold survives, in any order of the parts, within the capacity."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        stream = np.concatenate([rng.zipf(1.3, 3000) % 5000, rng.integers(5000, 9000, 4000), np.repeat(rng.integers(0, 9000, 20), 10)]).astype(np.uint32)
        rng.shuffle(stream)
        threshold = int(rng.integers(5, 40))
        summary = phrases.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, int(rng.integers(1, 30))):
            summary.add(*np.unique(part, return_counts=True))
        summary.settle()
        keys, counts = np.unique(stream, return_counts=True)
        assert len(summary.keys) <= summary.capacity and summary.cut < threshold
        assert set(keys[counts >= threshold]) <= set(summary.survivors(threshold))


def test_words_of_a_slice():
    """Arrow slices, empty texts at the borders and long words keep their places."""
    texts = pa.array(["zz", "", "a b", "b", "", "b a,b  a", None, "A B\nc"])
    langs = pa.array(["x", "x", "x", "y", "y", "y", None, "x"])
    words = phrases.Words(texts.slice(1), langs.slice(1))
    vocabulary = words.vocabulary.cast(pa.string()).to_pylist()
    assert [vocabulary[i] for i in words.ids] == ["a", "b", "b", "b", "a", "b", "a", "a", "b", "c"]
    grams = [{(words.langs[int(at)].as_py(), p): int(c) for at, p, c in zip(lang, words.phrases(tuples).cast(pa.string()).to_pylist(), counts)} for lang, tuples, counts in words.grams(2)]
    assert grams[1] == {("x", "a b"): 2, ("y", "b a"): 2}
    assert grams[0][("x", "a")] == 2 and grams[0][("y", "b")] == 3
