"""Base figures and log ratios against a plain recount in Python."""

import math
import re
from collections import Counter

import xxhash

from evalspark.llm import common, quality, queries

SF = "/root/testdata/sf0.001"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def slots(text, buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ones = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    twos = [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=a & (1 << 64) - 1))
            for a, b in zip((signed(xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed=42)) for x in ones), ones[1:])]
    return [h % buckets for h in ones] + [buckets + h % buckets for h in twos]


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op10_ngram_llr"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    raw, good, b = Counter(), Counter(), quality.BUCKETS
    for d in docs:
        raw.update(slots(d.text, b))
        if d.doc_id in trusted:
            good.update(slots(d.text, b))
    totals = [(sum(c for s, c in side.items() if s < b), sum(c for s, c in side.items() if s >= b)) for side in (raw, good)]
    ratio = lambda s: round(1e6 * (math.log((good[s] + 1) / (totals[1][s >= b] + b)) - math.log((raw[s] + 1) / (totals[0][s >= b] + b))))
    assert len(got) == len(docs)
    for d in docs:
        r, s, want = got[d.doc_id], slots(d.text, b), base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        llr = sum(map(ratio, s)) / len(s) / 1e6 if s else 0.0
        assert abs(r.llr - llr) < 1e-9 and r.kept == (not r.base_failed and llr >= quality.THRESHOLD)


def test_awkward_rows(spark):
    line = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \n\t ", "a", "a b", "w " * 30, f"{line}\n{line}\n\n{line} x", "é# * x " * 12, ("a b c d e f g h " * 2).strip(), "x " * 50_000, line, line]
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, llr string")
    labels = spark.createDataFrame([(0, 1, 0), (10, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
    assert quality.judge(docs.limit(0), labels).count() == 0
    nothing = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in nothing)


def test_every_trusted_document_counts(spark, monkeypatch):
    """50,001 trusted documents: the list was once cut at 50,000; a list too long for a broadcast gives the same counts."""
    labels = spark.range(50_001).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == 50_001
    docs = spark.range(60_000).selectExpr("id as doc_id", "'same' as text")
    for limit in (2_000_000, 10):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        assert [(r.raw, r.trusted) for r in quality.count_slots(docs, trusted).collect()] == [(60_000, 50_001)]
