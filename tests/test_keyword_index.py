"""The inverted index against a plain count: ties, blocks that are left out, several segments, stored buckets."""

import random

import pytest

from evalspark.operators import keyword_index
from evalspark.session import work_dir


def plain(queries, chunks, k):
    out = {}
    for query_id, query in queries:
        asked = set((query or "").lower().split())
        found = []
        for chunk_id, content in chunks:
            words = (content or "").lower().split()
            hits = len(asked & set(words))
            if hits:
                found.append((-hits / (len(words) + 50), chunk_id))
        out[query_id] = [(c, -s) for s, c in sorted(found)[:k]]
    return {q: found for q, found in out.items() if found}


def made(seed, n=3_000):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 40 + ["Of", "É", "日本"]
    chunks = [(f"c{i:05d}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 30, 80])))) for i in range(n)]
    chunks += [("empty", ""), ("null", None), ("blank", " \n\t")] + [(f"same{i}", "the w1 w2") for i in range(300)]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(40)] + [(100, ""), (101, None), (102, "unknown words only"), (103, "the"), (104, "the w1 w2 w2")]
    return queries, chunks


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


@pytest.mark.parametrize("k", [1, 7, 400])
def test_search(spark, monkeypatch, k):
    queries, chunks = made(k)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    frame = spark.createDataFrame(chunks, "chunk_id string, content string")
    want = plain(queries, chunks, k)
    for parts in (1, 5):
        assert listed(keyword_index.search(asked, keyword_index.index_rows(frame.repartition(parts)), k).collect()) == want
    path = work_dir(spark, "index")
    keyword_index.write_index(frame.repartition(3), path)
    for some in (asked, asked.filter("query_id = 104"), asked.filter("query_id = 102"), asked.filter("query_id = 100")):
        ids = {r.query_id for r in some.collect()}
        assert listed(keyword_index.search(some, keyword_index.read_index(spark, path, some), k).collect()) == {q: f for q, f in want.items() if q in ids}


def test_postings(spark):
    """Only the query's own postings are read, and of a common word's only those in blocks that can win are scored."""
    chunks = [(i, " ".join(["the"] * (1 + i // 20) + [f"own{i}"])) for i in range(8_000)]
    frame = spark.createDataFrame(chunks, "chunk_id long, content string").coalesce(1)
    rows = keyword_index.search(spark.createDataFrame([(1, "the"), (2, "own77 own78"), (3, "the own4000")], "query_id long, query string"), keyword_index.index_rows(frame), 5).collect()
    by_query = {q: (r.read, r.scored) for r in rows for q in [r.query_id]}
    assert by_query[1][0] == 8_000 and by_query[1][1] <= 3 * keyword_index.BLOCK
    assert by_query[2] == (2, 2)
    assert by_query[3][0] == 8_001 and by_query[3][1] < 2_000


def test_empty(spark):
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    none = spark.createDataFrame([], "chunk_id string, content string")
    assert keyword_index.search(asked, keyword_index.index_rows(none), 3).collect() == []


def test_absent_words_count_for_nothing(spark):
    """Words that no chunk holds, whatever their hashes: one next to a word that is asked for was counted as that word."""
    chunks = spark.createDataFrame([("a", "one two three"), ("b", "two")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "two " + " ".join(f"absent{i}" for i in range(50)))], "query_id long, query string")
    rows = keyword_index.search(asked, keyword_index.index_rows(chunks.coalesce(1)), 5).collect()
    assert {(r.chunk_id, r.score) for r in rows} == {("a", 1 / 53), ("b", 1 / 51)}
