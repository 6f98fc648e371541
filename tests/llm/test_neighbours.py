"""Recall and exactness of scores against brute force."""

import math

import numpy as np
import pytest

from evalspark.llm import neighbours, queries


def brute(rows, k, is_query):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    length = max((len(v) for _, v in rows), key=[len(v) for _, v in rows].count, default=0)
    rows = [r for r in rows if len(r[1]) == length]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if is_query(i):
            s = x @ v
            out[i] = [(int(ids[j]), float(s[j])) for j in sorted(np.flatnonzero(ids != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def check(found, want, least):
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    hits = total = 0
    for q, pairs in want.items():
        mine = got.get(q, [])
        assert len(mine) == len(pairs) and q not in [i for i, _ in mine]
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(mine, mine[1:]))
        hits += len({i for i, _ in mine} & {i for i, _ in pairs})
        total += len(pairs)
    assert set(got) == set(want) and hits >= least * total, hits / max(1, total)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = queries.QUERIES["op3_projected_neighbours"](spark, path).collect()
    check(found, brute(rows, 20, lambda i: i % 20 == 0), 0.9)
    lookup = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r.score - lookup[r.query_id] @ lookup[r.vec_id]) < 1e-12 for r in found)


def test_awkward_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [3.0, 1.0, 0.0, 0.0, 0.0, 2.0]) for i in range(150)]  # copies, and longer than the rest
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [1.0, 2.0]), (None, [1.0] * 6), (2100, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, cell int")
    is_query = lambda i: i % 20 == 0
    found = neighbours.nearest(df, is_query, k=20, cell_rows=40).collect()
    check(found, brute(rows, 20, is_query), 0.95)
    few = df.where("vec_id < 5")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few, is_query).orderBy("rank").collect()] == [(0, i) for i, _ in brute(rows[:5], 20, is_query)[0]]
    assert neighbours.nearest(df.limit(0), is_query).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), is_query).count() == 0
    assert neighbours.nearest(df.where("vec_id = 2020"), is_query).count() == 0


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 10) - 18.307038) < 1e-5
    assert abs(neighbours.chi_square_quantile(0.5, 2) - 1.386294) < 1e-5


def test_ties_go_to_the_smallest_ids(spark):
    """300 different vectors with the same product: the 20 smallest ids are found, whatever order they come in."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(a), float(b)]) for i, (a, b) in enumerate(((a, b) for a in range(-9, 10) for b in range(1, 17)), 1)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(3)
    found = neighbours.nearest(df, lambda i: i == 0, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21)) and {r.score for r in found} == {1.0}
