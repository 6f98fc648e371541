"""Maximal segments against a quadratic search, held-out accuracy, and awkward rows."""

import random

import numpy as np

from evalspark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def slow_segments(w):
    """The definition: the best contiguous run, then the same left and right of it."""
    if not len(w) or max(w) <= 0:
        return []
    best = None
    for i in range(len(w)):
        total = 0.0
        for j in range(i, len(w)):
            total += w[j]
            if best is None or total > best[2] + 1e-9:
                best = (i, j + 1, total)
    a, b, s = best
    return slow_segments(w[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in slow_segments(w[b:])]


def test_segments():
    for seed in range(200):
        rng = random.Random(seed)
        w = [rng.choice([-3, -2, -1, -0.5, 0.25, 1.125, 2.0625, 4.03125]) + rng.random() / 64 for _ in range(rng.randint(0, 25))]
        got = toxicity.maximal_segments(np.array(w))
        want = slow_segments(w)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_held_out(spark):
    out = queries.QUERIES["op2_toxic_segments"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.98
    assert sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held) > 0.9


def test_awkward_rows(spark):
    texts = ["you idiot " * 3 + "fine words here", None, "", " \n", "fine words here", "idiot!!", "fine " * 60_000, "plain things are fine", "other words", "idiot things"]
    docs = spark.createDataFrame([(i, t, 1.0, "en") for i, t in enumerate(texts * 3)], "doc_id long, text string, score double, passages string")
    labels = spark.createDataFrame([(i, None, int("idiot" in (t or ""))) for i, t in enumerate(texts * 3)] + [(None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(toxicity.labelled(docs, labels))
    out = toxicity.score(docs, m).collect()
    assert len(out) == len(texts) * 3 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score(docs.limit(0), m).count() == 0
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(toxicity.labelled(docs, few))).collect()} == {0}


def test_curve_is_the_maximum_where_whole_newton_steps_run_away():
    """Labels that evidence tells apart: whole steps ended at a slope of 0.05 and an offset of -10.9, so nothing was toxic."""
    x = np.array([0.0, 0.5, 22.0, 109.5, 52.5, 158.0])
    n = np.array([44243.0, 199.0, 707.0, 1242.0, 1410.0, 2248.0])
    hits = np.where(x > 50, n, 0.0)
    a, b = toxicity._logistic(x, hits, n)
    p = 1 / (1 + np.exp(-(a * np.log1p(x) + b)))
    assert ((p >= 0.5) == (x > 50)).all()
    z = np.log1p(x)
    assert abs(np.sum((hits - n * p) * z) - 1e-3 * a) < 1e-6 and abs(np.sum(hits - n * p) - 1e-3 * b) < 1e-6
