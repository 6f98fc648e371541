"""Rates against a plain solver, and the totals that they give."""

import numpy as np
import pytest

from evalspark.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def plain(n, p, targets, mu, max_rate, steps=20_000):
    n = n / n.sum()
    w, size = np.ones(len(n)).clip(0, max_rate), 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1] + mu)
    for _ in range(steps):
        w = np.clip(w - size * (p @ ((n * w) @ p - targets) + mu * (w - 1)), 0, max_rate)
    return w


@pytest.mark.parametrize("max_rate", [float("inf"), 1.0, 1.2])
def test_solution(spark, max_rate):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n long, p array<double>").repartition(3)
    found = mixing.solve(members, [0.6, 0.3, 0.1], mu=1e-3, max_rate=max_rate, max_steps=200, tolerance=1e-6)
    want = plain(n, p, found.targets, 1e-3, max_rate)
    got = found.rates(p)
    share = n / n.sum()
    cost = lambda w: 0.5 * np.sum(((share * w) @ p - found.targets) ** 2) + 0.5e-3 * np.sum(share * (w - 1) ** 2)
    assert found.converged and cost(got) <= cost(want) * 1.01 + 1e-9
    assert np.abs((share * got) @ p - (share * want) @ p).max() < 1e-3
    assert np.abs((n * got) @ p / n.sum() - found.targets - found.misses).max() < 1e-6
    assert got.min() >= 0 and got.max() <= max_rate


def test_query(spark):
    out = queries.QUERIES["op9_soft_mixing"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    assert np.mean([r.domain == r.lang for r in out if r.n_tokens > 30]) > 0.9
    tokens = sum(r.n_tokens for r in out)
    for lang, share in queries.TARGETS.items():
        got = sum(r.n_tokens * r.rate for r in out if r.domain == lang) / tokens
        assert abs(got - share) < 0.06, (lang, got)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, None, "y", 9), (3, "", None, 9), (4, "d e f " * 5000, "y", 9)], "doc_id long, text string, lang string, rate int")
    labels = spark.createDataFrame([(1,), (4,), (None,)], "doc_id long")
    rows = mixing.labelled(docs, labels, "lang")
    out, found = mixing.mix_to_targets(docs, rows, {"x": 1.0, "y": 1.0, "z": 1.0})
    got = out.collect()
    assert len(got) == 5 and len({(r.rate, r.copies) for r in got if r.doc_id == 1}) == 1 and found.misses[2] < -0.3
    assert [r.n_tokens for r in got if not r.text] == [0, 0]
    assert mixing.mix_to_targets(docs.limit(0), rows.limit(0), {"x": 1.0})[0].count() == 0


@pytest.mark.parametrize("rare", [0, 2])
def test_rare_domains_leave_the_others_alone(spark, caplog, rare):
    """A domain that is absent, or has a thousandth of the tokens, does not decide how much of the corpus stays."""
    rows = [(i, "the cat sat on the mat " * 10, "en") for i in range(2000)] + [(3000 + i, "der hund lag auf dem sofa " * 10, "de") for i in range(rare)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 20 or doc_id >= 3000").select("doc_id")
    out, found = mixing.mix_to_targets(docs, mixing.labelled(docs, labels, "lang"), ["de", "en", "fr"], max_rate=1.0)
    got = out.collect()
    assert sum(r.rate for r in got) > 0.99 * len(got) and min(r.rate for r in got if r.lang == "de" or not rare) > 0.95
    assert found.targets[2] == 0 and (found.targets[0] > 0) == (rare > 0)
    assert ("domain de" in caplog.text) == (rare > 0)  # has half of its target, and the miss is reported


@pytest.mark.parametrize("natural", [0.005, 0.0005])
def test_rare_domains_reach_their_targets(spark, natural):
    """A domain of a two-thousandth of all tokens comes to a fifth of them, and the fit says that it has settled."""
    rng = np.random.default_rng(5)
    rare = int(40_000 * natural)
    kind = np.concatenate([np.zeros(24_000, int), np.ones(16_000 - rare, int), np.full(rare, 2)])
    p = np.full((40_000, 3), 0.0001)
    p[np.arange(40_000), kind] = 0.9998
    n = rng.integers(50, 150, 40_000)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n long, p array<double>").repartition(4)
    found = mixing.solve(members, [0.5, 0.3, 0.2])
    assert found.converged and np.abs(found.misses).max() < 0.005
    assert abs((n * found.rates(p)) @ p[:, 2] / n.sum() - 0.2) < 0.005


@pytest.mark.parametrize("max_rate", [float("inf"), 1.0])
def test_rates_are_the_optimum(spark, max_rate):
    """Domains that are hard to tell apart, and rates that meet a bound: the fit ends at the least cost, not where steps get small."""
    rng = np.random.default_rng(7)
    p = np.column_stack([0.45 + 0.01 * rng.standard_normal(4000), np.full(4000, 0.1)])
    p = np.column_stack([p, 1 - p.sum(1)])
    n = rng.integers(50, 150, 4000)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n long, p array<double>").repartition(4)
    found = mixing.solve(members, [0.48, 0.1, 0.42], max_rate=max_rate)
    w, share, mu = found.rates(p), n / n.sum(), mixing.MU
    misses = (share * w) @ p - found.targets
    cost = 0.5 * misses @ misses + 0.5 * mu * share @ (w - 1) ** 2
    slope = p @ misses + mu * (w - 1)
    slope[((w == 0) & (slope > 0)) | ((w == max_rate) & (slope < 0))] = 0
    assert found.converged and np.abs(misses - found.misses).max() < 1e-9
    assert share @ slope**2 / (2 * mu) < 0.01 * cost  # the cost is strongly convex: it is at most this far from the least
