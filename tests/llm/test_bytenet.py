"""The network against plain loops and numeric gradients, held-out accuracy, and awkward rows."""

import numpy as np
import pytest

from evalspark.llm import bytenet, queries

SF = "/root/testdata/sf0.1"


def plain_score(network, text):
    """One text by the definition, filter by filter and place by place."""
    data = text.encode()
    starts = [0]
    while starts[-1] + bytenet.CHUNK < len(data):
        starts.append(starts[-1] + bytenet.CHUNK - bytenet.OVERLAP)
    total, weight = np.zeros(bytenet.FILTERS), 0
    for start in starts:
        held = data[start: start + bytenet.CHUNK]
        vectors = network.embed[np.frombuffer(held.ljust(bytenet.CHUNK, b"\0"), np.uint8)].astype(np.float64)
        windows = np.stack([vectors[p: p + bytenet.WIDTH].reshape(-1) for p in range(0, bytenet.CHUNK - bytenet.WIDTH + 1, bytenet.STRIDE)])
        total += np.maximum((windows @ network.filters).max(axis=0) + network.bias, 0) * max(len(held), 1)
        weight += max(len(held), 1)
    hidden = np.maximum(total / weight @ network.dense + network.dense_bias, 0)
    return 1 / (1 + np.exp(-(hidden @ network.out + network.out_bias)[0]))


def random_network(seed):
    network, rng = bytenet.Network.new(seed), np.random.default_rng(seed)
    network.out += rng.standard_normal(bytenet.HIDDEN).astype(np.float32)
    network.dense_bias += 0.1
    return network


TEXTS = ["", "a", "x" * 1023, "y" * 1024, "z" * 1025, "Üñï " * 900, "one two\n" * 5_000, "\0", "q" * 1984 + "end"]


def test_against_plain_loops():
    network = random_network(3)
    raw = [t.encode() for t in TEXTS]
    found = bytenet.scores(network, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(found, [plain_score(network, t) for t in TEXTS], atol=1e-5)


def test_every_byte_is_covered():
    offsets = np.cumsum([0, 0, 1, 64, 65, 960, 1023, 1024, 1025, 1984, 1985, 100_000])
    starts, held, row, each = bytenet.chunked(np.zeros(offsets[-1], np.uint8), offsets)
    for r, (a, b) in enumerate(zip(offsets, offsets[1:])):
        seen = np.zeros(b - a + 1, bool)
        for s, h in zip(starts[row == r], held[row == r]):
            assert s >= a and s + h <= b and (h > bytenet.OVERLAP or each[r] == 1)
            seen[s - a: s - a + h] = True
        assert seen[: b - a].all()


def test_gradients():
    network, rng = random_network(1), np.random.default_rng(1)
    chunks = rng.integers(97, 105, (7, bytenet.CHUNK)).astype(np.uint8)
    each, label, weight = np.array([2, 1, 4]), np.array([0, 1, 1]), np.array([1.0, 0.5, 0.5])

    def loss():
        pooled = network.pooled(chunks)
        features = np.stack([p.mean(axis=0) for p in np.split(pooled, np.cumsum(each)[:-1])])
        p = network.probability(features)
        return float((-(label * np.log(p) + (1 - label) * np.log(1 - p)) * weight).sum() / 3)

    grads = bytenet._gradients(network, chunks, each, label, weight)
    for w, g in zip(network.weights(), grads):
        assert w.shape == g.shape
        for at in np.argsort(-np.abs(g).reshape(-1))[:3]:
            place, step = np.unravel_index(at, w.shape), 2e-3
            kept = w[place]
            w[place] = kept + step
            up = loss()
            w[place] = kept - step
            down = loss()
            w[place] = kept
            assert (up - down) / (2 * step) == pytest.approx(g[place], rel=0.1, abs=2e-4)


def test_held_out(spark):
    out = queries.QUERIES["op11_byte_network"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 800 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if r.quality) / sum(r.quality for r in held) > 0.97
    assert sum(not r.predicted for r in held if not r.quality) / sum(not r.quality for r in held) > 0.88


def test_labels_that_are_held_out_are_not_read(spark):
    """Turning the held-out labels around changes no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    turned = known.unionByName(labels.where("crc32(cast(doc_id as string)) % 4 = 2").selectExpr("doc_id", "1 - quality as quality", "toxic"))
    fits = [bytenet.fit(docs, x.where("crc32(cast(doc_id as string)) % 4 <> 2"), steps=20) for x in (labels, turned)]
    assert all(np.array_equal(a, b) for a, b in zip(fits[0].weights(), fits[1].weights()))


def test_awkward_rows(spark):
    texts = ["good plain words here", None, "", "### $$$ ***", "ok " * 40_000, "%%% &&&", "fine"]
    docs = spark.createDataFrame([(i, t, "a", 7, b"x") for i, t in enumerate(texts * 3)] + [(0, "good plain words here", "b", 1, None)], "doc_id long, text string, score string, hash long, parts binary")
    labels = spark.createDataFrame([(i, int("#" not in (t or "") and "%" not in (t or "")), None) for i, t in enumerate(texts * 3)] + [(0, None, 1), (None, 1, 1), (0, 7, 0)], "doc_id long, quality int, toxic int")
    network = bytenet.fit(docs, labels, steps=60)
    out = bytenet.score(docs, network).collect()
    assert len(out) == len(texts) * 3 + 1 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert {r.predicted for r in out if r.text == "### $$$ ***"} == {0}
    assert bytenet.score(docs.limit(0), network).count() == 0
    nothing = bytenet.fit(docs, labels.limit(0))
    assert {r.score for r in bytenet.score(docs, nothing).collect()} == {0.5}
    bytenet.fit(docs, labels.where("quality = 1"), steps=5)
    assert bytenet.sample(docs, labels, max_rows=1).count() == 2
