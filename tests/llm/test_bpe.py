"""Tree concatenation against the tokenizers library, over the given texts and over awkward ones."""

import hashlib
import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from evalspark.llm import bpe, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def awkward(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["a", "the", "ing", "'", "'s", "'ll", " ", "  ", "\n", "\t", "é", "日本", "🙂", "​", "12", "!!", "--", "<|endoftext|>", "<|end", "of", "text|>", "x" * 9, "́", "'re", " the"]
    weights = [rng.random() ** 2 for _ in parts]
    return "".join(rng.choices(parts, weights, k=n))


def test_joins_are_exact(library):
    v = bpe.vocabulary("byte_bpe_50k.tiktoken")
    for seed in range(400):
        rng, text = random.Random(seed), awkward(seed, 60)
        cuts = sorted(rng.sample(range(1, len(text)), 3))
        parts = [v.encode(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert bpe.join_all(parts, v) == library.encode(text, add_special_tokens=False).ids, (seed, text, cuts)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000 + "x", "x" + " " * 3000, "'ll" * 2000, "日" * 3000, "thestinger" * 700, "9" * 4001])
def test_long_runs(library, text):
    v = bpe.vocabulary("byte_bpe_50k.tiktoken")
    parts = [v.encode(text[k : k + 501]) for k in range(0, len(text), 501)]
    assert bpe.join_all(parts, v) == library.encode(text, add_special_tokens=False).ids


def test_operator(spark, library):
    texts = [None, "", "a", awkward(1, 900), "thing" * 400, "a b " * 300, "<|endoftext|>" * 50, "a b " * 300]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _x int")
    for chars in (7, 64, 10_000):
        out = bpe.decode(bpe.encode(docs, piece_chars=chars)).collect()
        assert len(out) == len(texts)
        for r in out:
            want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert list(bpe.unpacked(r.ids)) == want and r.n_tokens == len(want)
            assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query(spark, library):
    out = {r.doc_id: r for r in queries.QUERIES["op5_tree_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert out[d.doc_id].n_tokens == len(ids)
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_rows_that_are_dealt_anew(spark, library):
    """Long texts keep their own ids on unstored input that is dealt round, also beside columns named like the helpers."""
    rows = [(i, f"document {i} " + f"w{i} " * 300, i, -i) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _piece long").repartition(7)
    for r in bpe.decode(bpe.encode(docs, piece_chars=256)).collect():
        assert r.decoded == rows[r.doc_id][1] and (r["_row"], r["_piece"]) == (r.doc_id, -r.doc_id)
