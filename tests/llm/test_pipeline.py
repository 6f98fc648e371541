"""Every stage of the pipeline against a plain recount on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from evalspark.llm import bpe
from evalspark.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """Input of every stage, and the last result."""
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_whole_rows(spark, kept):
    columns = kept[0].columns
    original = {r.doc_id: r for r in kept[0].collect()}
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == columns and set(ids(after)) <= set(ids(before))
        assert all(r == original[r.doc_id] for r in after.collect())


def test_toxic_and_poor_documents_go(spark, kept):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for stage, bad in ((1, lambda x: x.toxic == 1), (2, lambda x: x.quality == 0)):
        before, after = set(ids(kept[stage - 1])), set(ids(kept[stage]))
        marked = [i for i in before if i in labels and bad(labels[i])]
        clean = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
        assert sum(i not in after for i in marked) >= 0.9 * len(marked)
        assert sum(i in after for i in clean) >= 0.95 * len(clean)


def test_one_document_of_each_group_stays(kept):
    sets = {}
    for r in kept[2].collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    holders, up = {}, {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, j in {(a, b) for g in holders.values() for a in g for b in g if a < b}:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert ids(kept[3]) == sorted(i for i in up if root(i) == i)


def test_mixing_moves_towards_the_targets(kept):
    def shares(df):
        count = {}
        for r in df.collect():
            count[r.lang] = count.get(r.lang, 0) + len(r.text.split())
        return {k: v / sum(count.values()) for k, v in count.items()}

    before, after = shares(kept[3]), shares(kept[4])
    assert len(ids(kept[4])) == len(set(ids(kept[4]))) >= 0.75 * len(ids(kept[3])) and after["en"] < before["en"]


def test_encoding(kept):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    out = kept[5].collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert list(bpe.unpacked(r.ids)) == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, kept):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept[5])


def test_encoding_and_decoding_are_apart(spark):
    """A task runs one Python worker: what the stage returns only decodes, and decoding holds no encoder."""
    docs = spark.createDataFrame([(1, "en", "web", "one two three"), (2, "de", "web", None)], "doc_id long, lang string, source string, text string")
    out = corpus_pipeline.encoded(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].decoded_sha256 == hashlib.sha256(b"one two three").hexdigest() and rows[2].n_tokens == 0
    words = bpe.vocabulary.__wrapped__("byte_bpe_50k.tiktoken")
    assert words.decode([0, 1]) and "encoder" not in vars(words)
