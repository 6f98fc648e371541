"""Edge cases, brute-force comparisons and skew on small fixtures."""

import base64
import collections
import difflib
import itertools
import json
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions import chat
from evalspark.operators import curate, documents, experiments, graders, labels, normalize, quantize, ranking, retrieval, rollups, sequences, tables, textstats


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


# --- exact ranks and ordered scans under skew ---------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, half of its values are equal."""
    rng = random.Random(3)
    rows = [("hot", i, 5.0 if i % 2 else round(rng.random() * 100, 3)) for i in range(6000)]
    rows += [(f"k{i % 7}", 10_000 + i, round(rng.random() * 100, 3)) for i in range(300)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, id long, v double").repartition(5)


def by_key(rows):
    out = collections.defaultdict(list)
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out[k].append((i, v))
    return out


def test_nearest_rank_is_exact(skewed):
    rows, df = skewed
    got = {r["key"]: r for r in ranking.nearest_rank(df, ["key"], "v", {"p50": 50, "p99": 99}).collect()}
    for key, items in by_key(rows).items():
        xs = sorted(v for _, v in items)
        assert got[key]["p50"] == xs[int(round(0.5 * (len(xs) - 1)))]
        assert got[key]["p99"] == xs[int(round(0.99 * (len(xs) - 1)))]


def test_bracketed_ranks_equal_full_ranks(skewed):
    rows, df = skewed
    # a coarse sketch forces the bracket path for the hot key
    ranks = {"m": (0.5, F.floor((F.col("n") - 1) / 2))}
    got = {r["key"]: r["m"] for r in ranking.values_at_ranks(df, ["key"], "v", ranks, accuracy=400).collect()}
    for key, items in by_key(rows).items():
        xs = sorted(v for _, v in items)
        assert got[key] == xs[(len(xs) - 1) // 2]


def test_lowest_per_key_with_large_quota(skewed):
    rows, df = skewed
    kept = ranking.lowest_per_key(df, ["key"], "id", 2500).groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("m")).collect()
    expect = by_key(rows)
    for r in kept:
        ids = [i for i, _ in expect[r["key"]]][:2500]
        assert (r["n"], r["m"]) == (len(ids), ids[-1])


def test_ordered_scans_match_plain_windows(skewed):
    rows, df = skewed
    numbered = {(r["key"], r["id"]): r["rn"] for r in ranking.numbered(df, ["key"], ["id"]).collect()}
    lagged = {(r["key"], r["id"]): r["prev_v"] for r in ranking.with_previous(df, ["key"], ["id"], ["v"]).collect()}
    top = {(r["key"], r["id"]): r["top"] for r in ranking.running_max(df, ["key"], ["id"], "v", "top").collect()}
    for key, items in by_key(rows).items():
        best = None
        for n, (i, v) in enumerate(items):
            assert numbered[key, i] == n + 1
            assert lagged[key, i] == (items[n - 1][1] if n else None)
            assert top[key, i] == best
            best = v if best is None else max(best, v)


def test_running_best_accepts_like_a_loop(skewed):
    rows, df = skewed
    got = collections.defaultdict(list)
    for r in sequences.running_best(df, "key", "id", "v", 3.0).collect():
        got[r["key"]].append(r["v"])
    for key, items in by_key(rows).items():
        best, accepted = None, []
        for _, v in items:
            if best is None or v > best + 3.0:
                best = v
                accepted.append(v)
        assert sorted(got[key]) == accepted


@pytest.mark.parametrize("n", [0, 5, 1_000, 1_500, 9_999])
def test_first_rows_of_any_number(skewed, n):
    rows, df = skewed
    got = sorted((r["v"], r["id"]) for r in ranking.first_rows(df, ["v", "id"], n).collect())
    assert got == sorted((r["v"], r["id"]) for r in df.collect())[:n]


def test_running_best_of_a_rising_log(spark):
    """Every row is a record; nothing is gathered per log, and the path of 2,500 rows takes some twelve rounds."""
    df = spark.range(20_000).selectExpr("'a' as key", "id", "id * 1.0D as v").unionByName(spark.range(3).selectExpr("'b' as key", "id", "case id when 1 then null else 5.0D end as v"))
    got = sequences.running_best(df, "key", "id", "v", 7.0).collect()
    assert sorted((r["key"], r["id"]) for r in got) == [("a", i) for i in range(0, 20_000, 8)] + [("b", 0)]
    with pytest.raises(ValueError):
        sequences.running_best(df, "key", "id", "v", -1.0)


def test_dedup_is_idempotent_and_partition_free(skewed):
    _, df = skewed
    hashed = df.select("id", "key", F.col("v").cast("string").alias("content_hash"), F.lit(0).alias("source_rank"))
    once = {r["id"] for r in curate.dedup_content(hashed).collect()}
    assert once == {r["id"] for r in curate.dedup_content(hashed.repartition(1)).collect()}
    again = curate.dedup_content(curate.dedup_content(hashed))
    assert once == {r["id"] for r in again.collect()}


# --- text -----------------------------------------------------------------------------------------------

TEXTS = [
    "", "short", "a" * 13 + " and then nothing special happens here", "one two three four five six seven eight " * 6, "bell \x07\x07 and � marks in a line",
    "plain words that go on and on without any loop at all, nothing to see", "leak <|im_start|>user hello there", "x\ny\r\nz and some more text to pass ten",
]


FLAGS = [["empty"], ["empty"], ["char run x13"], ["8-gram loop x6"], ["weird chars"], [], ["template leakage"], []]


def test_degenerate_flags(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r["id"]: r["flags"] for r in textstats.degenerate_flags(df, "text").collect()}
    assert got == dict(enumerate(FLAGS))
    packed = spark.createDataFrame([("ab cd ef " * 400,)], "text string")
    assert textstats.degenerate_flags(packed, "text").first()["flags"] == ["8-gram loop x398", "compression"]


def test_sequence_ratio_and_line_jaccard(spark):
    pairs = [("a\nb\n", "b\r\na"), ("", ""), ("same", "same"), ("one\ntwo", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", textstats.sequence_ratio("a", "b").alias("r"), textstats.line_jaccard("a", "b").alias("j")).collect()
    for r in got:
        assert r["r"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio())
        la, lb = ({x.strip() for x in s.splitlines() if x.strip()} for s in (r["a"], r["b"]))
        assert r["j"] == pytest.approx(len(la & lb) / len(la | lb) if la | lb else 1.0)


def test_self_bleu_with_copies_matches_all_pairs(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 30))) for _ in range(40)] + ["a b c d e"] * 25 + ["tiny"] * 3
    grams = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    expect = np.mean([len(a & b) / len(a | b) if a | b else 0.0 for a, b in itertools.combinations(grams, 2)])
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    assert textstats.self_bleu(df, "id", "text").first()["self_bleu"] == pytest.approx(expect, abs=2e-6)


def test_overlapping_phrases_count_like_findall(spark):
    texts = ["go go go go", "it's not just it's not just a-b", "the void. The VOID! avoid the voids", "a b a b a", "not'tis 'tis", "well, no well,no well,", "", "x_y é éa -a- a-"]
    phrases = ["go go", "it's not just", "the void", "a b a", "a-b", "'tis", "well,", "é", "-", "-a", "x_y", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {(r["id"], r["phrase"]): r["hits"] for r in textstats.phrase_hits(df, "id", "text", table).collect()}
    for i, t in enumerate(texts):
        for p in phrases:
            assert got.get((i, p), 0) == len(re.findall(r"\b" + re.escape(p) + r"\b", t.lower()))


def test_mmd_matches_dense_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(37, 6)), rng.normal(0.4, 1, size=(23, 6))
    frame = lambda m, o: spark.createDataFrame([(o + i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, vec array<double>").repartition(3)
    both = np.vstack([x, y])
    d = ((both[:, None] - both[None]) ** 2).sum(2)
    gamma = 1.0 / (np.median(d[np.triu_indices(len(both), 1)]) + 1e-12)
    k = np.exp(-gamma * d)
    np.fill_diagonal(k, 0)
    m, n = len(x), len(y)
    expect = k[:m, :m].sum() / (m * (m - 1)) + k[m:, m:].sum() / (n * (n - 1)) - 2 * k[:m, m:].mean()
    assert textstats.mmd2(frame(x, 0), frame(y, 1000), "id", "vec").first()["mmd2"] == pytest.approx(max(expect, 0), abs=2e-6)


# --- picks ----------------------------------------------------------------------------------------------------

def test_pick_json(spark):
    cases = {
        'x ```json\n{"a": 1}\n``` y {"b": 2}': {"a": 1}, "text {broken {\"a\": [1, 2]} tail": {"a": [1, 2]}, "only [1, [2]] here": [1, [2]], "none": None, "": None,
        '{"s": "br{ace"} x': None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", documents.pick_json("t").alias("p")).collect():
        assert (json.loads(r["p"]["json"]) if r["p"]["json"] else None) == cases[r["t"]]
        assert (r["p"]["error"] is None) == (cases[r["t"]] is not None)


def test_last_envelope(spark):
    text = 'first {"stdout": "a"} then {"x": 1} and {"exit_code": 0, "stdout": "b\nc"} end'
    assert json.loads(one(spark, documents.last_envelope("t"), t=text))["stdout"] == "b\nc"
    assert one(spark, documents.last_envelope("t"), t="nothing {") is None


def test_decode_cases_refuses_pickles(spark):
    private = base64.b64encode(zlib.compress(json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}, {"input": "3", "output": "4"}]).encode())).decode()
    rows = [('[{"input": "1", "output": "2"}]', private), ("[]", base64.b64encode(b"\x80\x04K\x01.").decode())]
    out = documents.decode_test_cases(spark.createDataFrame(rows, "pub string, priv string"), "pub", "priv").collect()
    assert [[t["input"] for t in r["tests"]] for r in out] == [["1", "3"], []]


def test_json_path(spark):
    df = spark.createDataFrame([('```json\n{"shots": [{"p": "a"}, {"p": "7 apples"}], "n": 2.5, "ok": true}\n```',)], "t string")
    got = lambda path: documents.json_path_get(df, "t", path, "none 4").first()
    assert (got("shots[-1].p")["value_text"], got("shots.1.p")["value_int"]) == ("7 apples", 7)
    assert (got("n")["value_int"], got("n")["value_float"]) == (2, 2.5)
    assert (got("ok")["value_text"], got("ok")["value_float"]) == ("true", 1.0)
    assert (got("nope.x")["value_text"], got("nope.x")["ok"], got("nope.x")["value_int"]) == ("none 4", False, 4)
    assert df.select(documents.json_path_count("t", "shots").alias("a"), documents.json_path_count("t", "").alias("b"), documents.json_path_count("t", "n").alias("c")).first() == (2, 3, 0)


# --- graders and rewards ----------------------------------------------------------------------------------------

def test_number_and_fragments(spark):
    assert one(spark, graders.grade_number("o", "e", 0.5), o="first 3, total 1,234.", e=1234.4) == 1.0
    assert one(spark, graders.grade_number("o", "e"), o="no digits", e=1.0) == 0.0
    assert one(spark, graders.grade_none_of("o", F.array(F.lit("KEY")), False), o="my key is") == 0.0
    assert one(spark, graders.grade_all_of("o", F.array(F.lit("a"), F.lit("zz"))), o="abc") == 0.5


def test_function_calls(spark):
    schema = "expected array<struct<name:string,arguments:string>>, actual array<struct<name:string,arguments:string>>, allowed array<string>"
    weather = ("weather", '{"city": "Paris", "days": 3}')
    cases = [
        ([weather], [("weather", '{"city": " paris", "days": "3.001"}')], [], 1.0),
        ([weather], [("weather", '{"city": "Rome", "days": 3}'), ("weather", '{"city": "Paris"}')], [], 0.75),
        ([weather], [("now", "{}"), weather], ["now"], 1.0),
        ([weather], [("x", "{}")] * 6, [], 0.0),
        ([weather], [("x", "{}"), ("y", "{}"), weather], [], 0.9),
        ([], [], [], 1.0), ([], [weather], [], 0.0), ([("ping", "{}")], [("ping", "not json")], [], 1.0),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], schema).coalesce(1)
    got = [r["s"] for r in df.select(graders.grade_function_calls("expected", "actual", "allowed").alias("s")).collect()]
    assert got == pytest.approx([c[3] for c in cases])


def test_reward_dense(spark):
    schema = ("reward_basis array<string>, db_check struct<db_reward:double>, env_assertions array<struct<met:boolean>>, "
              "action_checks array<struct<action_match:boolean,tool_type:string>>, communicate_checks array<struct<met:boolean>>")
    rows = [
        (["DB", "ACTION"], (1.0,), None, [(True, "write"), (True, "read")], None), (["ACTION"], None, None, [(True, "WRITE"), (False, "read"), (False, None)], None),
        (["ENV_ASSERTION", "COMMUNICATE"], None, [(True,), (False,), (True,)], None, None), ([], (1.0,), None, None, None), (["NL_ASSERTION", "DB"], (1.0,), None, None, None),
    ]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = df.select(graders.reward_dense().alias("f"), graders.reward_dense("monotone_prefix").alias("p"), graders.reward_dense(exclude_judged=True).alias("x")).collect()
    assert [r["f"] for r in got] == pytest.approx([1.0, 1.0 / 1.8, (2 / 3 + 0) / 2, None, 0.5])
    assert [r["p"] for r in got] == pytest.approx([1.0, 1 / 3, (1 / 3) / 2, None, 0.5])
    assert [r["x"] for r in got][4] == 1.0


def test_judge_failure_is_null(spark):
    assert one(spark, graders.judge_score("t"), t="no json at all") is None
    assert one(spark, graders.judge_score("t"), t='<think>{"score": 1}</think>```json\n{"score": 0.4}\n```') == 0.4


def test_secret_variants(spark):
    got = one(spark, curate.leak_variants("s"), s="sk_live_0123456789abc")
    assert got == ["sk_live_0123456789abc", "0123456789abc", base64.b64encode(b"sk_live_0123456789abc").decode()]
    assert len(one(spark, curate.leak_variants("s"), s="ghp_short")) == 2


# --- trajectories -------------------------------------------------------------------------------------------------

def test_hash_ignores_case_and_space(spark):
    a = F.array(chat.message(F.lit("user"), F.lit("Hello  World\n")))
    b = F.array(chat.message(F.lit("user"), F.lit(" hello world")))
    assert one(spark, chat.prompt_hash(a)) == one(spark, chat.prompt_hash(b))


def test_corpus_formats(spark):
    assert normalize.FORMATS["fleet"] is normalize.from_fleet and len(normalize.FORMATS) == 6
    with pytest.raises(KeyError):
        curate.build_corpus({"toolbench": spark.range(1)}, spark.range(1), spark.range(1))


def test_quarantine(spark):
    df = spark.createDataFrame([(1, []), (2, [("user", "x", None, None)]), (3, [("assistant", "y", None, None)])], f"id long, messages {chat.MESSAGES_TYPE}")
    good, bad = normalize.validate_trajectories(df)
    assert [r["id"] for r in good.collect()] == [3]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {1: "empty messages", 2: "must end on an assistant turn"}


def test_unequal_arms_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "arm string, run long")
    with pytest.raises(ValueError):
        curate.complete_arms_only(df.union(df.filter("arm = 'b'").withColumn("run", F.lit(2).cast("long"))), ["a", "b"])
    with pytest.raises(ValueError):
        curate.complete_arms_only(df, ["a", "c"])


# --- statistics, labels, retrieval --------------------------------------------------------------------------------------

def test_permutation_matches_enumeration(spark):
    a, b = [5.0, 6.0, 7.5, 9.0], [1.0, 2.0, 6.5]
    runs = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "arm string, value double")
    pool, obs = a + b, abs(np.mean(a) - np.mean(b))
    splits = list(itertools.combinations(range(7), 4))
    hits = sum(abs(np.mean([pool[i] for i in s]) - np.mean([pool[i] for i in range(7) if i not in s])) >= obs - 1e-12 for s in splits)
    r = experiments.permutation_test(runs, "a", "b").first()
    assert (r["hits"], r["splits"]) == (hits, len(splits))


def test_wilson_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", True)], "arm string, hit boolean")
    rows = {r["arm"]: (r["lo"], r["hi"]) for r in experiments.wilson_interval(df, "arm", "hit").collect()}
    assert rows["a"] == (0.0, 0.0) and rows["b"][1] == 1.0


def test_macro_f1_counts_absent_classes(spark):
    df = spark.createDataFrame([("h", "x", "x")] * 3 + [("h", None, "x")], "head string, truth string, pred string")
    classes = {"h": ("x", "y")}
    assert labels.classification_report(df, classes).first()["f1_macro"] == 0.5
    assert labels.classification_report(df, classes, present_only=True).first()["f1_macro"] == 1.0


def test_empty_attempt_is_null(spark):
    grades = spark.createDataFrame([(1, 1, 0.5, True)], "task_id long, trial long, score double, passed boolean")
    attempts = spark.createDataFrame([(1, 1), (2, 1)], "task_id long, trial long")
    rows = {r["task_id"]: r["passed"] for r in rollups.task_score(grades, attempts).collect()}
    assert rows == {1: True, 2: None}


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, chunk_id string, rank long")
    left, right = (sorted(map(tuple, retrieval.rrf(p, 5).collect())) for p in ([a, b], [b, a]))
    assert left == right and [r[1] for r in sorted(left, key=lambda r: r[3])] == ["y", "x", "z"]


def test_keyword_search_matches_a_scan(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    chunks = [(f"d{i}::chunk_0", " ".join(rng.choices(vocab[: 3 if i % 3 == 0 else 40], k=rng.randint(1, 25)))) for i in range(200)]
    queries = [(q, " ".join(rng.choices(vocab, k=5)).upper()) for q in range(12)]
    df = retrieval.keyword_search(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(chunks, "chunk_id string, content string"), 7)
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["chunk_id"])
    for q, text in queries:
        want = []
        for cid, content in chunks:
            w = content.split()
            hits = len(set(text.lower().split()) & set(w))
            if hits:
                want.append((-hits / (len(w) + 50), cid))
        assert got[q] == [c for _, c in sorted(want)[:7]]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(42)
    centers = rng.normal(size=(20, 32))
    x = centers[rng.integers(0, 20, 800)] + 0.3 * rng.normal(size=(800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[rng.integers(0, 800, 25)] + 0.05 * rng.normal(size=(25, 32))
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vector array<float>").repartition(4)
    que = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, vector array<float>")
    return x, q, que, vec


def test_flat_search_matches_numpy(clustered):
    x, q, queries, vectors = clustered
    got = quantize.flat_topk(queries, vectors, 5).orderBy("query_id", "rank").collect()
    best = np.argsort(-(q.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T), axis=1)[:, :5]
    assert [r["vec_id"] for r in got] == best.ravel().tolist()


def test_search_beyond_the_broadcast_bound(clustered, monkeypatch):
    from evalspark.operators import tiles

    _, _, queries, vectors = clustered
    near = sorted(map(tuple, quantize.flat_topk(queries, vectors, 3).collect()))
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, quantize.flat_topk(queries, vectors, 3).collect())) == near


def test_tile_pairs_in_a_square(spark, monkeypatch):
    """Beyond the bound every pair of tiles meets once, and no tile is copied more often than the root of the partitions."""
    from evalspark.operators import tiles

    left = spark.range(30).selectExpr("id as tile", "cast('x' as binary) as data")
    right = spark.range(17).selectExpr("id as tile", "cast('y' as binary) as data", "array(cast(id as string)) as ids")
    assert tiles.tile_bytes(right) > 17
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tiles, "shuffle_width", lambda _: 16)
    pairs = tiles.tile_pairs(left, right)
    assert sorted((r["l_tile"], r["r_tile"]) for r in pairs.collect()) == [(a, b) for a in range(30) for b in range(17)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "CartesianProduct" not in plan
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 64 << 20)
    assert tiles.tile_pairs(left, right).count() == 30 * 17


def test_quantized_recall(clustered):
    _, _, queries, vectors = clustered
    truth = quantize.flat_topk(queries, vectors)
    recall = lambda df: retrieval.recall_at_k(truth, df, 10, "vec_id").first()["recall"]
    assert recall(truth) == 1.0
    assert recall(quantize.sq8_search(queries, vectors)) > 0.95
    coarse, fine = (recall(quantize.pq_search(queries, vectors, m=16, bits=b)) for b in (4, 8))
    assert fine > coarse > 0.1 and fine > 0.6
    assert recall(quantize.opq_search(queries, vectors, m=16, bits=8)) > 0.6
    # every cell probed: only the residual codes are approximate, and they beat codes of whole vectors
    assert recall(quantize.ivf_pq_search(queries, vectors, m=16, nlist=20, nprobe=20, bits=4)) > coarse
    two, four = (recall(quantize.rotated_lowbit_search(queries, vectors, b)) for b in (2, 4))
    assert four > two > 0.2


def test_training_goes_on_until_it_stands_still(clustered):
    _, _, _, vectors = clustered
    for fit in (quantize.train_pq(vectors, 8, 4), quantize.train_opq(vectors, 8, 4)):
        assert fit.converged and len(fit.history) > 3
        assert all(b <= a * (1 + 1e-9) for a, b in zip(fit.history, fit.history[1:]))
    assert not quantize.train_codebooks(vectors, 8, 16, most_rounds=2).converged


def test_learned_rotation(spark):
    """On correlated coordinates the learned rotation is orthogonal and codes are not worse than without; a numpy run of
    the same rounds ends at the same distortion."""
    rng = np.random.default_rng(8)
    mix = rng.standard_normal((16, 16)) * np.geomspace(3, 0.05, 16)
    x = rng.standard_normal((1_500, 16)) @ mix
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vector array<double>").repartition(5)
    plain, learned = quantize.train_pq(vectors, 4, 4), quantize.train_opq(vectors, 4, 4)
    assert np.allclose(learned.rotation @ learned.rotation.T, np.eye(16), atol=1e-8)
    error = lambda q: float(((x if q.rotation is None else x @ q.rotation) - np.stack([q.books[j][q.encode(x)[:, j]] for j in range(4)], axis=1).reshape(len(x), -1)).__pow__(2).sum() / len(x))
    assert error(learned) < 0.9 * error(plain)
    assert learned.history[-1] == pytest.approx(error(learned), rel=1e-9)
    rotation = quantize.balanced_axes(vectors, 4)
    order = [r["vec_id"] for r in vectors.selectExpr("vec_id", "xxhash64(vec_id, 17) as h").orderBy("h", "vec_id").limit(16).collect()]
    books = np.stack([(x[order] @ rotation)[:, 4 * j: 4 * j + 4] for j in range(4)])
    history = []
    for step in range(len(learned.history)):
        y = x @ rotation
        code = quantize.nearest(y, books)
        stood = np.concatenate([books[j][code[:, j]] for j in range(4)], axis=1)
        history.append(((y - stood) ** 2).sum() / len(x))
        if step % 2:
            u, _, v = np.linalg.svd(x.T @ stood)
            rotation = u @ v
        else:
            books = np.stack([np.stack([y[code[:, j] == c, 4 * j: 4 * j + 4].mean(axis=0) if (code[:, j] == c).any() else books[j][c] for c in range(16)]) for j in range(4)])
    assert np.allclose(history, learned.history, rtol=1e-6)


def test_recall_targets(clustered):
    _, _, queries, vectors = clustered
    truth = quantize.flat_topk(queries, vectors)
    recall = lambda df: retrieval.recall_at_k(truth, df, 10, "vec_id").first()["recall"]
    fit = quantize.train_pq(vectors, 8, 4)
    again = quantize.reranked_search(queries, vectors, fit).persist()
    assert recall(again) >= 0.9 > recall(quantize.quantized_search(queries, vectors, fit)) and again.first()["depth"] < 800
    cells = quantize.ivf_reranked_search(queries, vectors, 8, nlist=20, bits=4).persist()
    assert recall(cells) >= 0.9 and 0 < cells.first()["searched"] <= 1
    whole = {(r["query_id"], r["vec_id"]): r["score"] for r in quantize.flat_topk(queries, vectors, 800).collect()}
    assert all(r["score"] == pytest.approx(whole[r["query_id"], r["vec_id"]], abs=2e-9) for r in again.collect())


def test_all_cells_are_all_codes(clustered):
    """Probing every cell of an index of whole vectors gives what the codes alone give."""
    _, _, queries, vectors = clustered
    fit = quantize.train_pq(vectors, 8, 4)
    index = quantize.cell_index(vectors, 8, nlist=12, residual=False, quantizer=fit)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert rows(quantize.search_cells(index, queries, 12, 10)) == rows(quantize.quantized_search(queries, vectors, fit))


def test_latest_wins_join(spark):
    a = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k long, o long, a string")
    b = spark.createDataFrame([(1, 1, "b")], "k long, o long, b string")
    assert [tuple(r) for r in tables.inner_on_keys(a, b, "k", "o").collect()] == [(1, "new", "b")]


def test_bracket_pairs_and_picking():
    assert list(documents.bracket_pairs("}{a{b}{", "{}")) == [(3, 6, False)]
    assert list(documents.bracket_pairs("{a}{{}}", "{}")) == [(0, 3, True), (4, 6, False), (3, 7, True)]
    start = time.perf_counter()
    assert documents._pick("{" * 200_000 + " [1, 2]")[0] == "[1,2]"
    assert time.perf_counter() - start < 5
    assert documents._envelope('```json\n{"a": 1} {"stdout": "x\ny"} {"b": 2}\n```') == '{"stdout": "x\\ny"}'
    assert documents._envelope(None) is None and documents._envelope("{") is None


def test_reports_count_missing_and_foreign_predictions(spark):
    rows = [("h", 1, 1)] * 10 + [("h", 1, None)] * 6 + [("h", 0, 9)] * 4 + [("h", None, 1)] * 3
    got = labels.classification_report(spark.createDataFrame(rows, "head string, truth int, pred int"), {"h": (0, 1)}).first()
    assert (got["accuracy"], got["n"]) == (0.5, 20)


def test_top_k_of_any_size(spark):
    df = spark.range(5000).selectExpr("id", "id % 2 as key", "if(id % 5 = 0, null, id % 30) as o").repartition(7)
    for n in (3, 1000, 1001, 1700):
        got = {(r["key"], r["id"]) for r in curate.cap_per_source(df, n, "o", source="key").collect()}
        want = set()
        for key in (0, 1):
            ids = sorted((i for i in range(5000) if i % 2 == key), key=lambda i: (i % 5 == 0, i % 30 if i % 5 else 0, i))
            want |= {(key, i) for i in ids[:n]}
        assert got == want


def test_codes_beyond_a_byte():
    books = np.arange(400, dtype=float).reshape(1, 400, 1)
    assert quantize.ProductQuantizer(books).encode(np.array([[290.0]]))[0, 0] == 290


def test_permutation_modes(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0)], "arm string, value double")
    assert experiments.permutation_test(runs, "a", "b").first()["mode"] == "exact"
    assert experiments.permutation_test(runs, "a", "b", mode="sampled", iterations=50).first()["splits"] == 50
    for bad in ({"mode": "sampled"}, {"iterations": 5}, {"mode": "auto"}):
        with pytest.raises(ValueError):
            experiments.permutation_test(runs, "a", "b", **bad)


def test_batches_of_wide_rows_are_small(spark):
    """Rows of two tiles reach a Python worker a few at a time, not 10,000."""
    import pandas as pd

    from evalspark.plans.registry import Tables

    Tables(spark, "/nowhere")
    wide = spark.range(200, numPartitions=1).selectExpr("id", "repeat('x', 500000) as data")

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    assert max(r["n"] for r in wide.mapInPandas(sizes, "n long").collect()) <= 16


def test_shared_pairs_in_slices(monkeypatch):
    """Near copies in one tile come out in bounded slices that together are all pairs."""
    from types import SimpleNamespace

    from evalspark.operators import tiles

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(50)]
    packed = {"sizes": np.array([len(s) for s in sets]).tobytes(), "grams": np.concatenate(sets).tobytes(), "totals": np.array([len(s) for s in sets]).tobytes(), "tile": 1}
    row = SimpleNamespace(**{f"{side}_{k}": v for side in "lr" for k, v in packed.items()})
    monkeypatch.setattr(tiles, "MEETINGS", 500)
    slices = list(tiles.shared_pairs(row))
    got = {(a, b): (s, u) for part in slices for a, b, s, u in zip(*map(np.ndarray.tolist, part))}
    want = {(a, b): (len(x := np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]) - len(x)) for a in range(50) for b in range(a + 1, 50)}
    assert len(slices) > 5 and got == {k: v for k, v in want.items() if v[0]}


def test_tiles_of_sets_meet_without_a_shuffle(spark, monkeypatch):
    """Beyond the broadcast bound the parts of a checkpoint meet, and no tile is written again for each block."""
    from evalspark.operators import textstats, tiles

    words = [f"w{i}" for i in range(7)]
    texts = [" ".join(words[(i * j + j) % 7] for j in range(5 + i % 9)) for i in range(60)] + ["", None, "one two", "a b c d e", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {}
    for i, text in enumerate(texts):
        w = (text or "").split()
        sets.setdefault(frozenset(zip(w, w[1:], w[2:], w[3:])), []).append(i)
    sets.pop(frozenset())
    expect = sorted((*sorted((a[0], b[0])), len(s & t), len(s | t), *[len(x) for x in sorted((a, b))])
                    for s, a in sets.items() for t, b in sets.items() if a < b and s & t)
    near = sorted(map(tuple, textstats.shared_ngram_pairs(df, "id", "text").collect()))
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tiles, "SETS", 4)
    far = textstats.shared_ngram_pairs(df, "id", "text")
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, far.collect())) == near == expect and len(expect) == 90
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_sets_travel_as_texts_and_grams_without_their_owner(spark):
    """What is shuffled: a text for each set, then packed grams, never a row for each gram."""
    from evalspark.operators import textstats

    df = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f")], "id long, text string")
    cut = textstats.gram_tiles(textstats.gram_sets(df, "id", "text"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    tile = cut.first()
    assert sorted(tile["ids"]) == [1, 2] and len(tile["grams"]) == 16 and np.frombuffer(tile["totals"], np.int64).tolist() == [2, 2]


@pytest.mark.parametrize("nprobe", [4, 30])
def test_cells_come_together_before_they_are_searched(spark, nprobe):
    """Tiles of a cell do not multiply with the partitions of the vectors, in a crowded cell neither."""
    from evalspark.operators import quantize, tiles

    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8))
    x[:1500] = x[0] + rng.standard_normal((1500, 8)) * 1e-3  # one crowded cell
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(16)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::100])], "query_id long, vector array<double>").coalesce(1)
    index = quantize.cell_index(vectors, 4, nlist=30, bits=4)
    found = quantize.search_cells(index, queries, nprobe, 5).select("query_id", "rank", "vec_id", "score").collect()
    packed = quantize.cell_tiles(index.coded, index.quantizer, "vec_id").select("x", "n").collect()
    assert len(packed) <= len(index.centers) + 8 + 3000 // tiles.ROWS and sum(r["n"] for r in packed) == 3000
    q = index.quantizer
    stored = {r["vec_id"]: (r["cell"], np.array(r["vector"])) for r in index.coded.collect()}
    ids = np.array(sorted(stored))
    cell, codes = np.array([stored[i][0] for i in ids]), q.encode(np.stack([stored[i][1] for i in ids]))
    expect = []
    for i in range(30):
        v = x[100 * i : 100 * i + 1]
        probed = np.argsort(-(v @ index.centers.T)[0], kind="stable")[:nprobe]
        scores = np.round(q.score(v, codes)[0] + index.centers[cell] @ v[0], 9)
        at = [j for j in np.lexsort((ids, -scores)) if cell[j] in probed][:5]
        expect += [(i, rank + 1, int(ids[j])) for rank, j in enumerate(at)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == expect


def test_harvest_lists_many_folders_in_few_tasks(spark, tmp_path):
    """A hundred folders were a hundred tasks."""
    from evalspark.sources import readers

    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.txt").write_text("x" * (150 + i))
    before = spark.conf.get(readers.LISTING_TASKS)
    spark.sparkContext.setJobGroup("listing", "listing")
    found = readers.harvest_files(spark, str(tmp_path), suffixes=("txt",), skip=("d99",))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 32 and spark.conf.get(readers.LISTING_TASKS) == before
    assert sorted(r["length"] for r in found.collect()) == list(range(200, 249))


def test_gram_hashes_follow_the_words():
    """Hashed n-grams are as many, and as equal, as the n-grams of the words; texts of a batch stay apart."""
    import pyarrow as pa

    from evalspark.functions import grams

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "it's", "é", "x1", "--", "ab"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a b c", "naïve café 1 2", "\n".join("abcd"), "q" * 200_000 + " r s t", "q" * 200_001 + " r s t", "ab ba ab ba", "ba ab ba ab"]
    words = [re.findall("[a-z0-9']+", t or "") for t in texts]
    want = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in words]
    got = list(grams.gram_sets(pa.array(texts, pa.string()), 4))
    assert [len(g) for g in got] == [len(w) for w in want] and all((np.diff(g.astype(object)) > 0).all() for g in got)
    pairs = list(itertools.combinations(range(len(texts)), 2))
    assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for i, j in pairs[::7] + [(len(texts) - 2, len(texts) - 1)])


def test_grams_of_the_same_sets_are_one(spark):
    """A line that three texts share is one gram with its number, and pairs still count each of its grams."""
    from evalspark.operators import textstats

    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(i, f"x{i} {line} y{i}") for i in range(3)] + [(9, "w0 w1 w2 w3"), (10, None)], "id long, text string")
    tile = textstats.gram_tiles(textstats.gram_sets(df, "id", "text")).first()
    held = dict(zip(tile["ids"], np.frombuffer(tile["sizes"], np.int64)))
    assert held == {0: 2, 1: 2, 2: 2, 9: 1} and sorted(np.frombuffer(tile["times"], np.int32)) == [1, 1, 1, 1, 16, 16, 16]
    got = {(r["a"], r["b"]): (r["shared"], r["union_size"]) for r in textstats.shared_ngram_pairs(df, "id", "text").collect()}
    assert got == {(0, 1): (17, 21), (0, 2): (17, 21), (1, 2): (17, 21), (0, 9): (1, 19), (1, 9): (1, 19), (2, 9): (1, 19)}


@pytest.mark.parametrize("kind", ["spread", "ties", "two clusters"])
def test_mmd_in_two_passes(spark, monkeypatch, kind):
    """Beyond what is listed by value: the exact median and the kernel sums take two passes over all pairs, four before; ties and
    a gap at the median change nothing."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(70, 6)), rng.normal(0.4, 1, size=(50, 6))
    if kind == "ties":
        x, y = np.round(x * 0.4), np.round(y * 0.4)
    if kind == "two clusters":
        x, y = np.vstack([x[:35], x[35:] + 50]), np.vstack([y[:25] + 50, y[25:]])
    passes = []
    frames = type(spark.range(1))
    plain = frames.mapInPandas
    monkeypatch.setattr(frames, "mapInPandas", lambda self, run, schema, *rest: passes.append("kind" in schema) or plain(self, run, schema, *rest))
    monkeypatch.setattr(textstats, "LISTED", 40)
    monkeypatch.setattr(textstats, "MMD_ROWS", 32)
    monkeypatch.setattr(textstats, "MMD_BLOCK", 8)
    frame = lambda m, o: spark.createDataFrame([(o + i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, vec array<double>").repartition(3)
    got = textstats.mmd2(frame(x, 0), frame(y, 1000), "id", "vec").first()
    both = np.vstack([x, y])
    d = ((both[:, None] - both[None]) ** 2).sum(2)
    median = np.median(d[np.triu_indices(len(both), 1)])
    k = np.exp(-d / (median + 1e-12))
    np.fill_diagonal(k, 0)
    m, n = len(x), len(y)
    expect = k[:m, :m].sum() / (m * (m - 1)) + k[m:, m:].sum() / (n * (n - 1)) - 2 * k[:m, m:].mean()
    assert got["bandwidth"] == pytest.approx(median, abs=2e-6) and got["mmd2"] == pytest.approx(max(expect, 0), abs=2e-6)
    assert sum(passes) == 2 if kind == "spread" else sum(passes) <= 8


def test_mmd_without_numbers(spark):
    frame = lambda o, bad: spark.createDataFrame([(o + i, [float(i), bad if i > 1 else 1.0]) for i in range(9)], "id long, vec array<double>")
    assert np.isnan(textstats.mmd2(frame(0, float("nan")), frame(100, 2.0), "id", "vec").first()["mmd2"])
