"""Long lexicons against trying every expression and phrase on every text."""

import random
import re
import time
from re import _parser

import pytest

from evalspark.operators import automaton, tables, textstats

RX = [
    r"the", r"\bthe\b", r"(?i)the", r"THE", r"que[a-z]+", r"(^|\s)And[a-z]*", r"[0-9]{3,}", r"a|b", r"(foo|bar)+baz", r"(?:xy){0,3}z1", r"(?:xy){2,3}", r"foo(?=bar)", r"(?<!x)yz9",
    r"(?i)straße", r"(?i:kiss)", r"İstanbul", r"(?i)istanbul", r"ΟΔΟΣ", r"(?i)οδος", r"a.c", r"a\.c", r".*", r"^$", r"(oops", r"x{2,}y", r"(a)(\1)b", r"", r"\$\$ %", r"(?s)q.w", r"(?x) f o o  # note", r"wor(?>d+)s", r"İ|K9"]
TEXTS = [
    "the THE The", "other weather", "quek and queue", "Andes And", "12 123", "foobarbaz barbaz", "xyxyxyz1 z1", "foobar", "yz9 xyz9", "STRASSE STRAßE straße", "KISS Kiſs kiSS", "İstanbul ISTANBUL ıstanbul istanbul",
    "ΟΔΟΣ οδος οδοσ", "abc a.c a\nc", "", "xxy xy", "aab", "$$ %", "q\nw", "words worddds", "K9 k9 K9", "plain"]


def test_literals_never_hide_a_match():
    for ignore in (False, True):
        table = automaton.PatternTable(list(enumerate(RX)), ignore)
        for text in TEXTS:
            want = []
            for i, rx in enumerate(RX):
                try:
                    if re.search(rx, text, re.I if ignore else 0):
                        want.append(i)
                except re.error:
                    continue
            assert table.names(text) == want, (ignore, text)


def test_literals():
    found = lambda rx: automaton.needed(_parser.parse(rx), False)
    assert found(r"(^|\s)Word[a-z]*") == {"word"} and found(r"(foo|barn)+z") == {"foo", "barn"} and found(r"[a-z]+") is None
    assert found(r"(ab)?cde(x|yy)") == {"cde"} and found(r"a|bcd") is None and found(r"a\bbc") == {"abc"}


def test_expressions_are_tried_where_their_literal_stands():
    """Distances of literals, and a text of many words that is not searched from its start to its end for each expression."""
    at = lambda rx, literal: automaton.distance(_parser.parse(rx), literal, False)
    assert at(r"(^|\s)Word[a-z]*", "word") == (0, 1) and at(r"\bab[0-9]{2,4}cd", "cd") == (4, 6) and at(r".*word", "word") is None and at(r"(word)+", "word") is None
    table = automaton.PatternTable([(i, rf"(^|\s)w{i}[a-z]*") for i in range(100, 300)], False)
    table.names("")
    calls = []

    class Watched:
        def __init__(self, rx):
            self.rx = rx

        def search(self, text):
            calls.append(len(text))
            return self.rx.search(text)

    compiled, always, trie = table._ready
    table._ready = [(name, Watched(rx)) for name, rx in compiled], always, trie
    text = " ".join(f"xw{i}" for i in range(100, 300)) + " w150 w151abc\nw299"
    assert table.names(text) == [150, 151, 299] and not calls


def test_many_patterns(spark):
    """50,000 expressions in one scan of the texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    names = [(i, rf"\b{word()}[0-9]?\b") for i in range(50_000)] + [(50_000, r"[z]+"), (50_001, "(broken"), (50_002, None)]
    texts = [(i, " ".join(rng.choice(names[:50_000])[1][2:-8] + rng.choice(["", "1", "x"]) for _ in range(30)) + (" zz" if i % 5 == 0 else "")) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    patterns = spark.createDataFrame(names, "pattern long, rx string")
    start = time.time()
    joined = tables.pattern_join(docs, "text", patterns)
    got = {(r.id, r.pattern) for r in joined.collect()}
    assert time.time() - start < 60
    literal = {rx[2:-8]: [] for _, rx in names[:50_000]}
    for i, rx in names[:50_000]:
        literal[rx[2:-8]].append(i)
    want = set()
    for i, text in texts:
        for w in (text or "").split():
            for stem in {w, w[:-1] if w[-1] == "1" else w}:
                want.update((i, p) for p in literal.get(stem, ()))
        if "z" in (text or ""):
            want.add((i, 50_000))
    assert got == want


def test_slices(spark, monkeypatch):
    """A list beyond the bound is read in parts, each with the texts; the result is the same."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    patterns = spark.createDataFrame(list(enumerate(RX)), "pattern long, rx string")
    phrases = spark.createDataFrame([("the", 0.5), ("other weather", 1.0), ("the", 0.25), ("$$", 2.0), ("xy", 1.0), (None, 1.0), ("", 3.0), ("the the", 4.0)], "phrase string, weight double")
    whole = [sorted(map(tuple, tables.pattern_join(docs, "text", patterns).collect())), sorted(map(tuple, textstats.phrase_hits(docs, "id", "text", phrases).collect())), sorted(map(tuple, textstats.slop_index(docs, "id", "text", phrases).collect()))]
    monkeypatch.setattr(automaton, "LEXICON_BYTES", 200)
    parts = [sorted(map(tuple, tables.pattern_join(docs, "text", patterns).collect())), sorted(map(tuple, textstats.phrase_hits(docs, "id", "text", phrases).collect())), sorted(map(tuple, textstats.slop_index(docs, "id", "text", phrases).collect()))]
    assert whole == parts and len(whole[0]) > 40


@pytest.mark.parametrize("seed", range(3))
def test_phrases(seed):
    rng = random.Random(seed)
    marks = ["a", "b", "ab", "é", "_", "7", "-", ".", " ", "\n", "日"]
    phrases = sorted({"".join(rng.choice(marks) for _ in range(rng.randint(1, 5))) for _ in range(120)})
    table = automaton.PhraseTable([(p, []) for p in phrases])
    for _ in range(150):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))
        want = {}
        for i, p in enumerate(phrases):
            n = len(re.findall(rf"\b{re.escape(p)}\b", text))
            if n:
                want[i] = n
        assert table.count(text) == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "the text"), (2, None)], "id long, text string")
    none = docs.limit(0)
    assert tables.pattern_join(docs, "text", none.selectExpr("id as pattern", "text as rx")).collect() == []
    assert textstats.phrase_hits(docs, "id", "text", none.selectExpr("text as phrase")).collect() == []
    assert {tuple(r) for r in textstats.slop_index(docs, "id", "text", none.selectExpr("text as phrase", "1.0D as weight")).collect()} == {(1, 0.0), (2, 0.0)}
