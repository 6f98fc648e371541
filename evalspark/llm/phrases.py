"""Phrase collocations: frequent n-grams by Misra-Gries summaries, exact counts in a second pass, scores by cut.

A text is lower-cased (A-Z only) and split at ``. , ; : ! ?`` and line ends into pieces, a piece at blanks and tabs into
words. Everything is counted per language. A phrase of ``least`` to ``most`` words is a candidate if it occurs at least
``threshold`` times inside pieces.

First pass. Tasks hash the n-grams of 1 to ``most`` words, add up equal ones and deal them by the leading hash bits over
2^s hash partitions; s grows with the bytes of text, so one partition holds what about ``part_bytes`` of text give, at
any size of the corpus. In a hash partition the tasks' summaries are merged into one Misra-Gries summary with more
counters than the partition's mass divided by the threshold. A merge that overflows takes the same amount off every
counter; these cuts add up to less than the threshold, so each n-gram that occurs that often keeps a counter. Counters
whose value plus the cuts reaches the threshold survive; shared hash values can only add survivors.

Second pass. The survivors are marked in a bitmap of at most ``2**MAP_BITS`` bits, 32 MB, which is all that the driver
gathers and broadcasts. Marked n-grams, found among all occurrences again, are counted exactly by their words; those below
the threshold go. A fuller bitmap only lets more n-grams through to the exact count.

Every part of a candidate is at least as frequent as the candidate, so parts are found among the counted n-grams. These
are joined by key with salted copies of the shorter parts, since one word may begin a large share of all candidates.

Edge cases. Null and empty texts have no words; a null language is ``und``; a language without words or without
candidates gives no rows. Repeated rows count as often as they stand. Very long texts and words are taken whole. Ties are
ordered by phrase in byte order. Only the named columns are read, so extra columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UNKNOWN = "und"
MAP_BITS = 28
PART_BYTES = 16 << 20
HELD = 2_000_000  # n-grams a task adds up before it sends a summary
KEY_BITS = 32
SALTS = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, BLANK, MARK = 0, 1, 2
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = MARK

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


class Words:
    """The words of a batch of texts: a vocabulary, an id for each word, and runs of words that stand in one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts, langs = pc.fill_null(texts.cast(pa.large_string()), ""), pc.fill_null(langs.cast(pa.string()), UNKNOWN)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high]] if high > low else np.zeros(0, np.uint8)
        offsets = offsets - low
        kind = KIND[data]
        inside = kind == WORD
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        first[borders] = inside[borders]  # a text's first word does not go on the text before it
        last[borders - 1] = inside[borders - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(kind == MARK, dtype=np.int64)[starts] + row if len(starts) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = np.ascontiguousarray(data[inside])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        self.vocabulary, self.ids = words.dictionary, np.asarray(words.indices, dtype=np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = np.asarray(coded.indices, dtype=np.int64)[row]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word of the vocabulary."""
        n = len(self.vocabulary)
        if n == 0:
            return np.zeros(0, np.uint64)
        bounds = np.frombuffer(self.vocabulary.buffers()[1], dtype=np.int64)[: n + 1]
        letters = np.frombuffer(self.vocabulary.buffers()[2], dtype=np.uint8)[: bounds[-1]]
        sizes = np.diff(bounds)
        powers = np.cumprod(np.full(int(sizes.max()) + 1, STEP))
        place = np.arange(len(letters)) - np.repeat(bounds[:-1], sizes)
        return _mixed(np.add.reduceat(BYTE[letters] * powers[place], bounds[:-1]))

    def grams(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: language, word ids (a row an n-gram) and count of every different n-gram."""
        size = max(len(self.vocabulary), 1)
        open_at = np.arange(len(self.ids))
        prefix, tuples, lang = self.lang, np.zeros((0, 0), np.int64), None
        for n in range(1, most + 1):
            if n > 1:  # n-grams go on where the next word stands in the same piece
                goes_on = open_at + n - 1 < len(self.ids)
                goes_on[goes_on] = self.piece[open_at[goes_on]] == self.piece[open_at[goes_on] + n - 1]
                open_at, prefix = open_at[goes_on], prefix[goes_on]
            keys, inverse, counts = np.unique(prefix * size + self.ids[open_at + n - 1], return_inverse=True, return_counts=True)
            before, word = np.divmod(keys, size)
            lang = before if n == 1 else lang[before]
            tuples = np.column_stack([tuples[before], word]) if n > 1 else word[:, None]
            prefix = inverse.reshape(-1).astype(np.int64)
            yield lang, tuples, counts

    def gram_hashes(self, lang: np.ndarray, tuples: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every n-gram within its language."""
        of_lang = np.array([_name_hash(x) for x in self.langs.to_pylist()], dtype=np.uint64)
        out = of_lang[lang]
        for k in range(tuples.shape[1]):
            out = _mixed(out * MIX + of_word[tuples[:, k]])
        return out

    def phrases(self, tuples: np.ndarray) -> pa.Array:
        """The words of every n-gram, joined by blanks."""
        parts = [self.vocabulary.take(pa.array(tuples[:, k])).cast(pa.large_string()) for k in range(tuples.shape[1])]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def _name_hash(name: str) -> int:
    raw = np.frombuffer(name.encode(), dtype=np.uint8)
    return int(_mixed(np.array([(BYTE[raw] * np.cumprod(np.full(len(raw), STEP))).sum() + np.uint64(len(raw))], dtype=np.uint64))[0])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys become one, with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _summaries(most: int, bits: int):
    """Batches of texts become summaries by hash partition: keys that occur once, other keys, counts of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            words = Words(batch.column(1), batch.column(0))
            of_word = words.hashes()
            for lang, tuples, counts in words.grams(most):
                held.append((words.gram_hashes(lang, tuples, of_word), counts))
                size += len(counts)
            if size >= HELD:
                yield packed(*_added(*map(np.concatenate, zip(*held))))
                held, size = [], 0
        if size:
            yield packed(*_added(*map(np.concatenate, zip(*held))))

    def packed(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        keys = ((hashes << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)).astype(np.uint32)
        rows = {"part": [], "mass": [], "once": [], "often": [], "counts": []}
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            one = counts[a:b] == 1
            rows["part"].append(int(part[a]))
            rows["mass"].append(int(counts[a:b].sum()))
            rows["once"].append(keys[a:b][one].tobytes())
            rows["often"].append(keys[a:b][~one].tobytes())
            rows["counts"].append(counts[a:b][~one].astype(np.uint64).tobytes())
        return pa.record_batch([pa.array(rows["part"], pa.int64()), pa.array(rows["mass"], pa.int64()), *(pa.array(rows[c], pa.binary()) for c in ("once", "often", "counts"))], names=list(rows))

    return run


class Summary:
    """A Misra-Gries summary of 32-bit keys with ``capacity`` counters; ``cut`` is the most that any counter has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.cut = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((keys, counts))
        self._size += len(keys)
        if self._size > self.capacity:
            self.settle()

    def settle(self) -> None:
        """Merge what has come since; if more than ``capacity`` counters are in use, all lose the next largest count."""
        keys, counts = _added(np.concatenate([self.keys, *(k for k, _ in self._new)]), np.concatenate([self.counts, *(c for _, c in self._new)]))
        self._new, self._size = [], 0
        if len(counts) > self.capacity:
            loss = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.cut += loss
            stays = counts > loss
            keys, counts = keys[stays], counts[stays] - loss
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have occurred ``threshold`` times."""
        self.settle()
        return self.keys[self.counts + self.cut >= threshold]


def _survivors(threshold: int, bits: int, map_bits: int):
    """The summaries of one hash partition become its stretch of the bitmap of surviving n-grams."""

    def run(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        summary = Summary(mass // threshold + 1)
        for once, often, counts in zip(*(table.column(c) for c in ("once", "often", "counts"))):
            keys = np.frombuffer(once.as_buffer(), np.uint32)
            summary.add(keys, np.ones(len(keys), np.int64))
            summary.add(np.frombuffer(often.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint64).astype(np.int64))
        width = map_bits - bits  # bits of the key that number the slots of one partition
        marks = np.zeros(1 << width, dtype=bool)
        marks[summary.survivors(threshold) >> np.uint32(KEY_BITS - width)] = True
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return run


def _marked(most: int, map_bits: int, bitmap):
    """Batches of texts become counted n-grams of marked slots; a phrase of no words carries the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            words = Words(batch.column(1), batch.column(0))
            of_word = words.hashes()
            for n, (lang, tuples, counts) in enumerate(words.grams(most), 1):
                if n == 1:
                    totals = np.bincount(lang, counts, minlength=len(words.langs)).astype(np.int64)
                    yield rows(0, words.langs, pa.array([""] * len(totals), pa.string()), totals)
                slot = words.gram_hashes(lang, tuples, of_word) >> np.uint64(64 - map_bits)
                hit = np.flatnonzero(marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                for at in range(0, len(hit), 100_000):
                    some = hit[at: at + 100_000]
                    yield rows(n, words.langs.take(pa.array(lang[some])), words.phrases(tuples[some]), counts[some])

    def rows(n: int, lang: pa.Array, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([lang.cast(pa.string()), pa.array(np.full(len(counts), n), pa.int32()), phrase.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "f"])

    return run


def frequent_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 3, threshold: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every n-gram of 1 to ``most`` words that occurs ``threshold`` times or more in a language: lang, words, phrase, f.

    A row of 0 words holds the number of all words of the language. The result is stored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang).cast("string"), F.col(text).cast("string"))
    volume = texts.select(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    bits = min(max(0, math.ceil(math.log2(max(volume, 1) / part_bytes))) if volume > part_bytes else 0, MAP_BITS - 3)
    map_bits = min(max(bits + 3, math.ceil(math.log2(volume + 64))), MAP_BITS)
    summaries = texts.mapInArrow(_summaries(most, bits), "part long, mass long, once binary, often binary, counts binary")
    parts = summaries.groupBy("part").applyInArrow(_survivors(threshold, bits, map_bits), "part long, marks binary")
    stretch = 1 << (map_bits - bits - 3)
    bitmap = bytearray(1 << (map_bits - 3))
    for row in parts.collect():
        bitmap[row.part * stretch: (row.part + 1) * stretch] = row.marks
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    counted = texts.mapInArrow(_marked(most, map_bits, shared), "lang string, words int, phrase string, f long")
    exact = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(exact.where((F.col("words") == 0) | (F.col("f") >= threshold)), "frequent-ngrams")


def _span(phrase: Column, first: int | Column, n: int | Column) -> Column:
    """Words ``first`` to ``first + n - 1`` of a phrase."""
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), first, n))


def collocations(frequent: DataFrame, least: int = 2, most: int = 3, share: int = 50) -> DataFrame:
    """Candidates that no longer candidate covers, with their weakest cut: lang, phrase, words, a, l, r, score.

    ``frequent`` is the result of ``frequent_ngrams``. A candidate goes if a longer one that holds its words has at
    least ``share`` percent of its occurrences.
    """
    grams = frequent.where("words > 0")
    candidates = grams.where(F.col("words").between(least, most)).withColumnRenamed("f", "a")
    inner = [F.struct(F.lit(n).alias("words"), _span(F.col("phrase"), at, n).alias("phrase"))
             for n in range(least, most) for at in range(1, most - n + 2)]
    if inner:
        held = candidates.where(F.col("words") > least).select("lang", "words", "a", F.explode(F.array(*inner)).alias("part"), F.col("phrase").alias("longer"))
        held = held.where((F.col("part.words") < F.col("words")) & (F.size(F.split(F.col("part.phrase"), " ")) == F.col("part.words")))
        cover = held.groupBy("lang", F.col("part.phrase").alias("phrase")).agg(F.max("a").alias("cover"))
        candidates = candidates.join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < share * F.col("a"))).drop("cover")

    def parts(salted: Column) -> DataFrame:
        return grams.where(F.col("words") < most).select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.explode(salted).alias("salt"))

    salts = F.array(*map(F.lit, range(SALTS)))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    # one row for each side of a cut, so that parts are joined once
    sides = cuts.select("*", F.explode(F.array(F.lit("l"), F.lit("r"))).alias("side"))
    rest = F.when(F.col("side") == "l", _span(F.col("phrase"), 1, F.col("k"))).otherwise(_span(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    looked = sides.withColumn("part", rest).join(parts(salts), ["lang", "part", "salt"])
    where_cut = range(1, most)
    found = looked.groupBy("lang", "phrase", "words", "a").agg(
        *(F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("part_f"))).alias(f"{side}{k}") for k in where_cut for side in "lr"))
    wide = "decimal(38,0)"
    score = "(cast(1000000 as {0}) * cast(a as {0}) * cast(a as {0})) div (cast(l{1} as {0}) * cast(r{1} as {0}))"
    scored = [F.when(F.col("words") > k, F.struct(F.expr(score.format(wide, k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in where_cut]
    weakest = found.withColumn("cut", F.array_min(F.array(*scored)))
    return weakest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def ranked(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` collocations of every language by score, occurrences and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def mine(docs: DataFrame, least: int = 2, most: int = 3, threshold: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrase collocations of every language of ``docs`` (lang, text), with n, the language's words."""
    frequent = frequent_ngrams(docs, most=most, threshold=threshold)
    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked(collocations(frequent, least, most, share), top).join(totals, "lang")
