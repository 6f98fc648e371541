"""Text expressions. Every function maps columns to a column and stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(col(value)), body)[0]


def strip(c) -> Column:
    """Unicode-aware trim of every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def rstrip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+\z", "")


def squeeze(c) -> Column:
    """Lower case, white space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def short_hash(c) -> Column:
    """First 16 hex digits of sha256 over the squeezed text."""
    return F.substring(F.sha2(squeeze(c), 256), 1, 16)


def words(c) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def tokens(c) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9']+"), 0)


def ngrams(array, n: int) -> Column:
    """Blank-joined n-grams. Zips n shifted slices, so the array is read n times, not once per gram."""
    a = col(array)
    count = F.greatest(F.size(a) - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(a, i + 1, count) for i in range(n)])
    return F.transform(zipped, lambda g: F.concat_ws(" ", *[g.getField(str(i)) for i in range(n)]))


def ngram_hashes(array, n: int) -> Column:
    """64-bit hashes of the n-grams: those of longer runs come from two shorter ones, so no gram is written out as text."""
    def joined(a: Column, b: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(b, step + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    def longer(run: Column, size: int) -> Column:
        if size == n:
            return F.slice(run, F.lit(1), F.greatest(F.size(run) - (n - 1), F.lit(0)))
        step = min(size, n - size)  # two runs of the same size that overlap give every size up to the double
        return let(run, lambda a: longer(joined(a, a, step), size + step))

    return let(F.transform(col(array), lambda w: F.xxhash64(w)), lambda a: longer(a, 1))


def occurrences(text, needle) -> Column:
    """Non-overlapping count of a literal fragment (fragment not empty)."""
    t, n = col(text), needle if isinstance(needle, Column) else F.lit(needle)
    return ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int")


def contains_folded(text, needle) -> Column:
    return F.contains(F.lower(col(text)), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def quoted(fragment) -> Column:
    """A regular expression that matches the fragment literally."""
    return F.regexp_replace(col(fragment), r"([\\.\[\]{}()*+?^$|#\-])", r"\\$1")
