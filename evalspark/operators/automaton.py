"""Long pattern and phrase lists against texts: one automaton over literals, in one scan.

A lexicon is a table of patterns or phrases. It goes to the tasks as broadcasts of at most LEXICON_BYTES; a list of
50,000 regular expressions is some 2 MB, so the texts are read once, and only a list beyond the bound takes a further
scan for every LEXICON_BYTES of it. Each Python worker builds the automaton once.

Regular expressions: of each one a literal is taken that every match must hold (or a set of them, one of which it must
hold). A text is walked once through the trie of all literals; only expressions whose literal occurs are tried on it,
and where the literal stands at a bounded distance from the start of a match, only at those places. Expressions without such a literal are tried on every text. Phrases: the pieces of a text (words and single other
characters) are numbered and walked once through the trie of all phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf

LEXICON_BYTES = 64 << 20
SHORTEST = 2  # a literal of one character finds nearly every text

# Letters that match i, s and k when case is ignored, though they are no ASCII letters; and one whose lower case depends on its place.
ODD_CASE = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})
PLACE_BOUND = "Σσς"


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ODD_CASE).lower()


def slices(rows: Iterator, size) -> Iterator[list]:
    """Rows in lists of at most LEXICON_BYTES."""
    held, volume = [], 0
    for row in rows:
        if held and volume + size(row) > LEXICON_BYTES:
            yield held
            held, volume = [], 0
        held.append(row)
        volume += size(row)
    if held:
        yield held


# --- regular expressions -----------------------------------------------------------------------------

def _is_plain(code, value, ascii_only: bool) -> bool:
    """Whether a parsed item is a character whose folded form stands in the folded text wherever it matches."""
    return code is op.LITERAL and (value < 128 or not ascii_only) and chr(value) not in PLACE_BOUND and len(folded(chr(value))) == 1


def needed(parsed, ascii_only: bool) -> set[str] | None:
    """Folded literals one of which every match of a parsed expression holds, or None: the set whose shortest is longest."""
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= SHORTEST and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for code, value in parsed:
        if code is op.AT:
            continue
        if _is_plain(code, value, ascii_only):
            run += chr(value)
            continue
        offer({folded(run)} if run else None)
        run = ""
        if code is op.SUBPATTERN:
            offer(needed(value[3], ascii_only))
        elif code is op.ATOMIC_GROUP:
            offer(needed(value, ascii_only))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            offer(needed(value[2], ascii_only))
        elif code is op.BRANCH:
            sides = [needed(side, ascii_only) for side in value[1]]
            offer(set().union(*sides) if all(sides) else None)
    offer({folded(run)} if run else None)
    return best


FARTHEST, WIDEST = 64, 8  # a literal beyond has too many places at which a match may start


def distance(parsed, literal: str, ascii_only: bool) -> tuple[int, int] | None:
    """Least and largest distance from the start of every match to a literal of the outermost sequence, or None."""
    run, first = "", 0
    for i, (code, value) in enumerate([*parsed, (None, None)]):
        if code is op.AT:
            continue
        if _is_plain(code, value, ascii_only):
            first = first if run else i
            run += chr(value)
            continue
        if run and folded(run) == literal:
            low, high = parsed[:first].getwidth()
            return (low, high) if high <= FARTHEST and high - low <= WIDEST else None
        run = ""
    return None


class PatternTable:
    """Names and regular expressions; those that do not compile match nothing."""

    def __init__(self, patterns: list[tuple], ignore_case: bool):
        self.patterns, self.ignore_case, self._ready = patterns, ignore_case, None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _build(self):
        flags = re.I if self.ignore_case else 0
        by_literal: dict[str, tuple[int, list[int], list[tuple]]] = {}  # size, expressions for the whole text, those with a place
        compiled, always = [], []
        for name, rx in self.patterns:
            try:
                one = re.compile(rx, flags)
            except (re.error, OverflowError, RecursionError):
                continue
            parsed, ascii_only = _parser.parse(rx, flags), bool(one.flags & re.I) or "(?" in rx
            found = needed(parsed, ascii_only)
            for literal in found or ():
                _, whole, placed = by_literal.setdefault(literal, (len(literal), [], []))
                span = distance(parsed, literal, ascii_only) if len(found) == 1 else None
                if span is None:
                    whole.append(len(compiled))
                else:
                    placed.append((len(compiled), one.match, *span))
            if not found:
                always.append(len(compiled))
            compiled.append((name, one))
        trie = ahocorasick.Automaton()
        for literal, which in by_literal.items():
            trie.add_word(literal, which)
        if by_literal:
            trie.make_automaton()
        self._ready = compiled, always, trie if by_literal else None

    def names(self, text: str) -> list:
        """Names of the expressions that match, in the order of the table."""
        if self._ready is None:
            self._build()
        compiled, always, trie = self._ready
        candidates, found = set(always), set()
        low_text = folded(text)
        same = len(low_text) == len(text)  # else places in one are not places in the other
        if trie is not None:
            for end, (size, whole, placed) in trie.iter(low_text):
                if whole:
                    candidates.update(whole)
                start = end - size + 1
                for i, match, low, high in placed:
                    if not same:
                        candidates.add(i)
                    elif i not in found:
                        for at in range(max(0, start - high), start - low + 1):
                            if match(text, at):  # anchors and lookbehind see the text before the place
                                found.add(i)
                                break
        found.update(i for i in candidates if compiled[i][1].search(text))
        return [compiled[i][0] for i in sorted(found)]


def pattern_names(df: DataFrame, text: Column, patterns: DataFrame, ignore_case: bool) -> Iterator[Column]:
    """For every slice of a table (pattern, rx) a column with the names of the expressions that match ``text``."""
    kind = dict(patterns.dtypes)["pattern"]
    rows = patterns.select("pattern", "rx").filter("rx is not null").distinct().toLocalIterator()
    for part in slices(((r["pattern"], r["rx"]) for r in rows), lambda r: len(r[1]) * 4 + 64):
        yield _matcher(df.sparkSession.sparkContext.broadcast(PatternTable(part, ignore_case)), kind)(text)


def _matcher(table, kind: str):
    @arrow_udf(f"array<{kind}>")
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else table.value.names(t))

    return match


# --- phrases ---------------------------------------------------------------------------------------

PIECE = re.compile(r"\w+|\W", re.S)


class PhraseTable:
    """Phrases with their marks: whole words, that is, with a word boundary at both ends, also where these are no letters."""

    def __init__(self, phrases: list[tuple]):
        self.phrases, self._ready = phrases, None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _build(self):
        number: dict[str, int] = {}
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (phrase, *_) in enumerate(self.phrases):
            pieces = PIECE.findall(phrase)
            if pieces:
                trie.add_word(tuple(number.setdefault(p, len(number) + 1) for p in pieces), i)
        sizes = [len(PIECE.findall(phrase)) for phrase, *_ in self.phrases]
        if number:
            trie.make_automaton()
        self._ready = number, trie, sizes

    def count(self, text: str) -> dict[int, int]:
        """Occurrences of each phrase, by its place in the list; those of one phrase do not overlap."""
        if self._ready is None:
            self._build()
        number, trie, sizes = self._ready
        if not number:
            return {}
        pieces = PIECE.findall(text)
        hits: dict[int, int] = {}
        free: dict[int, int] = {}
        word = [p[0].isalnum() or p[0] == "_" for p in pieces]
        last = len(pieces) - 1
        for end, i in trie.iter(tuple(map(number.get, pieces, [0] * len(pieces)))):
            start = end - sizes[i] + 1
            if start < free.get(i, 0) or word[start] == (start > 0 and word[start - 1]) or word[end] == (end < last and word[end + 1]):
                continue
            hits[i] = hits.get(i, 0) + 1
            free[i] = end + 1
        return hits


def phrase_tables(df: DataFrame, phrases: DataFrame, *marks: str) -> Iterator:
    """Broadcasts of the slices of a phrase list; ``marks`` are columns that go with each phrase."""
    rows = phrases.select("phrase", *marks).filter("phrase is not null").toLocalIterator()
    for part in slices(rows, lambda r: len(r["phrase"]) * 4 + 64):
        by_phrase: dict[str, list[tuple]] = {}
        for r in part:
            by_phrase.setdefault(r["phrase"], []).append(tuple(r)[1:])
        yield df.sparkSession.sparkContext.broadcast(PhraseTable(list(by_phrase.items())))
