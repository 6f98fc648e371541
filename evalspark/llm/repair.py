"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional system turn and then
pairs of user and assistant. Four edits lead there: K keeps a row, R gives it the role user or assistant, D deletes it
and I inserts an empty turn of user or assistant. Of all edits of least cost those are taken whose initials, in order,
are least in ASCII.

Search. Depth-first branch and bound with an explicit stack. A node is a number of rows dealt with and the last role. Its
children come in ASCII order, so prefixes are met in the order of their audits, and a node that was met before at no
higher cost dominates whatever reaches it later: one table entry a node. The bound of a suffix is what it costs if the
conversation may end anywhere. A greedy descent along the bound gives the first incumbent (cost, audit); the search ends
when the stack is empty, which proves the optimum. A node is opened again only at a lower cost than before, so at most
as often as incumbent and bound lie apart, which is a few units: time grows with the rows.

Spark's part. Rows are dealt by conversation and sorted by turn (nulls first), role and text; duplicates come from a
window over equal role and text, and sorting spills to disk. Tasks read the sorted rows as a stream and keep one byte a
row of the conversation at hand, so a conversation of any size is one task's work but never held whole. Audits are then
sorted in before their rows, and a second stream writes the repaired turns or their digest.

Faults. The first that fits a row counts: blank (nothing but white space), duplicate (role and text as in an earlier row),
truncated (the last character that is not white space is none of ``. ! ?``). Blank and duplicate rows must be deleted.

Edge cases. A null role or text is one space. Null turns come first; rows with equal turns are ordered by role and text,
so copies stand side by side. A null conversation id is a conversation of its own. A conversation without rows (named by
``ids`` alone) has an empty audit and the digest of an empty text. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACES = " \t\n\x0b\x0c\r"
KEY, TURN, ROLE, TEXT = "conv_id", "turn", "role", "text"
LEGAL_PAIRS = {"su", "ua", "au"}
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 2_000


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


# The last role is the state of a search: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN_TO = [USER, USER, ASSISTANT, USER]  # the role that an inserted or renamed turn takes on


def _bounds(initials: str, faults: str, costs: Costs) -> list[list[int]]:
    """For every suffix and state a cost that no repair of the suffix goes below."""
    floor = [0, 0, 0, 0]
    out = [floor]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        now = []
        for state in range(4):
            best = costs.delete + floor[state]
            if fault not in "bd":
                extra = costs.truncated if fault == "t" else 0
                best = min(best, costs.rerole + extra + floor[TURN_TO[state]])
                if (state, initial) in AFTER:
                    best = min(best, extra + floor[AFTER[state, initial]])
            now.append(best)
        for _ in range(2):
            now = [min(now[state], costs.insert + now[TURN_TO[state]]) for state in range(4)]
        out.append(now)
        floor = now
    out.reverse()
    return out


def _children(at: int, state: int, initials: str, faults: str, costs: Costs) -> Iterator[tuple[str, int, int, int]]:
    """Edits that can follow, in ASCII order: edit, cost, rows dealt with, last role."""
    if at < len(initials):
        yield "D", costs.delete, at + 1, state
    yield "I", costs.insert, at, TURN_TO[state]
    if at < len(initials) and faults[at] not in "bd":
        extra = costs.truncated if faults[at] == "t" else 0
        kept = AFTER.get((state, initials[at]))
        if kept is not None:
            yield "K", extra, at + 1, kept
        yield "R", costs.rerole + extra, at + 1, TURN_TO[state]


def _spelled(link) -> str:
    out = []
    while link is not None:
        edit, link = link
        out.append(edit)
    return "".join(reversed(out))


def _descent(initials: str, faults: str, floor: list[list[int]], costs: Costs) -> tuple[int, str]:
    """One complete repair: always on to the child whose cost and bound are least."""
    at, state, cost, audit = 0, NOTHING, 0, [""]
    while at < len(initials) or state not in (NOTHING, ASSISTANT):
        choice = _children(at, state, initials, faults, costs)
        if at < len(initials) and audit[-1] == "I":  # one turn between two rows is enough here
            choice = (c for c in choice if c[0] != "I")
        edit, paid, at, state = min(choice, key=lambda c: c[1] + floor[c[2]][c[3]])
        cost += paid
        audit.append(edit)
    return cost, "".join(audit)


def cheapest(initials: str, faults: str, costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and audit of the best repair of rows with these role initials and faults (b, d, t or another letter)."""
    floor = _bounds(initials, faults, costs)
    best_cost, best_audit = _descent(initials, faults, floor, costs)
    ordered = False  # whether the incumbent comes from the search itself, which meets audits in ASCII order
    reached: dict[tuple[int, int], int] = {}
    stack = [(0, NOTHING, 0, None)]
    while stack:
        at, state, cost, link = stack.pop()
        bound = cost + floor[at][state]
        if bound > best_cost or (ordered and bound == best_cost):
            continue
        known = reached.get((at, state))
        if known is not None and known <= cost:
            continue
        reached[at, state] = cost
        if at == len(initials) and state in (NOTHING, ASSISTANT):
            audit = _spelled(link)
            if (cost, audit) <= (best_cost, best_audit):
                best_cost, best_audit, ordered = cost, audit, True
            continue
        grown = [(to_at, to_state, cost + paid, (edit, link)) for edit, paid, to_at, to_state in _children(at, state, initials, faults, costs)]
        stack.extend(child for child in reversed(grown) if child[2] + floor[child[0]][child[1]] <= best_cost)
    return best_cost, best_audit


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, cut, repeated, spoken by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(KEY), F.lit(":"), blank(TURN))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank(TEXT), "[.!?]", "")).otherwise(blank(TEXT))
    role = F.when(fault == 4, "user").otherwise(blank(ROLE))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fault != 0).select(F.col(KEY), F.col(TURN), role.alias(ROLE), text.alias(TEXT), copies.alias("copy")).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(KEY).cast("long"), F.col(TURN).cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (ROLE, TEXT)))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


class _Out:
    """Rows for the next Arrow batch; sent when there are many or long ones."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= FLUSH_ROWS or self.size >= FLUSH_BYTES:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(values, f.type) for values, f in zip(columns, self.schema)], schema=self.schema)


REPAIR = pa.schema([(KEY, pa.int64()), *((c, pa.int64()) for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _repairs(costs: Costs):
    """Sorted rows (conversation, kind, turn, initial, fault) become one repair a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, open_ = _Out(REPAIR), None, False
        initials: list[str] = []
        faults: list[str] = []
        turns, low, high, last = 0, None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            roles, marks = "".join(initials), "".join(faults)
            cost, audit = cheapest(roles, marks, costs)
            illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(roles, roles[1:]))
            gaps = high - low + 1 - turns if turns else 0
            yield from out.add((key, len(roles), gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit), len(audit))

        for conv, kind, turn, initial, fault in _stream(batches):
            if not open_ or conv != key:
                if open_:
                    yield from closed()
                key, open_, initials, faults = conv, True, [], []
                turns, low, high, last = 0, None, None, None
            if kind == 1:
                initials.append(initial)
                faults.append(fault)
                if turn is not None and turn != last:
                    turns, low, high, last = turns + 1, turn if low is None else low, turn, turn
        if open_:
            yield from closed()
        yield out.batch()

    return run


def repairs(rows: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row a conversation: its faults and the cheapest repair as ``cost`` and ``audit``.

    ``rows`` has conv_id, turn, role and text. ``ids`` names conversations that are to be reported even without rows.
    """
    together = _plain(rows).withColumn("kind", F.lit(1))
    if ids is not None:
        named = ids.select(F.col(KEY).cast("long")).distinct()
        together = together.unionByName(named.select(KEY, F.lit(None).cast("long").alias(TURN), F.lit("").alias(ROLE), F.lit("").alias(TEXT), F.lit(0).alias("kind")))
    body = F.rtrim(F.col(TEXT), F.lit(SPACES))
    nth = F.row_number().over(Window.partitionBy(KEY, "kind", ROLE, TEXT).orderBy(F.asc_nulls_first(TURN)))
    fault = F.when(body == "", "b").when(F.col("nth") > 1, "d").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    initial = F.substring(ROLE, 1, 1)
    seen = together.repartition(KEY).withColumn("nth", nth)
    ordered = seen.sortWithinPartitions(KEY, "kind", F.asc_nulls_first(TURN), ROLE, TEXT, "nth")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return ordered.select(KEY, "kind", TURN, known.alias("initial"), fault.alias("fault")).mapInArrow(_repairs(costs), _ddl(REPAIR))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)


class _Edits:
    """The edits of one conversation, applied row by row."""

    def __init__(self, audit: str):
        self.audit, self.place, self.state = audit, 0, NOTHING

    def _new_role(self) -> str:
        self.state = TURN_TO[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.place: self.place + 1] == "I":
            self.place += 1
            yield "I", self._new_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._new_role(), text


TURNS = pa.schema([(KEY, pa.int64()), ("position", pa.int64()), ("edit", pa.string()), (ROLE, pa.string()), (TEXT, pa.string())])
DIGEST = pa.schema([(KEY, pa.int64()), ("repaired_sha256", pa.string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    """Sorted audits and rows become (conversation, its repaired turns); the turns are to be read before going on."""
    stream = _stream(batches)
    row = next(stream, None)

    def turns(edits: _Edits, key: int | None) -> Iterator[tuple[str, str, str]]:
        nonlocal row
        while row is not None and row[1] == 1 and row[0] == key:
            held, row = row, next(stream, None)
            yield from edits.row(held[2], held[3])
        yield from edits.inserted()

    while row is not None:
        key, edits = row[0], _Edits(row[3])
        row = next(stream, None)
        yield key, turns(edits, key)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(TURNS)
    for key, turns in _edited(batches):
        for position, (edit, role, text) in enumerate(turns):
            yield from out.add((key, position, edit, role, text), len(text))
    yield out.batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(DIGEST)
    for key, turns in _edited(batches):
        digest = hashlib.sha256()
        for position, (_, role, text) in enumerate(turns):
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        yield from out.add((key, digest.hexdigest()), 64)
    yield out.batch()


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    audits = found.select(KEY, F.lit(0).alias("kind"), F.lit(None).cast("long").alias(TURN), F.lit("").alias(ROLE), F.col("audit").alias(TEXT))
    together = audits.unionByName(_plain(rows).select(KEY, F.lit(1).alias("kind"), TURN, ROLE, TEXT))
    ordered = together.repartition(KEY).sortWithinPartitions(KEY, "kind", F.asc_nulls_first(TURN), ROLE, TEXT)
    return ordered.select(KEY, "kind", ROLE, TEXT)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits of ``found = repairs(rows)``: conv_id, position, edit (K, R or I), role, text."""
    return _with_audits(rows, found).mapInArrow(_turns, _ddl(TURNS))


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of every repaired conversation, its turns as ``role:text`` joined by line feeds, read as a stream."""
    return _with_audits(rows, found).mapInArrow(_digests, _ddl(DIGEST))


def audit(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The result of ``repairs`` with the digest of the repaired conversation."""
    found = stored(repairs(rows, ids), "repairs")
    left, right = found.alias("f"), repaired_digests(rows, found).alias("d")
    return left.join(right, F.col(f"f.{KEY}").eqNullSafe(F.col(f"d.{KEY}"))).select("f.*", "d.repaired_sha256")
