"""Cheapest repairs against every possible edit, digests against a plain recount, and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from evalspark.llm import repair

GAPS = ["", "u", "a", "ua", "au"]


def every_repair(initials, faults):
    """Least (cost, audit) over all edits with at most two inserted turns between rows."""
    best = None
    choices = [[("D", 3, "")] if f in "bd" else [("D", 3, ""), ("K", f == "t", r), ("R", 2 + (f == "t"), "u"), ("R", 2 + (f == "t"), "a")] for r, f in zip(initials, faults)]
    for rows in itertools.product(*choices):
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(r[2] + g for r, g in zip(rows, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gaps[0]) + "".join(r[0] + "I" * len(g) for r, g in zip(rows, gaps[1:]))
                found = (2 * sum(map(len, gaps)) + sum(r[1] for r in rows), audit)
                best = found if best is None else min(best, found)
    return best


def table_repair(initials, faults):
    """The same by a table over rows and last roles."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def filled(states):
        for _ in range(3):
            for q, (cost, audit) in list(states.items()):
                states[step[q]] = min(states.get(step[q], (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = filled({"": (0, "")})
    for r, f in zip(initials, faults):
        new = {q: (c + 3, a + "D") for q, (c, a) in states.items()}
        if f not in "bd":
            for q, (c, a) in states.items():
                if (r == "s" and q == "") or r == step[q]:
                    new[r] = min(new.get(r, (10**9, "")), (c + (f == "t"), a + "K"))
                new[step[q]] = min(new.get(step[q], (10**9, "")), (c + 2 + (f == "t"), a + "R"))
        states = filled(new)
    return min(v for q, v in states.items() if q in ("", "a"))


def test_against_every_edit():
    for n in range(4):
        for initials in itertools.product("sua-", repeat=n):
            for seed in range(1 if n == 3 else 4):
                faults = "".join(random.Random(f"{initials}{seed}").choice("-t-b-d") for _ in range(n))
                assert repair.cheapest("".join(initials), faults) == every_repair(initials, faults), (initials, faults)


def test_against_table():
    for seed in range(1500):
        rng = random.Random(seed)
        n = rng.randint(0, 40)
        initials, faults = "".join(rng.choice(rng.choice(["sua-", "ua", "u", "sss", "au"])) for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))
        assert repair.cheapest(initials, faults) == table_repair(initials, faults), (initials, faults)


@pytest.mark.parametrize("initials", ["u", "s", "au", "-", "ssa", "uus"])
def test_long(initials):
    n = 30_000 // len(initials)
    assert repair.cheapest(initials * n, ("--t-" * n * len(initials))[: n * len(initials)]) == table_repair(initials * n, ("--t-" * n * len(initials))[: n * len(initials)])


def plain(rows):
    """The contract of the query, row by row."""
    conversations = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults = set(), ""
        for _, _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[2][:1] for r in kept]
        cost, audit = table_repair(initials, faults)
        turns, lines, last = {r[1] for r in kept if r[0]}, [], ""
        left = iter(kept)
        for edit in audit:
            _, _, role, text = (None, None, "", "") if edit == "I" else next(left)
            if edit != "D":
                last = role[:1] if edit == "K" else "a" if last == "u" else "u"
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows):
    frame = spark.createDataFrame([(c, t, r, x, "q", 1, 2) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, audit string, kind int, nth int").repartition(5)
    found = repair.audit(repair.damaged(frame), frame)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in found.collect()}


def test_rows(spark):
    rng = random.Random(3)
    words = ["Yes.", "No", "why?\n", "  ", "", None, "Ünd!", "a. b", "\t\r\n", "x" * 200_000 + ".", "..."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2, 3, 5, 8, -4, 2**40]), rng.choice(["user", "assistant", "system", "tool", "", None, "Üser", "sys"]), rng.choice(words)) for _ in range(900)]
    rows += [(100 + i, t, r, f"{r} {t}.") for i in range(40) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(700, i % 50, "user", "Again.") for i in range(3_000)]
    assert got(spark, rows) == plain(rows)


def test_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "Well?"), (1, 3, "user", " "), (2, 0, "tool", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repairs(frame)
    turns = [(r.conv_id, r.position, r.edit, r.role, r.text) for r in repair.repaired_turns(frame, found).orderBy("conv_id", "position").collect()]
    by_id = {r.conv_id: (r.cost, r.audit) for r in found.collect()}
    assert by_id == {1: (7, "IKKRD"), 2: (3, "D")}
    assert turns == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi!"), (1, 3, "R", "assistant", "Well?")]


def test_empty(spark):
    assert got(spark, []) == {}
