"""Repair of conversations against a plain walk over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from docketry.llm import q_conversations
from docketry.llm.conversation_repair import PIECE_TURNS, conversation_repair, repaired_turns

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    """``(role, text, fault)`` of a conversation's rows in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall("[^\x20\x09-\x0d]", text)
        if not last:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(turns):
    """(cost, audit, lines) of the best way, by forward search over states."""
    ways = {"": (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserts(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                to = NEXT[state]
                better(ways, to, (cost + 3, audit + "I", (lines, f"{NAME[to]}:")))

    for role, text, fault in turns:
        inserts(ways)
        after = {}
        for state, (cost, audit, lines) in ways.items():
            better(after, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            first = role[:1]
            if first in ("u", "a") and NEXT[state] == first or first == "s" and state == "":
                better(after, first, (cost + more, audit + "K", (lines, f"{role}:{text}")))
            to = NEXT[state]
            better(after, to, (cost + 3 + more, audit + "R", (lines, f"{NAME[to]}:{text}")))
        ways = after
    inserts(ways)
    cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
    flat = []
    while lines:
        lines, line = lines
        flat.append(line)
    return cost, audit, flat[::-1]


def expected(rows):
    turns = faults(rows)
    at = [t for t, *_ in rows if t is not None]
    cost, audit, lines = cheapest(turns)
    initials = [role[:1] or " " for role, *_ in turns]
    return (
        max(at) - min(at) + 1 - len(set(at)) if at else 0,
        *(sum(f == k for *_, f in turns) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    ), lines


def conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "assistant"]
    texts = ["Yes.", "No", "", " \t", "Why?", "ä…", "stop! \n", "a. ", "So.", "Go on.", "Well!"]
    out = {}
    for conv in range(250):
        n = rng.randint(1, 14)
        out[conv] = [
            (rng.choice([None, rng.randint(0, 20)]) if conv % 5 == 0 else rng.randint(-3, 30),
             rng.choice(roles[: 2 + conv % 7]), rng.choice(texts) if conv % 3 else f"{rng.random()}{rng.choice('.?,')}")
            for _ in range(n)
        ]
    # One long conversation, over several pieces and ranges, and a much repeated turn.
    out[1000] = [
        (t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"turn {t // 2}{rng.choice('.,')}")
        for t in range(3 * PIECE_TURNS)
    ]
    out[1001] = [(1, "user", "Yes.")] * 3000 + [(2, "assistant", "Yes.")]
    return out


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.fixture(scope="module")
def frame(spark, rows):
    flat = [(c, t, r, x, 7) for c, turns in rows.items() for t, r, x in turns]
    random.Random(2).shuffle(flat)
    return spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, `a.b` int").repartition(7)


def test_repair_is_the_cheapest(frame, rows):
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair(frame).collect()}
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        assert got[conv] == expected(turns)[0], conv
    assert {letter for g in got.values() for letter in g[6]} == set("DIKR")


def test_turns(frame, rows):
    got = {}
    for r in repaired_turns(frame).collect():
        got.setdefault(r.conv_id, {})[r.place] = f"{r.role}:{r.text}"
    for conv, turns in rows.items():
        lines = expected(turns)[1]
        assert got.get(conv, {}) == dict(enumerate(lines)), conv


def test_odd_rows(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair(nothing).count() == 0 == repaired_turns(nothing).count()
    rows = [(None, None, None, None, 1), (None, 2, "user", "A.", 1), (3, 1, "user", "gone", 0), (4, 1, "user", "x", None),
            (5, -(2**63), "user", "Hi.", 1), (5, 2**63 - 1, "assistant", "Hi.", 2)]
    out = conversation_repair(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int"), copies="n")
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert got[None] == expected([(None, " ", " "), (2, "user", "A.")])[0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3] == got[4] == empty
    assert got[5][0] == 2**63 - 1 and got[5][6] == "KKD"  # the gap is as large as a long can say


def test_query(spark, rows, tmp_path):
    flat = [(c if c else None, t, r or None, x or None) for c, turns in rows.items() if c < 1000 for t, r, x in dict(
        (t, (t, r, x)) for t, r, x in turns).values()]
    spark.createDataFrame(flat, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    damaged = {}
    for conv, turn, role, text in flat:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        row = (turn, "user" if kind == 4 else role, text)
        damaged.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(kind, 1))
    got = {r.conv_id: tuple(r)[1:] for r in q_conversations.query(spark, str(tmp_path)).collect()}
    assert got == {conv: expected(turns)[0] for conv, turns in damaged.items()}
