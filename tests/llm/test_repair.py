"""Conversation repair against a search of all cheapest edit scripts."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from heddle.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GAP = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines): the least (cost, letters) over all scripts, by a search ordered by both."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if role[0] in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", k, role[0], (*lines, f"{role}:")))
        if k == len(rows):
            continue
        role, text, fault = rows[k]
        heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        extra = 5 if fault == "truncated" else 0
        if role[:1] and role[0] in legal:
            heapq.heappush(heap, (cost + extra, audit + "K", k + 1, role[0], (*lines, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in legal:
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", k + 1, new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in harmed(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(GAP)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = cheapest(faulty)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def found(df, **settings):
    got = repair.repair_digests(df, **settings).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got}


def some(r, convs):
    rows = []
    for conv in range(convs):
        turn = r.randint(0, 3)
        for k in range(r.randint(0, 9) if conv else 130):
            turn += r.choice([1, 1, 1, 2, 0])
            role = r.choice(["user", "assistant"][k % 2 :: 1] + ["user", "assistant", "system"]) if r.random() < 0.5 else ["user", "assistant"][k % 2]
            rows.append((conv, turn if r.random() < 0.95 else None, role, r.choice(["Yes.", "No!", "Why?  \n", "cut of", " ", f"Said {r.randint(0, 9)}."])))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_against_a_search(spark, bits):
    r = random.Random(4)
    rows = some(r, 60)
    rows += [(900, 1, None, "No role."), (900, 2, "", "Empty role."), (900, 3, "tool", "Said?"), (901, None, "user", None), (None, None, "user", "A."), (None, 2, "assistant", "B.")]
    rows += [(902, k, "system", "s.") for k in range(5)] + [(903, 1, "user", "x" * 200_000 + "."), (903, 2, "assistant", "Long.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, stretch_bits=bits) == expected(rows)


def test_a_mass_of_one_row_and_one_conversation(spark):
    rows = [(7, 1, "user", "Same.")] * 700 + [(7, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(2, 900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, stretch_bits=5) == expected(rows)


def test_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 5, "x")], SCHEMA + ", _c int, cost string")
    assert found(df) == expected([(1, 1, "user", "Hi.")])
    assert repair.repair_digests(df.limit(0)).isEmpty()


def test_lost_conversations_are_returned(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], SCHEMA)
    assert found(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_tables_chain(spark):
    """The table of a stretch is that of its halves, one after the other."""
    r = random.Random(8)
    for _ in range(300):
        rows = "".join(repair.letter(r.randint(0, 3), r.choice("suax")) for _ in range(r.randint(1, 12)))
        at = r.randint(0, len(rows))
        whole, _ = repair.costs_between([repair.table_of(rows)])
        parts, _ = repair.costs_between([repair.table_of(x) for x in (rows[:at], rows[at:]) if x])
        assert whole == parts
