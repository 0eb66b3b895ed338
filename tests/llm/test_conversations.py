"""Conversation repair against an exhaustive search, whole and in fragments."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from shopweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, frag string, c string, key string"
WHITE = " \t\n\x0b\x0c\r"


def expected(rows):
    """Brute force: every edit string by cost and then by letters, the first that gives legal roles."""
    seen, facts = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        facts.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # Search over (cost, audit, rows taken, initials so far); only the initials' last one and their being empty matter for what follows.
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        turn = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if facts[i] not in ("blank", "duplicate"):
                late = 3 * (facts[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, turn, (*out, f"{name}:{text}")))
                if role[:1] == turn or (last == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    n = facts.count
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), legal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversation(rng, n):
    texts = ["Yes.", "No!", "", "  ", "cut", "Why?", "cut\n", "Ok. "]
    return [(rng.choice([None, k, k, k + rng.randint(0, 3)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " ", ""]), rng.choice(texts) + rng.choice(["", f"{k}.", f" {k}"])) for k in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("fragment", [4096, 3])
def test_repair(spark, fragment):
    rng = random.Random(4)
    data = {i: conversation(rng, rng.randint(1, 9)) for i in range(120)} | {1000: conversation(rng, 150), None: conversation(rng, 6), 1001: [(1, "user", "Same.")] * 40}
    rows = [(i, *r, "x", "y", "z") for i, own in data.items() for r in own]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), fragment=fragment).collect()}
    assert got == {i: expected(ordered(own)) for i, own in data.items()}


def test_damage(spark):
    """Each fate; nulls are one space, also in the hashed text; a conversation without a row left is returned."""
    rows = [(i, t, r, x) for i in range(60) for t, r, x in [(0, "system", "Hi. You?"), (1, "user", None), (2, None, "So! x"), (None, "assistant", "End.")]]
    fate = lambda i, t: zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
    lonely = next(i for i in range(100, 1000) if fate(i, 7) == 0)
    rows.append((lonely, 7, "user", "Gone."))
    want = {}
    for i, t, r, x in rows:
        k, r, x = fate(i, t), " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want.setdefault(i, [])
        want[i] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in C.repair(frame, damage=True).collect()}
    assert got == {i: expected(ordered(own)) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i, own in want.items()}
    assert got[lonely][6] == "" and C.repair(frame.limit(0), damage=True).count() == 0


def test_block_tables_equal_single_steps():
    t, rng = C.tables(), np.random.default_rng(1)
    assert len(t.vectors) < 200
    for n in (0, 1, 3, 4, 5, 40, 41):
        symbols = rng.integers(0, C.SYMBOLS, n)
        after, total = tuple(t.vectors[t.end].tolist()), 0
        for x in symbols[::-1]:
            after = C._before(after, int(x))
        borders, cost = C.sweep(symbols, t.end)
        assert tuple(cost + t.vectors[borders[0]]) == after
        audit, _ = C.trace(symbols, borders, C.START, True)
        price = {"D": 4, "I": 3, "K": 0, "R": 3}
        kept = [letter for letter in audit if letter != "I"]
        total = sum(price[x] for x in audit) + sum(3 for x, letter in zip(symbols, kept, strict=True) if letter in "KR" and x >= 4)
        assert len(kept) == n and total == after[C.START]
