"""Conversation repair: the run-length program and the whole query against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversations, role_repair

DUE = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}


def cheapest(rows):
    """Dijkstra over (rows done, state); rows are (initial, must go, cut off). The heap's order breaks ties."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, done, state = heapq.heappop(heap)
        if (done, state) in seen:
            continue
        seen.add((done, state))
        if done == len(rows) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", done, DUE[state]))
        if done < len(rows):
            initial, gone, cut = rows[done]
            heapq.heappush(heap, (cost + 3, audit + "D", done + 1, state))
            if not gone:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", done + 1, DUE[state]))
                fits = {"s": (0,), "u": (0, 1, 3), "a": (2,)}.get(initial, ())
                if state in fits:
                    heapq.heappush(heap, (cost + cut, audit + "K", done + 1, {"s": 1, "u": 2, "a": 3}[initial]))
    raise AssertionError


def symbol(initial, gone, cut):
    return role_repair.GONE if gone else 2 * "sua".find(initial) % 8 + cut if initial in "sua" else 2 * role_repair.OTHER + cut


KINDS = [*((i, False, c) for i in "suax" for c in (0, 1)), ("u", True, 0)]


def test_program_equals_brute_force():
    rng = random.Random(3)
    for n in range(4):
        for rows in itertools.product(KINDS, repeat=n):
            assert role_repair.solve(role_repair.shortened(symbol(*r) for r in rows)) == cheapest(rows)
    for _ in range(400):
        rows = [r for _ in range(rng.randint(1, 12)) for r in [rng.choice(KINDS)] * rng.choice([1, 1, 2, 9])]
        assert role_repair.solve(role_repair.shortened(symbol(*r) for r in rows)) == cheapest(rows)


@pytest.mark.parametrize("length", [1, 2, 1023, 1024, 1025, 5000])
def test_long_runs(length):
    """Beyond the block that is unrolled at once."""
    rows = [("u", False, 1)] * length
    assert role_repair.solve([(symbol(*rows[0]), length)]) == cheapest(rows)


def expected(turns):
    """The contract row by row: turns are (conv, turn, role, text)."""
    talks = {}
    for conv, turn, role, text in turns:
        talk = talks.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        talk += [] if draw == 0 else [(turn, role, text)] * (2 if draw == 3 else 1)
    out = set()
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        numbers = [t for t, _, _ in talk if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in talk:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest(rows)
        state, made, left = 0, [], iter(talk)
        for edit in audit:
            if edit == "I":
                state = DUE[state]
                made.append(f"{NAMES[state]}:")
                continue
            _, role, text = next(left)
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                made.append(f"{role}:{text}")
            elif edit == "R":
                state = DUE[state]
                made.append(f"{NAMES[state]}:{text}")
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


NAMES_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_on_the_small_table(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    found = conversations.query(spark, small)
    assert found.columns == NAMES_OUT
    assert sorted(map(tuple, found.collect())) == sorted(expected(turns))


def messy_turns():
    rng = random.Random(5)
    texts = [None, "", "  \n", "Well.", "Well", "what?", "no end\t", "tail. \x0b", "x" * 50_000 + ".", "Größe 日本!", " "]
    roles = [None, "", "system", "user", "assistant", "tool", "User", "superb"]
    out = [(rng.choice([None, 1, 2, 3, 4, 77, -5]), rng.choice([None, 0, 1, 2, 3, 9, 10**12]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    out += [(100 + c, t, rng.choice(roles[2:5]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    return out + out[:20]


def test_query_on_messy_turns(spark):
    turns = messy_turns()
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for name in ["conv", "phase", "digest", "first", "fault", "of", "r", "d", "n", "absent", "copy", "draw", "odd name-1"]:
        df = df.withColumn(name, F.lit("clash"))
    found = conversations.repair_conversations(conversations.damaged(df.repartition(5)), absent_col="absent")
    assert set(map(tuple, found.collect())) == expected(turns)
    assert found.count() == len({t[0] for t in turns})
    made = conversations.repaired_turns(conversations.damaged(df), absent_col="absent").collect()
    talks = {}
    for r in sorted(made, key=lambda r: (str(r.conv_id), r.place)):
        talks.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    hashes = {r.conv_id: r.repaired_sha256 for r in found.collect()}
    for conv, rows in talks.items():
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert hashlib.sha256("\n".join(t for _, t in rows).encode()).hexdigest() == hashes[conv]


def test_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair_conversations(conversations.damaged(empty), absent_col="absent").count() == 0
    assert conversations.repaired_turns(empty).count() == 0


def test_one_hot_conversation(spark):
    """Half of all turns in one conversation, a third of them the same text."""
    turns = [(0, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 == 0 else f"Turn {t}.") for t in range(6_000)] + [(1 + t // 4, t % 4, "user", "a.") for t in range(2_000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    found = conversations.repair_conversations(conversations.damaged(df), absent_col="absent")
    assert set(map(tuple, found.collect())) == expected(turns)
