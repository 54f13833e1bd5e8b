"""Repair against a recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import repair
from skyledger.llm.catalogue import QUERIES

TABLES = "/root/testdata/sf0.01"
COLUMNS = "conv_id long, turn long, role string, text string"
GOES_ON = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(repair.SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return tuple(out)


def cheapest(rows, found):
    """(cost, audit, repaired rows), over every way to edit."""

    @lru_cache(None)
    def go(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if (last, initial) in GOES_ON:
                    cost, audit, rest = go(i, initial, inserted + 1)
                    ways.append((cost + 5, "I" + audit, ((role, ""), *rest)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, rest = go(i + 1, last, 0)
            ways.append((cost + 2, "D" + audit, rest))
            if found[i] not in ("blank", "duplicate"):
                late = 5 if found[i] == "truncated" else 0
                if (last, role[:1]) in GOES_ON:
                    cost, audit, rest = go(i + 1, role[:1], 0)
                    ways.append((cost + late, "K" + audit, ((role, text), *rest)))
                for initial, given in (("u", "user"), ("a", "assistant")):
                    if (last, initial) in GOES_ON:
                        cost, audit, rest = go(i + 1, initial, 0)
                        ways.append((cost + late + 1, "R" + audit, ((given, text), *rest)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return go(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def in_order(rows):
    return tuple(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))


def plain(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        by_conv[conv].append(tuple(row))
    out = []
    for conv, turns in by_conv.items():
        turns = in_order(turns)
        found, numbers = faults(turns), [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, left = cheapest(turns, found)
        text = "\n".join(f"{role}:{said}" for role, said in left)
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    found = repair.audits(repair.damaged(df), repair.plain_rows(df)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def random_rows(n, seed, longest=12):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "Why?", "cut", "", " \t", None, "Fine. \n", "a "])
            rows.append((conv, draw.choice([turn, turn, turn * 3, None]), role, text))
    return rows


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_repair"](spark, TABLES).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


@pytest.mark.parametrize("segment", [4096, 5, 4, 1])
def test_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    same(spark, random_rows(150, segment))


def test_nulls_copies_and_other_columns(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (5, None, None, None), *[(6, 1, "user", "Same.")] * 90]
    same(spark, rows)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"place": F.lit("x"), "fault": F.lit(1), "a.b": F.lit(2)})
    found = repair.audits(repair.damaged(df), repair.plain_rows(df)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert repair.audits(repair.damaged(df), repair.plain_rows(df)).collect() == []


def test_tables_by_rows_and_blocks():
    found = repair.tables()
    draw = np.random.default_rng(7)
    for n in (1, 3, 4, 5, 23):
        symbols = draw.integers(0, repair.N_SYMBOLS, n)
        ahead, cost = found.function(symbols)
        for vector in range(len(found.vectors)):
            at, total = vector, 0
            for s in symbols[::-1].tolist():
                total, at = total + int(found.step_cost[at, s]), int(found.step[at, s])
            assert (at, total) == (ahead[vector], cost[vector])


def test_trace_equals_every_way():
    draw, found = random.Random(2), repair.tables()
    for _ in range(1500):
        n = draw.randint(1, 13)
        roles = [draw.choice(["system", "user", "assistant", "tool", ""]) for _ in range(n)]
        marks = tuple(draw.choice([None, None, None, "blank", "duplicate", "truncated"]) for _ in range(n))
        initials = [repair.INITIALS.find(r[:1]) if r[:1] and r[:1] in repair.INITIALS else 3 for r in roles]
        symbols = [0 if m in ("blank", "duplicate") else 1 + 2 * i + (m == "truncated") for i, m in zip(initials, marks)]
        edits, state, cost = found.trace(np.array(symbols), found.end, repair.START)
        audit = re.sub("[a-z]", "", "".join(edits) + repair.ENDING[state])
        assert (cost, audit) == cheapest(tuple((0, r, "x") for r in roles), marks)[:2]


def test_repaired_rows_are_legal(spark):
    rows = random_rows(60, 9)
    found = {}
    for r in repair.repair(spark.createDataFrame(rows, COLUMNS)).orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(r)
    assert found
    for turns in found.values():
        assert [r.place for r in turns] == list(range(1, len(turns) + 1))
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in turns))
