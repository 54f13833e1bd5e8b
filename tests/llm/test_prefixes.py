"""The prefix trie against one that holds whole rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from skyledger.llm import prefixes
from skyledger.llm.catalogue import QUERIES

TABLES = "/root/testdata/sf0.01"
COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes from (conv_id, turn, role, text), by sequences as they are."""
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            stored[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [(role, text) for _, _, role, text in sorted(turns)] for conv, turns in stored.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = (*own.get(conv - conv % 100, [])[:h], *turns[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows):
    found = prefixes.conversation_trie(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_prefix_trie"](spark, TABLES).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_shared_turns_of_every_depth(spark):
    draw = random.Random(5)
    rows = []
    for conv in draw.sample(range(0, 420), 160):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None])))
    rows += rows[:30]
    same(spark, rows)


def test_nulls_copies_and_long_conversations(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "é😀")]
    rows += [(300, t, "user", "same") for t in range(700)] + [(301, t, "user", "same") for t in range(650)]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1200)]
    same(spark, rows)


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 16)
    same(spark, [(c, 0, "user", "hello") for c in range(500)])


def test_no_rows_and_other_columns(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(1, 0, "user", "a"), (100, 0, "user", "a")]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"place": F.lit("x"), "node": F.lit(1), "a.b": F.lit(2)})
    assert sorted((tuple(r) for r in prefixes.conversation_trie(df).collect()), key=str) == plain(rows)


def test_a_false_fingerprint_is_noticed(spark, monkeypatch):
    """With every turn alike for the first seed, the check of texts sends the work on to the next one."""
    real, seeds = prefixes.turns, []

    def turns(conversations, seed):
        seeds.append(seed)
        found = real(conversations, seed)
        return found.withColumns({f"f{k}": F.lit(1).cast("long") for k in prefixes.LANES}) if seed == 0 else found

    monkeypatch.setattr(prefixes, "turns", turns)
    same(spark, [(1, 0, "user", "a"), (2, 0, "user", "b")])
    assert seeds == [0, 1]


def test_powers():
    for base in prefixes.BASES:
        for n in range(6):
            assert pow(base, n, prefixes.PRIME) * prefixes.inverse(base, n) % prefixes.PRIME == 1


def test_power_column(spark):
    exponents = [0, 1, 15, 16, 17, 255, 4096, 123_456_789, (1 << 39) + 5]
    df = spark.createDataFrame([(e,) for e in exponents], "e long").select(prefixes.power(prefixes.BASES[0], F.col("e")).alias("p"))
    assert [r.p for r in df.collect()] == [pow(prefixes.BASES[0], e, prefixes.PRIME) for e in exponents]
