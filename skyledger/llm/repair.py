"""Repair of conversation structure: the cheapest edits that make a conversation's roles legal, by Four-Russians block tables.

Roles are legal if their initials read ``(s?(ua)+)?``. A row is kept (0), given the role that fits, user or assistant (1), or deleted (2); rows
with a fault, blank or a repetition of an earlier row, have to be deleted, and a truncated row that stays costs 5 more. An empty row of
either role may be inserted anywhere (5). Of all cheapest ways that is taken whose letters (D, I, K, R) in order come first.

What lies behind a place in a conversation matters only by what it costs to go on from each of four states: at the start, after a system, a
user and an assistant turn. These four costs differ by a few units at most, so taken relative to the least of them there are some
dozens of such vectors, whatever the length. A row is one of nine symbols, and for every vector and every block of four symbols a
table has the vector ahead of the block and the cost that is added. Conversations are worked through from the end, one lookup per block. On the
way forward a block is expanded: the vectors inside it, from its right border backward, then for each row the first letter in
order whose cost is exactly what the vectors allow. As the letter is chosen by what lies ahead, ties are settled rightly.

Rows are numbered along ranges of (conversation, turn) and their symbols gathered in segments of 4,096 rows. A segment of a longer conversation first becomes a
function, from the vector behind it to that ahead of it, in a task of its own; a scan over these functions, a few per conversation, gives
each segment its vector. Texts stay with their rows. Only the digest of a repaired conversation is one stream, whose memory is bounded.

Null roles and texts are one blank. Turns without a number come first; rows of equal turn are ordered by role and text, so equal rows
stand side by side. Rows without a conv_id are one conversation. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ranks import numbered

from .shared import partitions, stored

BLOCK = 4
SEGMENT = 4096
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = "uuau"  # the role that is given or inserted in each state
ENDING = {START: "", SYSTEM: "IuIa", USER: "Ia", ASSISTANT: ""}
INITIALS = "sua"
N_SYMBOLS = 1 + 2 * (len(INITIALS) + 1)  # to be deleted; else by initial, whole or truncated
LEGAL_PAIRS = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

_FUNCTIONS = "conv string, seg long, ahead array<int>, cost array<int>"
_BORDERS = "conv string, seg long, vector int, behind long, is_last boolean"
_TRACED = "conv string, seg long, edits array<string>, illegal long, cost long"


class Tables:
    """Vectors of costs by number, and what a row or block of rows makes of them."""

    def __init__(self) -> None:
        ending = self.with_inserts([0, 99, 99, 0])
        self.vectors: list[tuple[int, ...]] = []
        known: dict[tuple[int, ...], int] = {}

        def number(costs: list[int]) -> tuple[int, int]:
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in known:
                known[vector] = len(self.vectors)
                self.vectors.append(vector)
            return known[vector], least

        self.end, _ = number(ending)
        ahead, cost, self.choices = [], [], []
        for vector in self.vectors:  # grows on the way
            for symbol in range(N_SYMBOLS):
                costs = self.before(vector, symbol)
                found, least = number(costs)
                ahead.append(found)
                cost.append(least)
                self.choices.append([self.choose(vector, symbol, costs, state) for state in range(4)])
        shape = (len(self.vectors), N_SYMBOLS)
        self.step = np.array(ahead, np.int32).reshape(shape)
        self.step_cost = np.array(cost, np.int32).reshape(shape)
        block, block_cost = self.step, self.step_cost
        for _ in range(BLOCK - 1):
            # One more symbol ahead of the block, as its most significant digit.
            added = self.step[block], self.step_cost[block] + block_cost[:, :, None]
            block, block_cost = (x.transpose(0, 2, 1).reshape(shape[0], -1) for x in added)
        self.block, self.block_cost = block, block_cost
        self.weights = N_SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    @staticmethod
    def with_inserts(costs: list[int]) -> list[int]:
        for _ in range(3):
            costs = [min(c, INSERT + costs[MOVES[state][NEXT[state]]]) for state, c in enumerate(costs)]
        return costs

    @staticmethod
    def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Edits of a row in the order of their letters: letter with the new role, cost, next state."""
        found = [("D", DELETE, state)]
        if symbol:
            initial, late = (INITIALS + "?")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
            if initial in MOVES[state]:
                found.append(("K", late, MOVES[state][initial]))
            role = NEXT[state]
            found.append(("R" + role, REROLE + late, MOVES[state][role]))
        return found

    def before(self, vector: tuple[int, ...], symbol: int) -> list[int]:
        return self.with_inserts([min(cost + vector[to] for _, cost, to in self.edits(symbol, state)) for state in range(4)])

    def choose(self, vector: tuple[int, ...], symbol: int, costs: list[int], state: int) -> tuple[str, int]:
        """The edits in this state up to and with that of the row, and the state after it."""
        done = ""
        while True:
            best = {edit[0]: (edit, to) for edit, cost, to in self.edits(symbol, state) if cost + vector[to] == costs[state]}
            if "D" not in best and INSERT + costs[MOVES[state][NEXT[state]]] == costs[state]:
                done, state = done + "I" + NEXT[state], MOVES[state][NEXT[state]]
                continue
            edit, to = best[min(best)]
            return done + edit, to

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ahead of the first whole block, and the codes of the blocks."""
        odd = len(symbols) % BLOCK
        return symbols[:odd], symbols[odd:].reshape(-1, BLOCK) @ self.weights

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the rows the one ahead of them, and the cost."""
        first, codes = self.blocks(symbols)
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for table, added, keys in ((self.block, self.block_cost, codes), (self.step, self.step_cost, first)):
            for code in keys[::-1].tolist():
                cost += added[at, code]
                at = table[at, code]
        return at, cost

    def trace(self, symbols: np.ndarray, vector: int, state: int) -> tuple[list[str], int, int]:
        """Edits per row, the state after them, and the cost ahead of the rows relative to that behind them."""
        first, codes = self.blocks(symbols)
        borders, cost = [], 0
        for code in codes[::-1].tolist():
            borders.append(vector)
            cost += int(self.block_cost[vector, code])
            vector = int(self.block[vector, code])
        out: list[str] = []

        def expand(rows: list[int], vector: int) -> int:
            nonlocal state
            behind = []
            for symbol in reversed(rows):
                behind.append(vector)
                vector = int(self.step[vector, symbol])
            for symbol, v in zip(rows, reversed(behind)):
                edit, state = self.choices[v * N_SYMBOLS + symbol][state]
                out.append(edit)
            return vector

        odd, first_vector = first.tolist(), vector
        for symbol in reversed(odd):
            cost += int(self.step_cost[vector, symbol])
            vector = int(self.step[vector, symbol])
        start = state
        expand(odd, first_vector)
        rest = symbols[len(odd) :].tolist()
        for n, border in enumerate(reversed(borders)):
            expand(rest[n * BLOCK : (n + 1) * BLOCK], border)
        return out, state, cost + self.vectors[vector][start]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def columns(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def symbols_of(marks: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and initials, from one character per row."""
    codes = np.frombuffer(marks.encode("ascii"), np.uint8).astype(np.int64) - 48
    return codes >> 2, codes & 3


def segment_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [tables().function(symbols_of(m)[0]) for m in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), *[pa.array([d[k].tolist() for d in done], pa.list_(pa.int32())) for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays(arrays, schema=columns(_FUNCTIONS))


def fold_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation come last first; what lies behind each of them."""
    conv, vector, behind = None, 0, 0
    for batch in batches:
        rows = []
        for name, seg, ahead, cost in zip(*(batch.column(k).to_pylist() for k in range(4))):
            is_last = name != conv
            if is_last:
                conv, vector, behind = name, tables().end, 0
            rows.append((name, seg, vector, behind, is_last))
            behind, vector = behind + cost[vector], ahead[vector]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns(_BORDERS).types)], schema=columns(_BORDERS))


def trace_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation come in order: the edits of their rows, and on the first one the whole cost."""
    conv, state, last_initial = None, START, None
    for batch in batches:
        rows = []
        for name, seg, marks, vector, behind, is_last in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if name != conv:
                conv, state, last_initial = name, START, None
            symbols, initials = symbols_of(marks)
            if last_initial is not None:
                initials = np.concatenate([[last_initial], initials])
            pairs = initials[:-1] * 4 + initials[1:]
            legal = np.isin(pairs, [INITIALS.index(p[0]) * 4 + INITIALS.index(p[1]) for p in LEGAL_PAIRS])
            last_initial = int(initials[-1])
            edits, state, cost = tables().trace(symbols, vector, state)
            if is_last:
                edits[-1] += ENDING[state]
            rows.append((name, seg, edits, int(len(pairs) - legal.sum()), behind + cost if seg == 0 else 0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns(_TRACED).types)], schema=columns(_TRACED))


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = columns("conv string, repaired_sha256 string")
    conv, digest = None, None
    for batch in batches:
        done = []
        for name, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if name != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], schema=schema)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (conv, digest.hexdigest())], schema=schema)


def conversation() -> Column:
    """The key of a conversation: its number as text, or one blank."""
    return F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" "))


def number_of(conv: Column) -> Column:
    return F.when(conv != " ", conv.cast("long"))


def plain_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text, without nulls but in turn."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(conversation().alias("conv"), F.col("turn").cast("long").alias("turn"), *filled)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `plain_rows` as the query damages them, each by the hash of its conversation and turn."""
    rows = plain_rows(conversations)
    kind = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Numbered rows (place from 0) with their first fault: blank, duplicate, truncated or null."""
    text = F.rtrim("text", F.lit(SPACE))
    end = F.substring(text, -1, 1)
    words = [F.xxhash64(F.lit(k), "role", "text").alias(f"w{k}") for k in (0, 1)]
    placed = numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"])
    placed = stored(placed.select("conv", "turn", (F.col("place") - 1).alias("place"), "role", "text", (text == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut_off"), *words))
    # The first of equal rows is counted out ahead of the shuffle, and found again by its place.
    first = placed.where("NOT blank").groupBy("conv", "w0", "w1").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut_off"), "truncated")
    found = placed.join(first, ["conv", "place"], "left")
    return stored(found.select("conv", "turn", "place", "role", "text", fault.alias("fault")))


def segments(rows: DataFrame) -> DataFrame:
    """conv, seg and one character per row of it: symbol and initial."""
    head = F.substring("role", 1, 1)
    initial = F.lit(len(INITIALS))
    for n, letter in enumerate(INITIALS):
        initial = F.when(head == letter, n).otherwise(initial)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * initial + F.col("fault").isNotNull().cast("int"))
    mark = F.char((48 + 4 * symbol + initial).cast("long"))
    gathered = F.sort_array(F.collect_list(F.struct("place", mark.alias("mark"))))  # a segment's rows at most
    parts = rows.groupBy("conv", F.floor(F.col("place") / SEGMENT).alias("seg")).agg(gathered.alias("marks"))
    return parts.select("conv", "seg", F.array_join(F.col("marks.mark"), "").alias("marks"))


def edits(rows: DataFrame) -> DataFrame:
    """Per segment of `with_faults`: the edits of its rows, the illegal pairs that end in it, and, in the first one, the conversation's cost."""
    n = partitions(rows.sparkSession)
    parts = stored(segments(rows))
    longer = parts.where((F.col("seg") > 0) | (F.length("marks") == SEGMENT)).mapInArrow(segment_functions, _FUNCTIONS)
    borders = longer.repartition(n, "conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(fold_functions, _BORDERS)
    known = parts.join(borders, ["conv", "seg"], "left").select(
        "conv", "seg", "marks", F.coalesce("vector", F.lit(tables().end)).alias("vector"), F.coalesce("behind", F.lit(0)).cast("long").alias("behind"), F.coalesce("is_last", F.lit(True)).alias("is_last")
    )
    return stored(known.repartition(n, "conv").sortWithinPartitions("conv", "seg").mapInArrow(trace_segments, _TRACED))


def repaired(rows: DataFrame, traced: DataFrame) -> DataFrame:
    """The rows after their edits: conv, place and part (their order), role and text."""
    per_row = traced.select("conv", "seg", F.posexplode("edits").alias("n", "edit")).select("conv", (F.col("seg") * SEGMENT + F.col("n")).alias("place"), "edit")
    kept = rows.select("conv", "place", "role", "text").join(per_row.where("edit <> 'D'"), ["conv", "place"])
    parts = kept.select("conv", "place", "role", "text", F.posexplode(F.regexp_extract_all("edit", F.lit("([A-Z][a-z]?)"), 1)).alias("part", "one")).where("one <> 'D'")
    given = F.element_at(F.create_map(*[F.lit(x) for item in ROLES.items() for x in item]), F.substring("one", 2, 1))
    return parts.select("conv", "place", "part", F.when(F.col("one") == "K", F.col("role")).otherwise(given).alias("role"), F.when(F.startswith("one", F.lit("I")), "").otherwise(F.col("text")).alias("text"))


def audits(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Per conversation of ``originals`` (conv): faults, cost, audit and the digest of what is left after the repair of ``rows``."""
    marked = with_faults(rows)
    traced = edits(marked)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("conv").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")])
    letters = F.array_join(F.flatten(F.col("parts.edits")), "")
    ways = traced.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("seg", "edits"))).alias("parts"))
    ways = ways.select("conv", "illegal", "cost", F.regexp_replace(letters, "[a-z]", "").alias("audit"))
    laid = repaired(marked, traced).repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "place", "part")
    digests = laid.select("conv", "role", "text").mapInArrow(digest_rows, "conv string, repaired_sha256 string")
    whole = originals.select("conv").distinct().join(counts, "conv", "left").join(ways, "conv", "left").join(digests, "conv", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select(number_of(F.col("conv")).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role and text."""
    marked = with_faults(plain_rows(conversations))
    rows = numbered(repaired(marked, edits(marked)).withColumnRenamed("place", "row"), ["conv"], ["row", "part"])
    return rows.select(number_of(F.col("conv")).alias("conv_id"), "place", "role", "text")
