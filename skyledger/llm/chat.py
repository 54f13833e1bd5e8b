"""Chat formatting in budgeted windows.

A conversation's turns are written with a template: ``### role: text</turn>`` and a line break. Inside texts and roles the characters
that the template's control strings begin with, and the escape itself, get a backslash before them, so nothing in a text can
be taken for a control string and every text can be read back as it was.

Windows hold whole turns. Prefix sums of the turns' tokens tell where a window ends: its new turns go on as long as system turn,
repeated history and new turns stay within ``budget`` tokens. Every window starts with the conversation's system turn, if the first
turn is one, then repeats the latest turns before it as far as ``history`` tokens reach and as they leave room for the first new turn, and then has its new turns. Each turn
is new in exactly one window, and only assistant texts among the new turns are under the loss mask, so repeated targets are masked. Only a
window that repeats nothing and has one new turn may exceed the budget, with its system turn.

Turns are numbered along ranges of (conversation, turn) and written and counted where they lie, so a conversation of any length is spread over
tasks. Windows are chosen on the numbers of tokens alone, in blocks of 4,096 turns that follow each other: a task holds one block and the turns that
may be repeated. Written turns then join the windows that have them. Only the digests read a conversation as one stream, a window at a time.

Null texts are empty, null roles are empty roles, turns without a number come last, and rows of equal turn are ordered by role and text. Rows
without a conv_id are one conversation. Empty tables give no windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ranks import numbered

from .shared import partitions, stored

BUDGET = 512
HISTORY = 128
BLOCK = 4096  # turns whose numbers of tokens are looked at together
# Fixed strings of the template.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPED = re.compile(r"[\\#<]")
ESCAPED_ROLE = re.compile(r"[\\#<:]")
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)
TOKEN = re.compile(r"\w+|[^\w\s]")

_WINDOWS = "conv_id long, window int, text string, n_repeated int, n_turns int, n_tokens int, loss array<struct<start:int,end:int>>"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURNS = "conv_id string, place long, role string, written string, start int, tokens long"
_SPANS = "conv string, window int, first long, new long, end long, has_system boolean"
_SPAN_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


_WINDOW_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int32()), ("loss", SPAN)]
)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], text)


def write_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, place, role, text: each turn as it is written, where its text starts, and its tokens."""
    for batch in batches:
        written, starts, tokens = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            head = OPEN + ESCAPED_ROLE.sub(lambda m: "\\" + m[0], role) + COLON
            written.append(head + escape(text) + CLOSE)
            starts.append(len(head))
            tokens.append(sum(1 for _ in TOKEN.finditer(written[-1])))
        arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(written, pa.string()), pa.array(starts, pa.int32()), pa.array(tokens, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "role", "written", "start", "tokens"])


class Chooser:
    """Numbers of tokens of one conversation's turns, in; spans of windows, out: (first repeated, first new, end)."""

    def __init__(self, budget: int, history: int, system: int | None) -> None:
        self.budget, self.history = budget, history
        self.lead = 1 if system is not None else 0  # the system turn is part of every window
        self.fixed = system or 0
        self.base, self.sums = 0, np.zeros(1, np.int64)  # tokens before each turn from number ``base`` on
        self.new = self.lead

    def add(self, tokens: np.ndarray) -> list[tuple[int, int, int]]:
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(tokens)])
        out = self.closed(False)
        # Turns that no later window repeats are forgotten.
        first = self.repeated() - self.base
        self.base, self.sums = self.base + first, self.sums[first:]
        return out

    def repeated(self) -> int:
        """The first turn that the window of the next new turn may repeat by ``history`` alone."""
        at = self.sums[self.new - self.base]
        first = self.base + int(np.searchsorted(self.sums, at - self.history, "left"))
        return min(max(first, self.lead), self.new)

    def closed(self, all_known: bool) -> list[tuple[int, int, int]]:
        out, known = [], self.base + len(self.sums) - 1
        while self.new < known:
            at = self.sums[self.new - self.base]
            turn = self.sums[self.new + 1 - self.base] - at
            room = max(self.budget - self.fixed - turn, 0)  # for repeated turns
            first = self.base + int(np.searchsorted(self.sums, at - min(room, self.history), "left"))
            first = min(max(first, self.lead), self.new)
            # The last turn that still ends within the budget, but at least one.
            limit = self.sums[first - self.base] + self.budget - self.fixed
            end = max(self.base + int(np.searchsorted(self.sums, limit, "right")) - 1, self.new + 1)
            if end >= known and not all_known:
                break
            out.append((first, self.new, min(end, known)))
            self.new = min(end, known)
        return out


def choose_windows(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation come in order. A system turn alone is a window of its own; else it is new in the first one."""
    conv, chooser, number = None, None, 0
    for batch in batches:
        rows: list[tuple] = []

        def put(spans: list[tuple[int, int, int]]) -> None:
            nonlocal number
            for first, new, end in spans:
                rows.append((conv, number, first, new - chooser.lead if number == 0 else new, end, chooser.lead == 1))
                number += 1

        def finish() -> None:
            put(chooser.closed(True))
            if number == 0:
                rows.append((conv, 0, 0, 0, 1, chooser.lead == 1))

        for name, starts, tokens, is_last in zip(*(batch.column(k).to_pylist() for k in range(4))):
            counts = np.array(tokens, np.int64)
            if chooser is None:
                conv, number = name, 0
                chooser = Chooser(budget, history, int(counts[0]) if starts else None)
            put(chooser.add(counts))
            if is_last:
                finish()
                chooser = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SPAN_TYPES)], names=["conv", "window", "first", "new", "end", "has_system"])


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from their turns in order."""
    for batch in batches:
        rows = []
        for conv, number, turns in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at, loss = 0, []
            for turn in turns:
                if turn["is_new"] and turn["role"] == "assistant":
                    loss.append({"start": at + turn["start"], "end": at + len(turn["written"]) - len(CLOSE)})
                at += len(turn["written"])
            rows.append(
                {
                    "conv_id": None if conv == "" else int(conv),
                    "window": number,
                    "text": "".join(t["written"] for t in turns),
                    "n_repeated": sum(not t["is_new"] for t in turns),
                    "n_turns": len(turns),
                    "n_tokens": sum(t["tokens"] for t in turns),
                    "loss": loss,
                }
            )
        yield pa.RecordBatch.from_pylist(rows, _WINDOW_SCHEMA)


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Whole conversations per partition, one after the other."""
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *by)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated (turns before the new ones), n_turns, n_tokens and the loss mask's stretches."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), "turn", *filled)
    placed = numbered(turns, ["conv"], [F.col("turn").asc_nulls_last(), "role", "text"]).select("conv", (F.col("place") - 1).alias("place"), "role", "text")
    written = stored(placed.mapInArrow(write_turns, _TURNS).withColumnRenamed("conv_id", "conv"))
    sizes = written.groupBy("conv").agg(F.count("*").alias("n"))
    block = F.floor(F.col("place") / BLOCK)
    counts = F.sort_array(F.collect_list(F.struct("place", "tokens")))  # a block's turns at most
    starts = F.max((F.col("place") == 0) & (F.col("role") == "system"))
    blocks = written.groupBy("conv", block.alias("block")).agg(starts.alias("starts"), counts.alias("counts")).join(sizes, "conv")
    blocks = blocks.select("conv", "block", "starts", F.col("counts.tokens").alias("tokens"), ((F.col("block") + 1) * BLOCK >= F.col("n")).alias("is_last"))
    laid = blocks.repartition(partitions(written.sparkSession), "conv").sortWithinPartitions("conv", "block").select("conv", "starts", "tokens", "is_last")
    spans = stored(laid.mapInArrow(lambda b: choose_windows(b, budget, history), _SPANS))
    places = F.sequence(F.col("first"), F.col("end") - 1)
    places = F.when(F.col("has_system") & (F.col("first") > 0), F.concat(F.array(F.lit(0).cast("long")), places)).otherwise(places)
    wanted = spans.select("conv", "window", "new", F.explode(places).alias("place"))
    parts = wanted.join(written, ["conv", "place"]).select("conv", "window", F.struct("place", "role", "written", "start", "tokens", (F.col("place") >= F.col("new")).alias("is_new")).alias("turn"))
    whole = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.mapInArrow(put_together, _WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window; fails if anything in it is no turn."""
    out, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at} of a window")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class Reader:
    """Digests of a conversation, from its windows one after the other."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, n_repeated: int, loss: list[dict]) -> None:
        for role, said in read_turns(text)[n_repeated:]:
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader: Reader | None = None
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _DIGEST.split(", "))])
    for batch in batches:
        rows = []
        for conv_id, text, n_repeated, loss in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    rows.append(reader.row())
                reader = Reader(conv_id)
            reader.add(text, n_repeated, loss)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if reader is not None:
        yield pa.RecordBatch.from_pylist([reader.row()], schema)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows say when read back."""
    return in_order(windows, "window").select("conv_id", "text", "n_repeated", "loss").mapInArrow(read_windows, _DIGEST)
