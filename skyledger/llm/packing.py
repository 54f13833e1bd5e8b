"""Packing documents into sequences of a fixed number of tokens, online by sums of squares.

A document is its token ids, then one id that ends it. As long as a whole window is left of it, a piece fills a sequence of its own. What is
left then, shorter than a window, is placed online: a level array counts the open sequences per fill level, and the piece goes
to the level for which the sum of the squared counts grows least, on top of one of the sequences there (level 0: a new one). Counts
that stay small at all levels mean that nearly every gap is met by a piece of its size. Of equal choices the fullest level is taken.

Sequences that are still open at the end of a task, or when ``max_open`` of them are, would be padded. Those filled up to a power of two need
no padding and stay as they are. The pieces of the others are lined up and cut anew into whole windows, and the tail, shorter than a
window, into powers of two; so no sequence needs padding at all, and a piece is cut more than once only there.

Each task packs the documents of its input partition, so nothing is shuffled and a lost task is run again by itself. It holds the ids of one
document and of the open sequences. A sequence's id is the task's partition and a number within it. Texts are encoded in
stretches of 32,768 characters and more, cut only where the tokenizer's own pattern cuts as well; a tokenizer other than byte-level BPE gets each text as a whole.

Null and empty texts are a document of one id, the ending one. Each row is packed by itself, whatever rows share its doc_id. Other columns are ignored, an empty
table gives no pieces.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
MAX_OPEN = 8192  # open sequences of a task: 32 MB of ids at most
STRETCH = 1 << 15

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(n, pa.binary() if k == "binary" else pa.int64()) for n, k in (x.split() for x in _PIECES.split(", "))])
_BATCH = 4096
# A place where the pattern of byte-level tokenizers always cuts: ahead of a blank between two characters that are no white space.
_WORD_EDGE = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    """Ids of texts by a tokenizer file.

    A byte-level BPE file without options is run by tiktoken: from the same vocabulary and pattern it makes the same ids, as the ids are in the
    order of the merges, at about a quarter of the time. Any other file is run by the tokenizers library, each text as a whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such a string in a text is text
        parts = json.loads(self.tokenizer.to_str())
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and parts["normalizer"] is None
        plain = plain and model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        self.fast = None
        if plain:
            letters, special = byte_alphabet(), {t["content"] for t in parts["added_tokens"]}
            ranks = {bytes(map(letters.__getitem__, word)): n for word, n in model["vocab"].items() if word not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        """The ids, stretch by stretch."""
        if self.fast is None:
            yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            return
        at = 0
        while at < len(text):
            edge = _WORD_EDGE.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            stop = edge.start() if edge else len(text)
            yield self.fast.encode_to_numpy(text[at:stop], disallowed_special=())
            at = stop


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class Packer:
    """Takes documents, hands closed sequences to ``emit``."""

    def __init__(self, emit: Callable[[list[Piece]], None], window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.emit, self.window, self.max_open = emit, window, max_open
        self.counts = np.zeros(window + 1, np.int64)  # open sequences per level; those of level 0 and the full ones don't count
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The level for the piece: adding up (n+1)^2 - n^2 where a sequence arrives and (n-1)^2 - n^2 where it leaves."""
        top = self.window - size
        grows = 2 * self.counts[size : self.window + 1] + 1
        grows[top] = 0  # a full sequence is closed
        grows -= np.where(self.counts[: top + 1] > 0, 2 * self.counts[: top + 1] - 1, 0)
        usable = self.counts[: top + 1] > 0
        usable[0] = True
        grows = np.where(usable, grows, np.iinfo(np.int64).max)
        return top - int(np.argmin(grows[::-1]))

    def place(self, piece: Piece) -> None:
        size = len(piece.ids)
        low = self.level(size)
        if low:
            pieces = self.open[low].pop()
            self.counts[low] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        high = low + size
        if high == self.window:
            self.emit(pieces)
            return
        self.open[high].append(pieces)
        self.counts[high] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.drain()

    def add(self, doc_id: int | None, stretches: Iterator[np.ndarray]) -> None:
        """A document whose ids come in stretches: whole windows at once, the rest by level. ``total`` is set when all is known."""
        whole: list[Piece] = []
        rest, start = np.zeros(0, "<u4"), 0
        for ids in stretches:
            rest = np.concatenate([rest, ids])
            while len(rest) >= self.window:
                whole.append(Piece(doc_id, start, rest[: self.window], 0))
                rest, start = rest[self.window :], start + self.window
        total = start + len(rest)
        for piece in whole:
            piece.total = total
            self.emit([piece])
        if len(rest):
            self.place(Piece(doc_id, start, rest, total))

    def drain(self) -> None:
        """Close all open sequences, without padding."""
        line: deque[Piece] = deque()
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                if level & (level - 1) == 0:
                    self.emit(pieces)
                else:
                    line.extend(pieces)
            self.open[level] = []
        left = sum(len(p.ids) for p in line)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            pieces, room = [], size
            while room:
                piece = line.popleft()
                if len(piece.ids) > room:
                    piece, later = piece.split(room)
                    line.appendleft(later)
                pieces.append(piece)
                room -= len(piece.ids)
            self.emit(pieces)
            left -= size
        self.counts[:] = 0
        self.n_open = 0


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, max_open: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    number = 0

    def emit(pieces: list[Piece]) -> None:
        nonlocal number
        at = 0
        for p in pieces:
            rows.append((p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.total, first + number, at))
            at += len(p.ids)
        number += 1

    def taken() -> Iterator[pa.RecordBatch]:
        while rows:
            part = rows[:_BATCH]
            del rows[:_BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), _SCHEMA.types)], schema=_SCHEMA)

    encoder, packer = Encoder(path), Packer(emit, window, max_open)
    ending = np.asarray([end_id], "<u4")

    def stretches(text: str | None) -> Iterator[np.ndarray]:
        yield from encoder(text or "")
        yield ending

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            packer.add(doc_id, stretches(text.as_py()))
            if len(rows) >= _BATCH:
                yield from taken()
    packer.drain()
    yield from taken()


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (4 bytes each, little-endian), doc_tokens, sequence_id and offset.

    ``vocabulary`` is the path of a tokenizer file, on every executor; by default that of the public byte-level one.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: pack_batches(b, path, window, end_id, max_open), _PIECES)


def padding(length: Column, window: int = WINDOW) -> Column:
    """Ids that pad a sequence of this length: none at a power of two, else up to the window."""
    return F.when(length.bitwiseAND(length - 1) == 0, F.lit(0)).otherwise(F.lit(window) - length)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, n_padding, ids (of all its pieces in order) and starts (the offset of each piece)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a window's ids at most
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", "n_tokens", padding(F.col("n_tokens"), window).alias("n_padding"), joined.alias("ids"), F.col("parts.offset").alias("starts"))
