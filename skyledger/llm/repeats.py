"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document. It is removed if the same words also start earlier, in a
document of smaller id or further ahead in the same one. Comparing all windows of a corpus at full length would ship every
place of every text, so short windows go first: a window can only repeat if the shorter windows in it repeat.

Levels have ``first``, ``2 * first``, ... words, up to ``window``. On each level but the last, every full window that is still
a candidate is stood for by the smallest hash among the level's windows inside it (equal windows choose equal ones), and
survives if that short window occurs twice in the corpus. On the last level the candidates themselves are compared, with
96 bits of hash, and each learns whether it is the earliest one. A level of which nothing survives ends the search for that
group of documents at once.

Documents are dealt to groups of a few MB once; all levels read that one exchange. A group sends each hash once, however often
it has it, packed per hash range, and gets back those that repeat. A passage that a third of all documents share is
therefore one entry per group, and no set of places is ever gathered.

Null text has no words; an empty text stays empty. Rows that share a doc_id are ordered by a hash of their text, and equal rows
stand one after the other. A null doc_id comes after all others. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, binary, bucket_of, cells, chunk_of, n_chunks, strings
from .words import PLAIN, Slice, chosen, slices, whole, windows, winnow

WINDOW = 20
FIRST = 5
NO_ID = np.iinfo(np.int64).max

_PIECES = "bucket int, chunk int, level int, data binary"
_ANSWERS = "chunk int, level int, bucket int, data binary"
_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def levels(window: int, first: int) -> list[int]:
    out = [window]
    while out[0] > first and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    return out


def sorted_docs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids, tie breakers and texts of a group, in the order in which windows count as earlier."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    ties = table.column("tie").to_numpy()
    order = np.lexsort((ties, ids))
    return ids[order], ties[order], table.column("text").take(pa.array(order)).combine_chunks()


def survivors(piece: Slice, words: np.ndarray, lengths: list[int], repeated: list[np.ndarray], window: int) -> np.ndarray:
    """Which full windows of the slice are candidates after the levels answered so far."""
    alive = whole(piece.text, window)
    for size, known in zip(lengths, repeated):
        if not alive.any():
            break
        hashes = windows(words, size)
        places = winnow(hashes, alive, window - size + 1)
        hit = np.zeros(len(hashes), bool)
        hit[places] = np.isin(hashes[places] >> np.uint64(1), known)
        alive &= hit[chosen(hashes, window - size + 1)]
    return alive


def answered(table: pa.Table, n_levels: int) -> list[np.ndarray]:
    """Repeated hashes of the levels before the last, sorted."""
    out: list[list[bytes]] = [[] for _ in range(n_levels)]
    for level, data in zip(table.column("level").to_pylist(), binary(table, "data")):
        if level < n_levels:
            out[level].append(data)
    return [np.sort(np.frombuffer(b"".join(x), np.uint64)) for x in out]


def pieces(chunk: int, level: int, buckets: np.ndarray, columns: list[np.ndarray]) -> list[dict]:
    order = np.argsort(buckets, kind="stable")
    return [
        {"bucket": b, "chunk": chunk, "level": level, "data": b"".join(c[at].tobytes() for c in columns)}
        for b, at in cells(order, buckets[order])
    ]


def table_of(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))]))


def send_short(docs: pa.Table, answers: pa.Table | None, *, lengths: list[int], level: int, n: int) -> pa.Table:
    """Hashes that stand for a group's candidates on a level, each once; the low bit tells whether the group has it twice."""
    chunk, window, size = docs.column("chunk")[0].as_py(), lengths[-1], lengths[level]
    known = answered(answers, level) if answers is not None else []
    found = [np.empty(0, np.uint64)]
    _, _, texts = sorted_docs(docs)
    for piece in slices(texts, PLAIN):
        words = piece.hashes()
        alive = survivors(piece, words, lengths, known, window)
        hashes = windows(words, size)
        found.append(hashes[winnow(hashes, alive, window - size + 1)])
    values, counts = np.unique(np.concatenate(found) | np.uint64(1), return_counts=True)
    values = np.where(counts > 1, values, values & ~np.uint64(1))
    return table_of(pieces(chunk, level, bucket_of(values, n), [values]), _PIECES)


def answer_short(table: pa.Table) -> pa.Table:
    """For each group, those of its hashes that some group has twice or that two groups have."""
    parts = [np.frombuffer(x, np.uint64) for x in binary(table, "data")]
    values = np.concatenate(parts)
    keys = values >> np.uint64(1)
    unique, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[place[(values & np.uint64(1)) == 1]] = True
    rows, at = [], 0
    for chunk, level, bucket, part in zip(*(table.column(c).to_pylist() for c in ("chunk", "level", "bucket")), parts):
        hits = keys[at : at + len(part)][twice[place[at : at + len(part)]]]
        at += len(part)
        if len(hits):
            rows.append({"chunk": chunk, "level": level, "bucket": bucket, "data": hits.tobytes()})
    return table_of(rows, _ANSWERS)


class Candidates:
    """The full windows of a group that may repeat: hash, second hash, and the document of each."""

    def __init__(self, docs: pa.Table, known: list[np.ndarray], lengths: list[int]) -> None:
        window = lengths[-1]
        self.ids, self.ties, texts = sorted_docs(docs)
        self.slices: list[tuple[Slice, np.ndarray]] = []
        one, two, doc = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for piece in slices(texts, PLAIN):
            words = piece.hashes()
            at = np.flatnonzero(survivors(piece, words, lengths, known, window))
            self.slices.append((piece, at))
            if len(at):
                one.append(windows(words, window)[at])
                two.append((windows(piece.hashes(1), window, 1)[at] >> np.uint64(32)).astype(np.uint32))
                doc.append(piece.first + piece.text[at])
        self.one, self.two, self.doc = np.concatenate(one), np.concatenate(two), np.concatenate(doc)
        _, first, self.place = np.unique(self.one, return_index=True, return_inverse=True)
        self.first = first  # per distinct hash, its earliest candidate

    def by_bucket(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in the order in which they are sent: by range, and then by place."""
        buckets = bucket_of(self.one[self.first], n)
        order = np.lexsort((self.first, buckets))
        return order, buckets[order]


def send_full(docs: pa.Table, answers: pa.Table, *, lengths: list[int], n: int) -> pa.Table:
    chunk = docs.column("chunk")[0].as_py()
    found = Candidates(docs, answered(answers, len(lengths) - 1), lengths)
    rows = []
    for bucket, at in cells(*found.by_bucket(n)):
        first = found.first[at]
        doc = found.doc[first]
        data = b"".join(x.tobytes() for x in (found.one[first], found.two[first], found.ids[doc], found.ties[doc]))
        rows.append({"bucket": bucket, "chunk": chunk, "level": len(lengths) - 1, "data": data})
    return table_of(rows, _PIECES)


def answer_full(table: pa.Table) -> pa.Table:
    """For each group, one bit per hash it sent: is a window of another group earlier?"""
    parts = binary(table, "data")
    sizes = [len(x) // 28 for x in parts]
    one = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(parts, sizes)])
    two = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(parts, sizes)])
    ids = np.concatenate([np.frombuffer(x, np.int64, n, 12 * n) for x, n in zip(parts, sizes)])
    ties = np.concatenate([np.frombuffer(x, np.int64, n, 20 * n) for x, n in zip(parts, sizes)])
    order = np.lexsort((ties, ids, two, one))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    rows, at = [], 0
    for chunk, level, bucket, n in zip(*(table.column(c).to_pylist() for c in ("chunk", "level", "bucket")), sizes):
        rows.append({"chunk": chunk, "level": level, "bucket": bucket, "data": np.packbits(later[at : at + n]).tobytes()})
        at += n
    return table_of(rows, _ANSWERS)


def without_repeats(docs: pa.Table, answers: pa.Table, *, lengths: list[int], n: int) -> pa.Table:
    """Each document of a group without the words of its repeated windows."""
    last, window = len(lengths) - 1, lengths[-1]
    found = Candidates(docs, answered(answers, last), lengths)
    bits = {b: x for level, b, x in zip(answers.column("level").to_pylist(), answers.column("bucket").to_pylist(), binary(answers, "data")) if level == last}
    elsewhere = np.zeros(len(found.first), bool)
    for bucket, at in cells(*found.by_bucket(n)):
        elsewhere[at] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(at))
    repeated = elsewhere[found.place]
    repeated |= found.first[found.place] != np.arange(len(found.one))

    data, lengths_out, n_words, n_removed, edges, n_edges = [], [], [], [], [], []
    at = 0
    for piece, places in found.slices:
        hits = places[repeated[at : at + len(places)]]
        at += len(places)
        cover = np.zeros(len(piece.starts) + 1, np.int32)
        np.add.at(cover, hits, 1)
        np.subtract.at(cover, hits + window, 1)
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.flatnonzero(~gone)
        offsets = piece.offsets()
        n_words.append(piece.counts)
        n_removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets]))
        # Bytes that stay: the kept words, and after each but a text's last one the separator, as a space.
        bytes_in = piece.data.copy()
        mask = np.zeros(len(bytes_in) + 1, np.int8)
        mask[piece.starts[kept]] += 1
        mask[piece.ends[kept]] -= 1
        mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
        spaces = piece.ends[kept[:-1]][piece.text[kept[1:]] == piece.text[kept[:-1]]] if len(kept) else np.empty(0, np.int64)
        bytes_in[spaces] = 0x20
        mask[spaces] = True
        data.append(bytes_in[mask])
        doc_bytes = np.zeros(len(piece.counts), np.int64)
        np.add.at(doc_bytes, piece.text[kept], piece.ends[kept] - piece.starts[kept])
        last_of = piece.text[kept[:-1]][piece.text[kept[1:]] == piece.text[kept[:-1]]] if len(kept) else np.empty(0, np.int64)
        np.add.at(doc_bytes, last_of, 1)
        lengths_out.append(doc_bytes)
        # Removed stretches, as word numbers within the document.
        fresh = np.concatenate(([True], piece.text[1:] != piece.text[:-1])) if len(gone) else gone
        ends_here = np.concatenate((fresh[1:], [True])) if len(gone) else gone
        begin = np.flatnonzero(gone & (fresh | ~np.concatenate(([False], gone[:-1]))))
        end = np.flatnonzero(gone & (ends_here | ~np.concatenate((gone[1:], [False])))) + 1
        start_of = offsets[piece.text[begin]]
        edges.append((begin - start_of, end - start_of))
        n_edges.append(np.bincount(piece.text[begin], minlength=len(piece.counts)))
    ids = found.ids
    removed = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(np.concatenate(n_edges)))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(np.concatenate([e[k] for e in edges]), pa.int32()) for k in (0, 1)], ["start", "end"]),
    )
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=ids == NO_ID),
            "n_words": pa.array(np.concatenate(n_words), pa.int64()),
            "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
            "kept_text": strings(np.concatenate(data), np.concatenate(lengths_out)).cast(pa.string()),
            "removed": removed,
        }
    )


def nothing(ddl: str) -> pa.Table:
    return table_of([], ddl)


def alone(function):
    def run(docs: pa.Table) -> pa.Table:
        return function(docs, None)

    return run


def guarded(function, ddl: str):
    """A cogroup's side may be empty: answers without documents give nothing."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return function(docs, answers) if docs.num_rows else nothing(ddl)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (words joined by a space) and the removed stretches of words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = levels(window, first)
    n = n_chunks(docs, "text", chunk_bytes)
    groups = (
        docs.withColumn("tie", F.xxhash64("text"))
        .withColumn("chunk", chunk_of(n, "doc_id", "tie"))
        .repartition(n, "chunk")
    )
    answers: DataFrame | None = None
    for level in range(len(lengths) - 1):
        send = partial(send_short, lengths=lengths, level=level, n=n)
        if answers is None:
            sent = groups.groupBy("chunk").applyInArrow(alone(send), _PIECES)
        else:
            sent = groups.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(guarded(send, _PIECES), _PIECES)
        got = sent.groupBy("bucket").applyInArrow(answer_short, _ANSWERS)
        answers = got if answers is None else answers.union(got)
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], _ANSWERS)
    send = partial(send_full, lengths=lengths, n=n)
    sent = groups.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(guarded(send, _PIECES), _PIECES)
    answers = answers.union(sent.groupBy("bucket").applyInArrow(answer_full, _ANSWERS))
    finish = partial(without_repeats, lengths=lengths, n=n)

    def last(docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        return finish(docs_, answers_) if docs_.num_rows else empty_kept()

    return groups.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(last, _KEPT)


def empty_kept() -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", span)]
    ).empty_table()
