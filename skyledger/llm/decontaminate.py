"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, letters and characters beyond ASCII. A benchmark window is ``window`` consecutive words of an
item; an item of fewer words is one window of its own length. Of every window the smallest hash of its ``gram``-word pieces is
its fingerprint, in documents as in items, so each shared window has a shared fingerprint: nothing of that length is missed.

Fingerprints of documents meet a bitmap of the items' fingerprints first. The bitmap has a fixed size (``BITS``), whatever the size of the
benchmark, so broadcasting it is bounded; with many items it only filters less. What passes is joined with the items' fingerprints by
Spark, and each hit is extended to both sides, word by word, as far as a window reaches. Items shorter than a window are looked up by all
document pieces of that length, which is winnowing with windows of one piece.

Null and wordless texts and items have no words and no hits. Rows that share doc_id and text get the same result, one each;
items of equal words are joined as one and told apart at the end. Columns beyond the two that are read are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import LETTERS, slices, whole, windows, winnow

WINDOW = 10
GRAM = 5
BITS = 1 << 24
PIECE_BITS = 1 << 19

_ITEMS = "item_id long, size int, fingerprint long, words binary, class binary"
_SCANNED = "doc_id long, tie long, n_words long, hits array<struct<size:int,fingerprint:long,places:binary,words:binary>>"
_SPANS = "doc_id long, tie long, class binary, start int, end int"
OUTSIDE_DOC, OUTSIDE_ITEM = np.uint64(1), np.uint64(2)  # stand for the words before and after a text; they never match


def around(words: np.ndarray, text: np.ndarray, places: np.ndarray, window: int, gram: int, outside: np.uint64) -> np.ndarray:
    """For each place, the words of every window that holds the piece there: a row of ``2 * window - gram`` hashes."""
    reach = window - gram
    at = places[:, None] + np.arange(-reach, gram + reach)
    inside = (at >= 0) & (at < len(words))
    at = np.clip(at, 0, max(0, len(words) - 1))
    return np.where(inside & (text[at] == text[places][:, None]), words[at], outside)


def item_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("fingerprint", pa.int64()), ("words", pa.binary()), ("class", pa.binary())])
    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for piece in slices(batch.column(1), LETTERS, lower=True):
            words, other = piece.hashes(), piece.hashes(1)
            offsets = piece.offsets()
            hashes = windows(words, gram)
            places = winnow(hashes, whole(piece.text, window), window - gram + 1)
            near = around(words, piece.text, places, window, gram, OUTSIDE_ITEM)
            where = piece.text[places]
            for k in range(piece.last - piece.first):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if a == b:
                    continue
                # All words of an item, through two hash families: items of one class have equal words.
                known = windows(words[a:b], b - a).tobytes() + windows(other[a:b], b - a, 1).tobytes()
                item = {"item_id": ids[piece.first + k], "class": known}
                if b - a < window:
                    fingerprint = windows(words[a:b], b - a)[0].view(np.int64)
                    rows.append(item | {"size": b - a, "fingerprint": int(fingerprint), "words": words[a:b].tobytes()})
                    continue
                for at in np.flatnonzero(where == k):
                    rows.append(item | {"size": window, "fingerprint": int(hashes[places[at]].view(np.int64)), "words": near[at].tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema)


def bit_of(fingerprints: np.ndarray, size: int) -> np.ndarray:
    """Bit of a fingerprint; pieces of different lengths have different hashes already."""
    return (fingerprints * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(size - 1)


def bitmap(items: DataFrame, bits: int = BITS) -> bytes:
    """Bits of all item fingerprints. Tasks and groups merge them, so the driver gets ``bits / 8`` bytes at most."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[bit_of(batch.column(0).to_numpy().view(np.uint64), bits)] = True
        for k in range(0, bits, PIECE_BITS):
            if seen[k : k + PIECE_BITS].any():
                data = np.packbits(seen[k : k + PIECE_BITS]).tobytes()
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // PIECE_BITS], pa.int32()), "data": pa.array([data], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()]
        data = np.bitwise_or.reduce(parts).tobytes()
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    marked = items.select("fingerprint").mapInArrow(mark, "piece int, data binary")
    out = bytearray(bits // 8)
    for row in marked.groupBy("piece").applyInArrow(merge, "piece int, data binary").collect():
        at = row.piece * (PIECE_BITS // 8)
        out[at : at + len(row.data)] = row.data
    return bytes(out)


def scan(batches: Iterator[pa.RecordBatch], bits: Broadcast, shorter: list[int], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, and the fingerprints that the bitmap knows, with the words around them."""
    known = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
    fields = [("size", pa.int32()), ("fingerprint", pa.int64()), ("places", pa.binary()), ("words", pa.binary())]
    for batch in batches:
        counts, found = [np.empty(0, np.int64)], [[] for _ in range(batch.num_rows)]
        for piece in slices(batch.column(2), LETTERS, lower=True):
            counts.append(piece.counts)
            words, offsets = piece.hashes(), piece.offsets()
            hashes = windows(words, gram)
            places = winnow(hashes, whole(piece.text, window), window - gram + 1)
            places = places[known[bit_of(hashes[places], len(known))]]
            near = around(words, piece.text, places, window, gram, OUTSIDE_DOC)
            for at, place in enumerate(places.tolist()):
                doc = int(piece.text[place])
                found[piece.first + doc].append((window, int(hashes[place].view(np.int64)), np.int32(place - offsets[doc]).tobytes(), near[at].tobytes()))
            for size in shorter:
                hashes = windows(words, size)
                places = np.flatnonzero(whole(piece.text, size))
                places = places[known[bit_of(hashes[places], len(known))]]
                order = np.lexsort((places, hashes[places], piece.text[places]))  # one entry per document and piece
                places = places[order]
                docs, keys = piece.text[places], hashes[places]
                edges = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])))) if len(places) else []
                for a, b in zip(edges, [*edges[1:], len(places)]):
                    doc = int(docs[a])
                    at = (places[a:b] - offsets[doc]).astype(np.int32)
                    found[piece.first + doc].append((size, int(keys[a].view(np.int64)), at.tobytes(), words[places[a] : places[a] + size].tobytes()))
        flat = [x for hits in found for x in hits]
        hits = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()),
            pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields]),
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.concatenate(counts), pa.int64()), hits], ["doc_id", "tie", "n_words", "hits"]
        )


def extend(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Joined pairs of words around a fingerprint to stretches of document words that an item has too."""
    reach = window - gram
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        places, doc_words, item_words = (batch.column(k).to_pylist() for k in (3, 4, 5))
        rows, starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        full = np.flatnonzero(sizes == window)
        if len(full):
            a, b = (np.frombuffer(b"".join(x[k] for k in full), np.uint64).reshape(len(full), -1) for x in (doc_words, item_words))
            at = np.frombuffer(b"".join(places[k] for k in full), np.int32)
            same = a == b
            left = np.minimum.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.minimum.accumulate(same[:, reach + gram :], axis=1).sum(axis=1)
            ok = same[:, reach : reach + gram].all(axis=1) & (left + right >= reach)
            rows.append(full[ok])
            starts.append((at - left)[ok])
            ends.append((at + gram + right)[ok])
        for k in np.flatnonzero(sizes < window):
            if doc_words[k] == item_words[k]:
                at = np.frombuffer(places[k], np.int32)
                rows.append(np.full(len(at), k))
                starts.append(at)
                ends.append(at + np.int32(sizes[k]))
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), batch.column(6).take(take)]
            + [pa.array(np.concatenate(x), pa.int32()) for x in (starts, ends)],
            ["doc_id", "tie", "class", "start", "end"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, tie (hash of the text), n_words, n_hit, n_items, items (as text, sorted) and contaminated."""
    spark = docs.sparkSession
    items = cut(
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(lambda batches: item_rows(batches, window, gram), _ITEMS)
    )
    shorter = sorted(r[0] for r in items.filter(F.col("size") < window).select("size").distinct().collect())  # fewer than window
    known = spark.sparkContext.broadcast(bitmap(items, bits))
    scanned = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("tie"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda batches: scan(batches, known, shorter, window, gram), _SCANNED)
    )
    hits = scanned.select("doc_id", "tie", F.inline("hits")).distinct()
    prints = items.select("size", "fingerprint", F.col("words").alias("item_words"), "class").distinct()
    spans = cut(
        hits.join(prints, ["size", "fingerprint"])
        .select("doc_id", "tie", "size", "places", "words", "item_words", "class")
        .mapInArrow(lambda batches: extend(batches, window, gram), _SPANS)
        .distinct()
    )
    covered = (
        spans.select("doc_id", "tie", F.explode(F.sequence("start", F.col("end") - 1)).alias("place"))
        .distinct()
        .groupBy("doc_id", "tie")
        .agg(F.count("*").alias("n_hit"))
    )
    members = items.select("class", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = (
        spans.select("doc_id", "tie", "class")
        .distinct()
        .join(members, "class")
        .select("doc_id", "tie", "item_id")
        .distinct()
        .groupBy("doc_id", "tie")
        .agg(F.count("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    )
    found = covered.alias("c").join(named.alias("n"), F.expr("c.doc_id <=> n.doc_id and c.tie = n.tie")).select("c.*", "n_items", "items")
    return (
        scanned.alias("s")
        .join(found.alias("f"), F.expr("s.doc_id <=> f.doc_id and s.tie = f.tie"), "left")
        .select(
            "s.doc_id",
            "s.tie",
            "s.n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.lit("")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that share no window with a benchmark item."""
    bad = contamination(docs, benchmark, window, gram).filter("contaminated").select("doc_id", "tie").distinct().alias("b")
    return docs.alias("d").join(bad, F.expr("d.doc_id <=> b.doc_id and xxhash64(d.text) = b.tie"), "left_anti")
