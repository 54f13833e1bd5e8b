"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label. Every passage is encoded: shares of its kinds of
characters, the lengths and the repetition of its words, and a hashed bag of its words go through one hidden layer. Gated attention
(tanh times sigmoid) weighs the passages of a document, and the weighted sum of their codes is scored. All of it is learned
together from document labels, so a document that is junk in one part only is found by that part.

Learning uses at most ``max_rows`` labelled documents, those with the smallest hashes of their ids, never one with
crc32(doc_id as text) divisible by 5. The encoded sample is bounded by that number and fits the driver; scoring runs
over all documents in Arrow batches with the model's few thousand numbers. Label, language, source and id are no inputs.

Null texts and texts without words are bags of one empty passage and get a score too. Without labels, or with labels of one kind
only, every score is the share of label 1 (0.5 without labels). Labels that are null, and rows without an id, teach nothing. Columns
go along; names that start with ``mil_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns_of, map_rows, stored
from .words import PLAIN, slices

PASSAGE = 48  # words
MAX_ROWS = 8000
MAX_BYTES = 256 << 20  # of their encoded passages, 432 bytes for 48 words
FOLDS = 5
THRESHOLD = 0.3
HASHED = 64
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.01, 1e-4

PUNCTUATION = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]


def kinds() -> np.ndarray:
    """Kind of each byte: control, small, capital, digit, space, line break, beyond ASCII, and each punctuation mark."""
    out = np.zeros(256, np.int64)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x20], out[[0x0A, 0x0D]], out[0x80:] = 1, 2, 3, 4, 5, 6
    out[PUNCTUATION] = np.arange(7, 7 + len(PUNCTUATION))
    return out


KINDS = kinds()
N_KINDS = 7 + len(PUNCTUATION)
WIDTH = N_KINDS + 5 + HASHED


def encode_inputs(texts: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the encoder: one row per passage, and the number of passages of each text (at least 1)."""
    rows, counts = [np.empty((0, WIDTH), np.float32)], [np.empty(0, np.int64)]
    for piece in slices(texts, PLAIN):
        n_texts = piece.last - piece.first
        per_text = np.maximum(1, -(-piece.counts // passage))
        firsts = np.concatenate(([0], np.cumsum(per_text)))
        n = int(firsts[-1])
        offsets = piece.offsets()
        in_text = np.arange(len(piece.starts)) - offsets[piece.text]
        of_word = firsts[piece.text] + in_text // passage
        # Bytes belong to the passage whose first word started last; what precedes a text's first word, to its first passage.
        begins = np.flatnonzero(in_text % passage == 0)
        marks = np.zeros(len(piece.data) + 1, np.int64)
        moved = begins[in_text[begins] > 0]
        np.add.at(marks, piece.starts[moved], 1)
        np.add.at(marks, piece.bounds[1:n_texts], 1)
        of_byte = np.cumsum(marks[:-1])
        shares = np.bincount(of_byte * N_KINDS + KINDS[piece.data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(np.float32)
        n_bytes = shares.sum(axis=1, keepdims=True)
        n_words = np.bincount(of_word, minlength=n).astype(np.float32)
        hashes = piece.hashes()
        some = np.maximum(n_words, 1)
        lengths = np.bincount(of_word, weights=piece.ends - piece.starts, minlength=n) / some
        keys = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
        distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / some
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1]))
        repeats = np.bincount(of_word[again], minlength=n) / some
        bag = np.bincount(of_word * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        words = np.stack([n_words / passage, np.minimum(lengths, 50) / 10, distinct, repeats, np.log1p(n_bytes[:, 0])], axis=1)
        rows.append(np.concatenate([shares / np.maximum(n_bytes, 1), words, bag / some[:, None]], axis=1).astype(np.float32))
        counts.append(per_text)
    return np.concatenate(rows), np.concatenate(counts)


@dataclass
class Model:
    """Numbers of the encoder, the attention and the score; ``prior`` alone where nothing could be learned."""

    prior: float
    weights: dict[str, np.ndarray] | None = None

    def forward(self, inputs: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        bag = np.repeat(np.arange(len(counts)), counts)
        x = (inputs - w["mean"]) / w["spread"]
        h = np.tanh(x @ w["W"] + w["W0"])
        t = np.tanh(h @ w["V"])
        s = 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, firsts)[bag])
        a = e / np.add.reduceat(e, firsts)[bag]
        z = np.add.reduceat(a[:, None] * h, firsts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))
        return {"bag": bag, "firsts": firsts, "x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p}

    def score(self, inputs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each bag, its most attended passage, and that passage's weight."""
        if self.weights is None or not len(counts):
            return np.full(len(counts), self.prior), np.zeros(len(counts), np.int64), np.ones(len(counts)) / np.maximum(counts, 1)
        f = self.forward(inputs, counts)
        order = np.lexsort((-f["a"], f["bag"]))
        top = order[f["firsts"]]
        return f["p"].astype(np.float64), top - f["firsts"], f["a"][top].astype(np.float64)


def gradients(w: dict[str, np.ndarray], f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    bag, firsts, x, h, t, s, a = (f[k] for k in ("bag", "firsts", "x", "h", "t", "s", "a"))
    d_out = (f["p"] - y) / len(y)
    d_z = d_out[:, None] * w["c"]
    d_a = (h * d_z[bag]).sum(axis=1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, firsts)[bag])
    d_t = d_e[:, None] * w["w"] * s * (1 - t**2)
    d_s = d_e[:, None] * w["w"] * t * s * (1 - s)
    d_h = (a[:, None] * d_z[bag] + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h**2)
    return {"c": d_out @ f["z"], "c0": d_out.sum(), "w": d_e @ (t * s), "V": h.T @ d_t, "U": h.T @ d_s, "W": x.T @ d_h, "W0": d_h.sum(axis=0)}


def learn(inputs: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit by Adam over shuffled batches of bags."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if prior in (0.0, 1.0) or not len(labels):
        return Model(prior)
    random = np.random.default_rng(seed)
    scale = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    mean, spread = inputs.mean(axis=0), inputs.std(axis=0) + 1e-3
    w = {"W": scale(WIDTH, HIDDEN), "W0": np.zeros(HIDDEN, np.float32), "V": scale(HIDDEN, ATTENTION), "U": scale(HIDDEN, ATTENTION), "w": scale(ATTENTION)}
    w |= {"c": scale(HIDDEN), "c0": np.float32(np.log(prior / (1 - prior)))}
    model = Model(prior, w | {"mean": mean, "spread": spread})
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    ends = np.cumsum(counts)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(len(counts))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(ends[b] - counts[b], ends[b]) for b in bags])
            found = model.forward(inputs[rows], counts[bags])
            step += 1
            for name, g in gradients(model.weights, found, labels[bags]).items():
                g = g + DECAY * model.weights[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * move).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def within(sizes: list[tuple[int, int]], most: int) -> int:
    """How many of the (hash, bytes) pairs, in order, stay within ``most`` bytes together; the first one always does."""
    total = np.cumsum([size for _, size in sorted(sizes)])
    return max(1, int(np.searchsorted(total, most, "right")))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the labelled documents (columns doc_id and quality) that are not held out.

    In the order of their hash the first ``max_rows`` labels are taken, and of their documents whole ones as far as ``max_bytes`` of encoded passages reach.
    """
    known = labels.select(F.col("doc_id").alias("mil_id"), F.col("quality").alias("mil_label")).filter(
        F.col("mil_label").isNotNull() & F.col("mil_id").isNotNull() & ~held_out("mil_id")
    )
    sample = known.orderBy(F.xxhash64("mil_id"), "mil_id", "mil_label").limit(max_rows)
    # The broadcast side has at most max_rows pairs of numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("mil_id")).select("mil_id", F.col("text").cast("string").alias("text"), "mil_label")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs, counts = encode_inputs(batch.column(1))
            ends = np.cumsum(counts)
            data = [inputs[e - c : e].tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(data, pa.binary())], ["id", "label", "inputs"])

    encoded = stored(chosen.mapInArrow(encode, "id long, label int, inputs binary"))
    sizes = [(r.order, r.size) for r in encoded.select(F.xxhash64("id", "label").alias("order"), F.octet_length("inputs").alias("size")).collect()]
    if sum(size for _, size in sizes) > max_bytes:
        last = sorted(sizes)[within(sizes, max_bytes) - 1][0]
        encoded = encoded.filter(F.xxhash64("id", "label") <= last)
    rows = encoded.collect()
    rows.sort(key=lambda r: (r.id, r.label, r.inputs))
    inputs = np.frombuffer(b"".join(r.inputs for r in rows), np.float32).reshape(-1, WIDTH)
    counts = np.array([len(r.inputs) // (4 * WIDTH) for r in rows], np.int64)
    return learn(inputs, counts, np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns and mil_score, mil_passages, and the most attended passage: mil_top (its number) and mil_weight."""
    at = docs.columns.index("text")
    added = [T.StructField("mil_score", T.DoubleType()), T.StructField("mil_passages", T.LongType()), T.StructField("mil_top", T.LongType()), T.StructField("mil_weight", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs, counts = encode_inputs(batch.column(at).cast(pa.large_string()))
            scores, top, weight = model.score(inputs, counts)
            own = [pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(top, pa.int64()), pa.array(weight, pa.float64())]
            columns = [*batch.columns, *own]
            yield pa.RecordBatch.from_arrays(columns, [f"c{n}" for n in range(len(columns))])

    return map_rows(docs, run, [T.StructField(f.name, f.dataType) for f in docs.schema.fields] + added)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that a model learned from ``labels`` does not reject."""
    return score(docs, train(docs, labels, max_rows)).filter(F.col("mil_score") >= threshold).select(*columns_of(docs))
