"""Words and their hashes, taken from many texts at once as arrays.

Python tasks of the text operators receive Arrow batches. Splitting each text into Python strings would cost more than
everything done afterwards, so a slice of texts is handled as one array of bytes: words are the runs of bytes that are no
separators (separators are ASCII, so no character of several bytes is ever cut), and a word's hash is the difference of
two running sums of ``table[byte] * odd ** position``, brought back to position 0 by the inverse power. Hashes of windows of
words are made from word hashes in the same way. All arithmetic is modulo 2 ** 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of "plain" words: space and the control characters from tab to carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of "letter" words: digits, letters, and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SLICE_ROWS = 512
SLICE_BYTES = 1 << 20  # texts are handled in slices of about this size; a longer text is a slice of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all bits (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Two independent families: byte table seed, odd base for bytes, odd base for words.
FAMILIES = ((11, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F), (29, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_POWERS: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1, kept for the next call."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


@dataclass
class Slice:
    """Texts ``first`` to ``last`` - 1 of a batch: their bytes, where each begins (and the last ends), and per word its start,
    end and text (counted from 0)."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    counts: np.ndarray  # words per text

    def hashes(self, family: int = 0) -> np.ndarray:
        seed, base, _ = FAMILIES[family]
        inverse = pow(base, -1, 1 << 64)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(seeded(256, seed)[self.data] * power(base, len(self.data)), out=sums[1:])
        out = (sums[self.ends] - sums[self.starts]) * power(inverse, len(self.data) + 1)[self.starts]
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def offsets(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def windows(words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each place on; those that run into the next text are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = FAMILIES[family][2]
    inverse = pow(base, -1, 1 << 64)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * power(base, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * power(inverse, n) + np.uint64(size))


def whole(text: np.ndarray, size: int) -> np.ndarray:
    """For each place: do the ``size`` words from it on belong to one text?"""
    return text[size - 1 :] == text[: max(0, len(text) - size + 1)]


def chosen(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` places the place of its smallest hash; of equal ones the last. By doubling, with the places beside the hashes."""
    least, place, done = hashes, np.arange(len(hashes)), 1
    while done < size:
        step = min(done, size - done)
        if len(least) <= step:
            return place[:0]
        later = least[step:] <= least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        done += step
    return place


def winnow(hashes: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Places that `chosen` takes in at least one window, ascending; ``valid`` tells which windows count.

    What is taken in a window depends on nothing outside it, so texts that share a window share the place.
    """
    places = chosen(hashes, size)[: len(valid)][valid]  # they never go backward
    return places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places


def slices(texts: pa.Array, word: np.ndarray, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into slices of words. Nulls are texts without words.

    Rows are taken some hundred at a time, so that no second copy of a whole batch is made.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), SLICE_ROWS):
        yield from slices_of(texts.slice(at, SLICE_ROWS), at, word, lower, size)


def slices_of(texts: pa.Array, at: int, word: np.ndarray, lower: bool, size: int) -> Iterator[Slice]:
    """Slices of a part of the column that begins at row ``at``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    everything = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        data = everything[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        if lower:
            data = LOWER[data]
        inside = word[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[bounds] = True  # a text's first byte never continues the word before it
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | begins[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
        upto = np.searchsorted(starts, bounds)
        counts = np.diff(upto)
        yield Slice(at + first, at + last, data, bounds, starts, ends, np.repeat(np.arange(last - first), counts), counts)
        first = last
