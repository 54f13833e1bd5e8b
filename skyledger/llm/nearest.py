"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks in vertical layout, one row of numbers per dimension. Scores of many queries with a block are added up by
groups of dimensions. What the dimensions still to come can add to a score is at most the product of the two vectors' remaining lengths
(their remaining mass), so pairs that cannot reach the query's k-th best score any more are dropped, and the arrays are compacted to the
survivors. Values are whole numbers, so scores are exact and ties are decided by id alone: single precision is used where all partial
scores are below its exact range, double precision where that does, and whole numbers of any size else.

Candidates are dealt to parts, queries to groups that fit a task's memory. A task holds one group with the k best of each query so far,
and one block after the other of one part streams past it. So each candidate is shipped once per group and each query once per part, and
the numbers of both follow the tables' sizes; a task's k-th best scores rise with all blocks that it has seen. The work itself is all
pairs of a query and a candidate, and grows with the square of the table.

Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an id. Shorter vectors count as
filled up with zeros. Rows that agree in id and vector count once; rows that share the id of a query are not its candidates.
Scores beyond the range of a long are held at its ends, and are equal there.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunk_of, partitions, stored

K = 5
BLOCK = 2048  # candidates of one block
TILE = 256  # queries that meet a block at once
MANY = 64 * TILE  # queries, about, that are kept in one array
DIMENSIONS = 8  # added up between two prunings
STRIDE = 8  # a block's columns are a multiple of it
FINISH = 10_000  # what finishing one surviving pair costs, in dimensions of a pair among many
GROUP_VALUES = 24 << 20  # numbers of a group's queries
LEAST_TASKS = 64
#: Whole numbers below are exact. Partial scores stay below a quarter, so that a floor can be taken off them.
SINGLE, LIMIT = 2.0**24, 2.0**53
TYPES = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<f8"))

_PACKED = "part int, low long, type int, width int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all vectors one after the other, their lengths, and which rows take part."""
    vectors = batch.column("vector")
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        # No negative zeros, so that equal vectors have equal bytes.
        values = np.floor(float(scale) * vectors.flatten().to_numpy(zero_copy_only=False)) + 0.0
    good = np.ones(len(lengths), bool)
    good[np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(values)]] = False
    return values, lengths, good


def pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of each batch: vectors of one part, of similar length, whose numbers fit one type; by dimension."""
    for batch in batches:
        values, lengths, good = whole_numbers(batch, scale)
        ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "part"))
        starts = np.cumsum(lengths) - lengths
        types = np.zeros(len(ids), np.int64)
        with np.errstate(invalid="ignore"):
            for n, type_ in enumerate(TYPES[:2], 1):
                types[np.repeat(np.arange(len(ids)), lengths)[np.abs(values) > np.iinfo(type_).max]] = n
        sizes = np.frexp(lengths)[1]  # doubles where a vector is longer than a power of two
        order = np.lexsort((ids, sizes, types, parts))
        order = order[good[order]]
        key = np.stack([parts[order], types[order], sizes[order]])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), len(order)]
        packed = []
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                rows = order[a:b]
                width = int(lengths[rows].max())
                within = np.arange(width)[:, None] < lengths[rows]
                block = np.zeros((width, len(rows)), TYPES[types[rows[0]]])
                block[within] = values[(starts[rows] + np.arange(width)[:, None])[within]]
                packed.append((int(parts[rows[0]]), int(ids[rows[0]]), int(types[rows[0]]), width, ids[rows].astype(np.int64).tobytes(), block.tobytes()))
        columns = list(zip(*packed)) or [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "low", "type", "width", "ids", "vectors"])


def unpack(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("vectors", TYPES[batch.column("type")[row].as_py()])))
    return ids, vectors.reshape(-1, len(ids))


def joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One block of several."""
    out = np.zeros((max(len(v) for _, v in blocks), sum(len(i) for i, _ in blocks)), blocks[0][1].dtype)
    at = 0
    for ids, vectors in blocks:
        out[: len(vectors), at : at + len(ids)] = vectors
        at += len(ids)
    return np.concatenate([i for i, _ in blocks]), out


def thinned(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that are there already and, as equal vectors have equal scores, without all but the ``most`` smallest ids of each vector."""
    rows = np.ascontiguousarray(vectors.T)
    if rows.shape[1]:
        distinct, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
        if len(distinct) == len(ids):
            return ids, vectors
    else:
        same = np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, same))
    order = order[np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(same[order]) != 0)))]
    keep = order[places(same[order]) < most]
    return ids[keep], vectors[:, keep]


def places(groups: np.ndarray) -> np.ndarray:
    """The place of each row within its group, from 0; groups lie together."""
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))


def remaining(vectors: np.ndarray) -> np.ndarray:
    """Length of each vector's part from each pruning point on, rounded up a little."""
    with np.errstate(over="ignore"):
        squares = vectors.astype(np.float64) ** 2
        steps = [squares[d : d + DIMENSIONS].sum(axis=0) for d in range(0, len(vectors), DIMENSIONS)] + [np.zeros(vectors.shape[1])]
        return np.sqrt(np.cumsum(steps[::-1], axis=0)[::-1]) * (1 + 1e-9)


class Queries:
    """The queries of a group, one per row, and the k best (score, id) that each has met so far, best first.

    The first two numbers of a row are what its scores have to reach, negative, and its remaining mass at the depth of the first pruning.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rest, self.k = ids, remaining(vectors), k
        self.numbers = np.zeros((len(ids), 2 + len(vectors)), np.float32 if self.rest[0].max() < SINGLE / 4 else np.float64)
        self.numbers[:, 2:] = vectors.T
        self.scores, self.names = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.count = np.zeros(len(ids), np.int64)

    def merge(self, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Takes in what rows, in order, have found; a pair of score and id counts once."""
        first = np.diff(rows, prepend=-1) > 0
        touched, at = rows[first], np.cumsum(first) - 1
        had = np.arange(self.k) < self.count[touched][:, None]
        at = np.concatenate([np.nonzero(had)[0], at])
        names, scores = np.concatenate([self.names[touched][had], names]), np.concatenate([self.scores[touched][had], scores])
        order = np.lexsort((names, ~scores, at))
        at, names, scores = at[order], names[order], scores[order]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (names[1:] != names[:-1]) | (scores[1:] != scores[:-1])))[: len(at)]
        at, names, scores = at[new], names[new], scores[new]
        place = places(at)
        keep = place < self.k
        self.scores[touched[at[keep]], place[keep]] = scores[keep]
        self.names[touched[at[keep]], place[keep]] = names[keep]
        self.count[touched] = np.minimum(np.bincount(at, minlength=len(touched)), self.k)

    def found(self, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), step):
            some = slice(a, a + step)
            had = np.arange(self.k) < self.count[some][:, None]
            columns = np.repeat(self.ids[some], self.count[some]), self.names[some][had], self.scores[some][had]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


class Candidates:
    """A block, longest vectors first, the last one repeated. Above its numbers lie ones, and the remaining mass at the depth of the first pruning."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        mass = remaining(vectors)
        order = np.argsort(-mass[0], kind="stable")
        self.real, self.low = len(ids), ids.min()
        order = np.append(order, np.repeat(order[-1], -len(ids) % STRIDE))
        self.ids, self.mass = ids[order], mass[:, order]
        self.numbers = np.ones((2 + len(vectors), len(order)), np.float32 if mass[0].max() < SINGLE / 4 else np.float64)
        self.numbers[2:] = vectors[:, order]


class Depth:
    """Steps of dimensions that are added up before the first pruning: as many as cost least so far, survivors included. No result depends on it."""

    def __init__(self) -> None:
        self.cost: dict[int, float] = {}
        self.turns = 0

    def choose(self, steps: int) -> int:
        self.turns += 1
        if self.turns % 4096 == 0:
            self.cost.clear()
        best = min(self.cost, key=self.cost.get, default=steps + 1)
        return min(best - 1 if best > 1 and best - 1 not in self.cost else best, steps)

    def learn(self, depth: int, survivors: int, pairs: int) -> None:
        self.cost[depth] = depth * DIMENSIONS + FINISH * survivors / max(1, pairs)


def reached(upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is not negative, by the largest of each row and then of every few columns."""
    if not upper.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(upper.max(axis=1) >= 0)
    few = upper[hit].reshape(len(hit), STRIDE, upper.shape[1] // STRIDE)
    r, g = np.divmod(np.flatnonzero(few.max(axis=1) >= 0), few.shape[2])
    at, j = np.nonzero(few[r, :, g] >= 0)
    return hit[r[at]], j * few.shape[2] + g[at]


def best(queries: Queries, rows: slice, block: Candidates, depth: Depth, buffer: np.ndarray) -> None:
    """Compares some queries with a block, where all partial scores are exact."""
    k, asked, reach = queries.k, queries.ids[rows], queries.rest[0][rows]
    bound = reach.max() * block.mass[0][0]
    type_ = np.float32 if bound < SINGLE / 4 else np.float64
    numbers, columns = queries.numbers[rows].astype(type_, copy=False), block.numbers.astype(type_, copy=False)
    width = min(numbers.shape[1], len(columns)) - 2
    steps = math.ceil(width / DIMENSIONS)
    if (queries.count[rows] < k).any():
        seed(queries, rows, block.ids[: block.real], numbers[:, 2 : 2 + width] @ columns[2 : 2 + width, : block.real])
        return
    last, name = queries.scores[rows, -1], queries.names[rows, -1]
    # Of equal scores the smaller id is the better one.
    least = np.maximum(last + (block.low >= name).astype(np.float64), -math.ceil(bound) - 1)
    active = np.flatnonzero(reach * block.mass[0][0] >= least)
    if not len(active):
        return
    if len(active) < len(asked):
        numbers, least, reach = numbers[active], least[active], reach[active]
    needed = np.where(least > 0, least / np.maximum(reach, 1e-300), -1).min()
    n = -int(-np.searchsorted(-block.mass[0], -needed * (1 - 1e-9), side="right") // STRIDE) * STRIDE
    at = depth.choose(steps) if steps else 0
    for at in dict.fromkeys((at, steps)):  # too many survivors: all dimensions
        d = min(at * DIMENSIONS, width)
        if at < steps:
            slack = (d + 4) * 4 * np.finfo(type_).eps * bound
            numbers[:, 0], numbers[:, 1] = slack - least, queries.rest[at][rows][active] * (1 + 1e-6)
            columns[1] = block.mass[at]
        else:
            numbers[:, 0], numbers[:, 1] = -least, 0
        upper = np.matmul(numbers[:, : 2 + d], columns[: 2 + d, :n], out=buffer.view(type_)[: len(active) * n].reshape(len(active), n))
        r, c = reached(upper)
        survivors = len(r)
        if steps:
            depth.learn(at, survivors if at < steps else 0, upper.size)
        if survivors * 16 <= upper.size:
            break
    if at == steps:
        scores = upper[r, c].astype(np.float64) + least[r]
    else:
        scores = np.einsum("ij,ji->i", numbers[r, 2 : 2 + d], columns[2 : 2 + d, c]).astype(np.float64)
        for step in range(at, steps):
            keep = scores + queries.rest[step][rows][active][r] * block.mass[step][c] >= least[r]
            r, c, scores = r[keep], c[keep], scores[keep]
            a, b = 2 + step * DIMENSIONS, 2 + min((step + 1) * DIMENSIONS, width)
            scores = scores + np.einsum("ij,ji->i", numbers[r, a:b], columns[a:b, c])
    scores, r, names = scores.astype(np.int64), active[r], block.ids[c]
    keep = (names != asked[r]) & ((scores > last[r]) | ((scores == last[r]) & (names < name[r])))
    if keep.any():
        queries.merge(rows.start + r[keep], names[keep], scores[keep])


def seed(queries: Queries, rows: slice, ids: np.ndarray, scores: np.ndarray) -> None:
    """For queries that have not met k candidates yet: the few that lead, and all of the block where these are not k different ones."""
    k, asked, few = queries.k, queries.ids[rows], queries.count[rows] < queries.k
    order = np.argsort(ids, kind="stable")
    first, end = (np.searchsorted(ids[order], asked, side=s) for s in ("left", "right"))
    own = np.repeat(np.arange(len(asked)), end - first)
    scores[own, order[np.repeat(first, end - first) + places(own)]] = -np.inf
    floors = np.where(few, -np.inf, queries.scores[rows, -1].astype(np.float64))
    if len(ids) > 4 * k:
        floors[few] = np.partition(scores[few], len(ids) - 4 * k, axis=1)[:, len(ids) - 4 * k]

    def take(some: np.ndarray) -> None:
        if len(some):
            r, c = np.nonzero((scores[some] >= floors[some, None]) & (scores[some] > -np.inf))
            queries.merge(rows.start + some[r], ids[c], scores[some[r], c].astype(np.int64))

    take(np.arange(len(asked)))
    floors[:] = -np.inf
    take(np.flatnonzero(queries.count[rows] < k))


def best_of_long(query: np.ndarray, own: int, names: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same in whole numbers of any size, for vectors whose products leave the range of exact doubles."""
    asked = [int(x) for x in query]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    found = {(clip(sum(a * int(b) for a, b in zip(asked, column))), int(name)) for name, column in zip(names, vectors.T) if name != own}
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def compare(queries: Queries, block: Candidates, depth: Depth, buffer: np.ndarray) -> None:
    for a in range(0, len(queries.ids), TILE):
        rows = slice(a, min(a + TILE, len(queries.ids)))
        with np.errstate(over="ignore", invalid="ignore"):
            exact = queries.rest[0][rows].max() * block.mass[0][0] < LIMIT / 4
        if exact:
            best(queries, rows, block, depth, buffer)
            continue
        found = [(row, name, score) for row in range(rows.start, rows.stop) for score, name in best_of_long(queries.numbers[row, 2:], queries.ids[row], block.ids[: block.real], block.numbers[2:, : block.real], queries.k)]
        if found:
            queries.merge(*(np.array(c, np.int64) for c in zip(*found)))


def search(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task: first the blocks of its queries, then those of its candidates, which are put together to blocks of some size."""
    task, groups, depths = None, [], defaultdict(Depth)
    asked, waiting = defaultdict(list), defaultdict(list)
    buffer = np.zeros(0)

    def meet(key: tuple[int, int]) -> None:
        nonlocal buffer
        if asked:
            for blocks in asked.values():
                rows = np.cumsum([len(ids) for ids, _ in blocks]) // MANY
                groups.extend(Queries(*joined([b for b, r in zip(blocks, rows) if r == n]), k) for n in np.unique(rows))
            asked.clear()
        met = Candidates(*thinned(*joined(waiting.pop(key)), k + 1))
        if buffer.size < TILE * len(met.ids):  # of doubles
            buffer = np.zeros(TILE * len(met.ids))
        for n, queries in enumerate(groups):
            compare(queries, met, depths[n, key], buffer)

    def end() -> Iterator[pa.RecordBatch]:
        for key in list(waiting):
            meet(key)
        for queries in groups:
            yield from queries.found()
        groups.clear(), asked.clear(), depths.clear()

    for batch in batches:
        for row in range(batch.num_rows):
            now, is_candidate, type_, width = (batch.column(c)[row].as_py() for c in ("task", "is_candidate", "type", "width"))
            if now != task:
                yield from end()
                task = now
            key = type_, width.bit_length()
            (waiting if is_candidate else asked)[key].append(unpack(batch, row))
            if is_candidate and sum(len(ids) for ids, _ in waiting[key]) >= block:
                meet(key)
    yield from end()


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: int = 256, id_: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id and score of its k best other rows.

    The queries are written to the shared folder.
    """
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = stored(rows.filter(F.col("id") % every == 0).dropDuplicates())
    n, (m, values) = max(1, vectors.count()), asked.agg(F.count("*"), F.sum(F.size("vector"))).first()
    # Queries are shipped once per part, candidates once per group: with this ratio both weigh the same.
    ratio, tasks = n / max(1, m), partitions(vectors.sparkSession)
    tasks = min(tasks, max(LEAST_TASKS, math.ceil(4 * ratio)))
    parts = min(math.ceil(n / block), math.ceil(math.sqrt(tasks * ratio)))
    groups = max(math.ceil((values or 0) / GROUP_VALUES), min(math.ceil(m / TILE), round(math.sqrt(tasks / ratio))), 1)

    def blocks(of: DataFrame, count: int) -> DataFrame:
        return of.withColumn("part", chunk_of(count, "id", "vector")).mapInArrow(lambda batches: pack(batches, scale), _PACKED)

    columns = ["low", "type", "width", "ids", "vectors"]
    candidates = blocks(rows, parts).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("part") * groups + g)).alias("task"), F.lit(1).alias("is_candidate"), *columns)
    queries = blocks(asked, groups).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * groups + F.col("part"))).alias("task"), F.lit(0).alias("is_candidate"), *columns)
    dealt = queries.unionByName(candidates).repartitionById(parts * groups, F.col("task")).sortWithinPartitions("task", "is_candidate", "low")
    found = dealt.mapInArrow(lambda batches: search(batches, k, block), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").dropDuplicates()
