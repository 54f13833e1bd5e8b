"""Top-k search: what is shipped, and results over many blocks and tasks against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import nearest


def plain(rows, every, k):
    numbers = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows]
    found = {}
    for i, a in numbers:
        if i % every == 0:
            found.setdefault(i, set()).update((-sum(x * y for x, y in zip(a, b)), j) for j, b in numbers if j != i)
    return {i: sorted(pairs)[:k] for i, pairs in found.items()}


def ranked(found):
    out = {}
    for r in sorted(found, key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def exchanged(node):
    """Bytes that the exchanges of a plan that ran have dealt."""
    for name, inner in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")):
        if name in node.nodeName():
            return exchanged(getattr(node, inner)())
    own = node.metrics().get("dataSize").get().value() if node.nodeName() == "Exchange" else 0
    return own + sum(exchanged(node.children().apply(n)) for n in range(node.children().size()))


def test_a_vector_is_shipped_a_few_times_however_many_blocks_there_are(spark):
    vectors = np.random.default_rng(3).normal(size=(1500, 32))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    top = nearest.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, block=25)
    found = ranked(top.collect())
    assert exchanged(top._jdf.queryExecution().executedPlan()) < 6 * vectors.nbytes
    numbers = np.floor(256 * vectors)
    scores = numbers @ numbers.T
    np.fill_diagonal(scores, -np.inf)
    for n, row in enumerate(scores):
        best = np.lexsort((np.arange(len(row)), -row))[:5]
        assert found[n] == [(-int(row[i]), i) for i in best]


def batches(rows, parts, size):
    for a in range(0, len(rows), size):
        some = rows[a : a + size]
        columns = pa.array([i for i, _ in some], pa.int64()), pa.array([v for _, v in some], pa.list_(pa.float64())), pa.array([k % parts for k in range(a, a + len(some))], pa.int32())
        yield pa.RecordBatch.from_arrays(list(columns), ["id", "vector", "part"])


def searched(rows, every, k, block, parts):
    asked = list(nearest.pack(batches([r for r in rows if r[0] % every == 0], 1, 40), 256))
    given = list(nearest.pack(batches(rows, parts, 40), 256))
    found = {}
    for part in range(parts):
        dealt = [(0, r) for b in asked for r in b.to_pylist()] + sorted(((1, r) for b in given for r in b.to_pylist() if r["part"] == part), key=lambda x: x[1]["low"])
        task = pa.Table.from_pylist([r | {"task": part, "is_candidate": n} for n, r in dealt]).to_batches(max_chunksize=7)
        for batch in nearest.search(iter(task), k, block):
            for r in batch.to_pylist():
                found.setdefault(r["query_id"], set()).add((-r["score"], r["vec_id"]))
    return {i: sorted(pairs)[:k] for i, pairs in found.items()}


def ties(rng, x):
    return np.sign(x)


def one_common_vector(rng, x):
    x[rng.random(len(x)) < 0.6] = x[0]
    return x


def lengths_of_all_precisions(rng, x):
    return x * rng.choice([0.01, 1, 30, 3e3, 1e6], (len(x), 1))


def mass_in_the_first_dimensions(rng, x):
    return x * np.geomspace(1, 0.01, x.shape[1])


def mostly_zeros(rng, x):
    return np.where(rng.random(x.shape) < 0.03, x, 0.0)


@pytest.mark.parametrize("finish", [10_000, 0])  # 0: prunes as early as it can
@pytest.mark.parametrize("change", [ties, one_common_vector, lengths_of_all_precisions, mass_in_the_first_dimensions, mostly_zeros])
def test_many_blocks_and_parts(monkeypatch, change, finish):
    monkeypatch.setattr(nearest, "FINISH", finish)
    monkeypatch.setattr(nearest, "TILE", 8)
    rng = np.random.default_rng(11)
    vectors = change(rng, rng.normal(size=(300, 33)) / 6)
    ids = rng.integers(-120, 120, 300)  # some have several vectors
    rows = [(int(i), [float(x) for x in v[: rng.integers(20, 34)]]) for i, v in zip(ids, vectors)]
    rows += rows[:50]
    for block, parts in ((16, 1), (40, 3), (1000, 1)):
        assert searched(rows, 3, 4, block, parts) == plain(rows, 3, 4)
