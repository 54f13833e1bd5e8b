import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm.neardup import alike, link_block, near_duplicates, one_per_class, probability_jaccard, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_counts(text):
    words = WORD.findall(text)
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def similarity(a, b):
    names = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in names) for i in set(a) & set(b))


def classes_by_all_pairs(docs, least=0.8):
    """class_id per doc_id, from all pairs that share a shingle."""
    sets = [shingle_counts(text or "") for _, text in docs]
    having, pairs, parent = defaultdict(list), Counter(), list(range(len(docs)))
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    for found in having.values():
        pairs.update((a, b) for a in found for b in found if a < b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= least]
    same = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        if text is not None:
            same[text].append(k)
    links += [(x[0], y) for x in same.values() for y in x[1:]]
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for k in range(len(docs)):
        members[root(k)].append(docs[k][0])
    return {d: min(x) for x in members.values() for d in x}


def varied(random, base, changes):
    words = list(base)
    for k in random.choice(len(words), changes, replace=False):
        words[k] = f"new{random.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """Near copies of one text that are linked by chains only, dissimilar ones, short, empty and null texts."""
    random = np.random.default_rng(3)
    base = [f"w{random.integers(10**9)}" for _ in range(150)]
    docs = [(k, varied(random, base, int(random.integers(0, 6)))) for k in range(60)]
    docs += [(100 + k, varied(random, base, 12)) for k in range(20)]
    docs += [(200 + k, " ".join(f"x{random.integers(10**9)}" for _ in range(40))) for k in range(10)]
    docs += [(300, ""), (301, ""), (302, " \n"), (303, None), (304, None), (305, "one two"), (306, "one  two"), (307, "one two three")]
    docs += [(400, "again " * 3000), (401, "again " * 2990), (402, "again " * 3000 + "and " * 3000)]
    return docs


def test_classes_equal_those_of_all_pairs(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found == classes_by_all_pairs(family)


def test_one_of_each_class_stays_once(spark, family):
    rows = [(i, t, f"extra{i}") for i, t in family] + [(0, family[0][1], "extra0"), (None, family[0][1], "no id"), (None, None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    kept = one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted(set(classes_by_all_pairs(family).values()))


def classes_by_document(docs):
    """The same where a doc_id may have several texts: it joins their classes."""
    classes = classes_by_all_pairs([(k, text) for k, (_, text) in enumerate(docs)])
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for k, (doc_id, text) in enumerate(docs):
        links = [classes[k]] + ([first.setdefault(doc_id, k)] if text is not None else [])
        for other in links:
            a, b = root(k), root(other)
            parent[max(a, b)] = min(a, b)
    names = {}
    for k, (doc_id, _) in enumerate(docs):
        names[root(k)] = min(doc_id, names.get(root(k), doc_id))
    return sorted((doc_id, names[root(k)]) for k, (doc_id, _) in enumerate(docs)), classes


def unlike_texts_of_one_id():
    random = np.random.default_rng(11)
    a, b, c = ([f"{name}{random.integers(10**9)}" for _ in range(80)] for name in "abc")
    near = lambda words: varied(random, words, 1)
    docs = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(c)), (2, near(a)), (3, near(b)), (4, near(c)), (4, near(a)), (5, "alone in here"), (5, None)]
    return docs + [docs[0]] * 3 + [(1, near(b))]


def test_a_doc_id_with_unlike_texts(spark):
    docs = unlike_texts_of_one_id()
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == classes_by_document(docs)[0]


def test_no_unlike_text_goes(spark):
    """One row of each class of texts stays: the smallest doc_id's."""
    docs = unlike_texts_of_one_id()
    _, classes = classes_by_document(docs)
    kept = Counter((r.doc_id, r.text) for r in one_per_class(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert all(n == 1 for n in kept.values())
    by_class = defaultdict(list)
    for k, (doc_id, text) in enumerate(docs):
        by_class[classes[k]].append((doc_id, text))
    for members in by_class.values():
        stayed = {m for m in members if m in kept}
        assert len(stayed) == 1
        assert stayed.pop()[0] == min(doc_id for doc_id, _ in members)


def test_columns_of_any_name_and_copies_of_a_row(spark):
    rows = [(1, "same text as always in this row", k % 3, "x", 1, 2, 3, 4) for k in range(2000)]
    names = "doc_id long, text string, _row int, rep string, place int, label int, `a.b` int, `x` int"
    kept = one_per_class(spark.createDataFrame(rows, names))
    assert kept.columns == ["doc_id", "text", "_row", "rep", "place", "label", "a.b", "x"]
    assert len(kept.collect()) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, band int")
    assert near_duplicates(docs).count() == 0
    assert one_per_class(docs).count() == 0


def test_probability_jaccard():
    a, b = np.array([1, 1, 2, 3], np.uint32), np.array([1, 2, 2, 5], np.uint32)
    expected = similarity(Counter(a.tolist()), Counter(b.tolist()))
    assert abs(probability_jaccard(a, b) - expected) < 1e-12
    assert probability_jaccard(a, a) == pytest.approx(1)
    assert probability_jaccard(a, a[:0]) == 0


def test_registers_agree_with_the_probability_jaccard():
    random = np.random.default_rng(5)
    names = random.integers(1, 2**63, 400).astype(np.uint64)
    one, two = {k: int(random.integers(1, 5)) for k in range(300)}, {k: int(random.integers(1, 5)) for k in range(60, 400)}
    hashes = np.concatenate([names[list(one)], names[list(two)]])
    texts = np.repeat([0, 1], [len(one), len(two)])
    weights = np.array([*one.values(), *two.values()], float)
    found = signatures(hashes, texts, weights, 2, 4000)
    assert abs((found[0] == found[1]).mean() - similarity(Counter(one), Counter(two))) < 0.03


def tied(name, common, one, two):
    """Two texts of ``common`` common shingles, and ``one`` and ``two`` of their own."""
    base = [f"{name}{k}" for k in range(common + 4)]
    return [" ".join(base + [f"{name}{side}{k}" for k in range(n)]) for side, n in (("a", one), ("b", two))]


TIES = [(12, 1, 2), (48, 6, 6), (80, 10, 10), (216, 27, 27)]  # 12 of 15, 48 of 60, 80 of 100, 216 of 270


def test_exact_ties_are_linked(spark):
    docs = [(10 * n + k, text) for n, tie in enumerate(TIES) for k, text in enumerate(tied(f"t{n}x", *tie))]
    docs += [(1000 + k, text) for k, text in enumerate(tied("less", 215, 27, 27))]
    found = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == classes_by_all_pairs([d for d in docs if d[0] < 1000]) | {1000: 1000, 1001: 1001}
    assert all(found[10 * n + 1] == 10 * n for n in range(len(TIES)))


@pytest.mark.parametrize("repeats", [1, 2])
def test_ties_within_a_bucket(repeats):
    for common, one, two in [*TIES, (215, 27, 27)]:
        a, b = np.arange(common + one), np.concatenate((np.arange(common), 1000 + np.arange(two)))
        a, b = (np.repeat(x, repeats).astype(np.uint32) for x in (a, b))
        enough = common != 215
        assert alike(a, b, 0.8)[1] == enough
        registers = np.zeros(80, np.uint16).tobytes()
        rows = [{"band": 0, "asks": asks, "rep": rep, "label": rep, "registers": registers, "shingles": x.tobytes()} for asks, rep, x in ((True, 1, a), (False, 2, b))]
        assert link_block(pa.Table.from_pylist(rows), 0.8, 4).num_rows == enough
