"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is a weighted set: its shingles of five words, weighted by how often it has them (a text of fewer words is one shingle). In
ProbMinHash each shingle starts a Poisson process whose rate is its weight; every arrival goes to a random register, and a register
keeps its earliest one. A process ends as soon as its next arrival is later than every register's. Two texts agree in a register with
their probability Jaccard similarity, which for equal weights is the Jaccard similarity. ``BANDS`` bands of ``ROWS`` registers make
candidates (a pair of similarity 0.8 is missed with probability 3e-5), and every candidate is verified on the shingles themselves.

Equal texts are one text from the start, with a number of its own, so groups of copies cost nothing further. Pairs of a
bucket are never written out. First each member is compared with one hub, which settles most groups of near copies. Buckets whose
members are still of several classes are then cut into blocks: members outside the largest class meet all members, a block
by a block in a task. There a pair is looked at in the first band it shares only, and verified unless its classes have been linked by
then; of texts that repeat shingles, registers are compared first, and pairs up to five standard deviations below the threshold are
let through. So no link between classes is lost, and what comes out is fewer links than members.
Hubs and labels are joined by Spark, which splits keys with many rows; no bucket and no class is gathered as a whole.

Null texts are alike to nothing, not even each other. Texts without words are alike only if equal. Rows without a doc_id get no class. Rows
that share a doc_id are compared text by text; `near_duplicates` then gives their doc_id one class, which joins the classes of its texts, while
`one_per_class` goes by texts alone and keeps one row of each class of texts. Of rows with equal doc_id and text one stays. Other
columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns_of, partitions, stored
from .words import PLAIN, Slice, mix, seeded, slices, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
BLOCK = 1024  # members of a bucket that meet as many others in a task
BELOW = 5  # standard deviations of the shared registers
SIGNATURE_BYTES = 1 << 20
MARGIN = 1e-9  # similarities this close to the threshold are decided in fractions; sums of floats are off by far less

_KEY = "doc_id:bigint,x:bigint,y:bigint"  # a row and its text, whose hash has 128 bits
_SIGNED = f"key struct<{_KEY}>, bands array<long>, registers binary"
_SETS = "rep long, registers binary, shingles binary"
_EDGES = "a long, b long"
_PAIRS = "a long, b long, similarity double"


def shingles(piece: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice, and the text of each; texts of fewer words give one of all their words."""
    words, offsets = piece.hashes(), piece.offsets()
    hashes = windows(words, size)
    whole = piece.text[size - 1 :] == piece.text[: max(0, len(piece.text) - size + 1)]
    found, texts = [hashes[whole]], [piece.text[: len(hashes)][whole]]
    for n in range(1, size):
        short = np.flatnonzero(piece.counts == n)
        if len(short):
            found.append(windows(words, n)[offsets[short]])
            texts.append(short)
    return np.concatenate(found), np.concatenate(texts)


def weighted(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) and how often each occurs."""
    if not len(hashes):
        return hashes, texts, np.empty(0)
    keys = hashes ^ mix(texts.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    at = order[first]
    return hashes[at], texts[at], np.diff(np.concatenate((first, [len(keys)]))).astype(float)


def signatures(hashes: np.ndarray, texts: np.ndarray, weights: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """The shingle in each register of each text (0 where a text has no shingles)."""
    earliest = np.full(n_texts * registers, np.inf)
    holder = np.zeros(n_texts * registers, np.uint64)
    latest = np.full(n_texts, np.inf)  # of a text's registers
    time = np.zeros(len(hashes))
    step = 0
    while len(hashes):
        step += 1
        draw = mix(hashes + seeded(step, 5)[-1])
        time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(float) * 2.0**-53) / weights
        alive = time < latest[texts]
        hashes, texts, weights, time, draw = (x[alive] for x in (hashes, texts, weights, time, draw))
        register = texts * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, register, time)
        won = earliest[register] == time
        holder[register[won]] = hashes[won]
        touched = np.unique(texts)
        latest[touched] = earliest.reshape(n_texts, registers)[touched].max(axis=1)
        alive = time < latest[texts]
        hashes, texts, weights, time = (x[alive] for x in (hashes, texts, weights, time))
    return holder.reshape(n_texts, registers)


def band_hashes(holders: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(holders), bands), np.uint64)
    for k in range(rows):
        out = mix(out ^ mix(holders.reshape(len(holders), bands, rows)[:, :, k] + np.uint64(k + 1)))
    return out


def sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Bands of every text that has shingles."""
    for batch in batches:
        for piece in slices(batch.column(1), PLAIN, size=SIGNATURE_BYTES):
            n = piece.last - piece.first
            hashes, texts, weights = weighted(*shingles(piece))
            has = np.flatnonzero(np.bincount(texts, minlength=n))
            holders = signatures(hashes, texts, weights, n, bands * rows)[has]
            made = band_hashes(holders, bands, rows)
            ends = pa.array(np.arange(len(has) + 1) * bands, pa.int32())
            ids = batch.column(0).take(pa.array(piece.first + has))
            short = pa.array([x.tobytes() for x in (holders >> np.uint64(48)).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(ends, pa.array(made.ravel().view(np.int64))), short], ["key", "bands", "registers"]
            )


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of every shingle of a text, sorted, repeats included; id and registers go along."""
    for batch in batches:
        sets: list[bytes] = []
        for piece in slices(batch.column(2), PLAIN):
            hashes, texts = shingles(piece)
            keys = np.sort((texts.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
            bounds = np.searchsorted(keys, np.arange(piece.last - piece.first + 1, dtype=np.uint64) << np.uint64(32))
            low = keys.astype(np.uint32)
            sets += [low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["rep", "registers", "shingles"])


def terms(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numerators and denominators of 1 / sum over j of max(a_j / a_i, b_j / b_i) for the common shingles i of sorted shingles with repeats."""
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(place[: len(a)], minlength=len(names)), np.bincount(place[len(a) :], minlength=len(names))
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.concatenate(([0], np.cumsum(x)))  # shingles of at most a ratio count by x, the others by y / ratio
    above = np.concatenate((np.cumsum(y[::-1])[::-1], [0]))
    common = (x > 0) & (y > 0)
    at = np.searchsorted(ratio, ratio[common], "right")
    x, y = x[common], y[common]
    return x * y, below[at] * y + above[at] * x


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum over common shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i), from sorted shingles with repeats."""
    over, under = terms(a, b)
    return float((over / under).sum())


def alike(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, bool]:
    """The similarity, and whether it reaches ``least``, taken as the decimal it is written as: exact, also for ties."""
    over, under = terms(a, b)
    found = float((over / under).sum())
    if abs(found - least) > MARGIN:
        return found, found > least
    exact = sum((n * Fraction(p, q) for (p, q), n in Counter(zip(over.tolist(), under.tolist())).items()), Fraction(0))
    return found, exact >= Fraction(str(least))


def verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (batch.column(k).to_pylist() for k in (2, 3))
        found = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(one, two)]
        keep = pa.array([k for k, (_, enough) in enumerate(found) if enough], pa.int64())
        similarity = pa.array([s for s, _ in found], pa.float64()).take(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), similarity], ["a", "b", "similarity"])


def link_block(table: pa.Table, least: float, rows: int) -> pa.Table:
    """Links between the askers of a block of a bucket and its other members, of different classes.

    Common shingles of an asker and all others are counted in one sweep. Where no text repeats a shingle this gives the
    similarity; else shared registers tell which pairs are worth verifying. A pair that shares an earlier band is compared
    there, and one whose classes are linked already adds nothing. What comes out is a forest: fewer links than members.
    """
    band, asks = table.column("band")[0].as_py(), table.column("asks").to_numpy(zero_copy_only=False)
    reps, labels = table.column("rep").to_numpy(), table.column("label").to_numpy()
    registers = np.stack([np.frombuffer(x, np.uint16) for x in table.column("registers").to_pylist()])
    sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
    some = BELOW * np.sqrt(least * (1 - least) / registers.shape[1])
    distinct = [np.unique(x) for x in sets]
    single = np.array([len(x) == len(y) for x, y in zip(sets, distinct)])  # each shingle once
    others = np.flatnonzero(~asks)
    sizes = np.array([len(distinct[k]) for k in others])
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    names, flat = np.unique(np.concatenate([distinct[k] for k in others] or [np.empty(0, np.uint32)]), return_inverse=True)
    flat, marked = flat.astype(np.int32), np.zeros(len(names), np.int32)
    found = [np.empty((0, 3))]
    for k in np.flatnonzero(asks) if len(others) else []:
        at = np.searchsorted(names, distinct[k])
        at = at[names[np.minimum(at, len(names) - 1)] == distinct[k]]
        marked[at] = 1
        common = np.add.reduceat(marked[flat], firsts)
        marked[at] = 0
        jaccard = common / (len(distinct[k]) + sizes - common)  # one division of whole numbers: a tie is rounded as ``least`` is
        candidates = np.flatnonzero((labels[others] != labels[k]) & (np.where(single[others] & single[k], jaccard >= least, common > 0)))
        same = registers[others[candidates]] == registers[k]
        first = same.reshape(len(candidates), registers.shape[1] // rows, rows).all(axis=2).argmax(axis=1)
        exact = single[others[candidates]] & single[k]
        keep = candidates[(first == band) & (exact | (same.mean(axis=1) >= least - some))]
        found.append(np.stack([jaccard[keep], np.full(len(keep), k), others[keep]], axis=1))
    pairs = np.concatenate(found)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges, tested = [], set()
    for _, k, m in pairs[np.lexsort((reps[pairs[:, 2].astype(int)], reps[pairs[:, 1].astype(int)], -pairs[:, 0]))]:
        k, m = int(k), int(m)
        pair = (min(reps[k], reps[m]), max(reps[k], reps[m]))
        a, b = root(labels[k]), root(labels[m])
        if a == b or pair in tested:
            continue
        tested.add(pair)
        if alike(sets[k], sets[m], least)[1]:
            parent[max(a, b)] = min(a, b)
            edges.append({"a": int(pair[0]), "b": int(pair[1])})
    return pa.Table.from_pylist(edges, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def links_within(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float, rows: int) -> DataFrame:
    """Links between members of different classes in all buckets, found block by block.

    Members outside a bucket's largest class ask; askers and members are dealt to blocks of at most about ``BLOCK``, and every block of
    askers meets every block of members in a group of its own.
    """
    key = ["band", "hash"]
    labelled = members.select(*key, "rep").join(labels, "rep")
    sizes = labelled.groupBy(*key, "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = labelled.join(main.filter("labels > 1"), key).select(
        *key, "rep", "label", (F.col("label") != F.col("main")).alias("outside"), blocks(F.col("n") - F.col("most")).alias("n_a"), blocks(F.col("n")).alias("n_b")
    )
    number = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = open_.filter("outside").select(*key, "rep", "label", F.lit(True).alias("asks"), number(F.col("n_a"), 1).alias("i"), each(F.col("n_b")).alias("j"))
    asked = open_.select(*key, "rep", "label", F.lit(False).alias("asks"), each(F.col("n_a")).alias("i"), number(F.col("n_b"), 2).alias("j"))
    # Comparing costs more than the bytes suggest, so tasks are not merged for being small.
    many = 4 * partitions(members.sparkSession)
    dealt = asking.union(asked).join(sets, "rep").repartition(many, *key, "i", "j")
    return dealt.groupBy(*key, "i", "j").applyInArrow(lambda table: link_block(table, least, rows), _EDGES)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    one, two = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(lambda batches: verify(batches, least), _PAIRS)


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (rep, label) brought up to date with more edges (a, b): every component gets its smallest label.

    Labels of neighbours are taken over, then labels of labels, so long chains shrink quickly.
    """
    of_a, of_b = (labels.select(F.col("rep").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
    joined = edges.join(of_a, "a").join(of_b, "b").filter("label_a != label_b")
    if edges.isEmpty():
        return labels
    links = stored(joined.select(F.least("label_a", "label_b").alias("u"), F.greatest("label_a", "label_b").alias("v")).distinct())
    both = links.union(links.select("v", "u"))
    state = stored(both.select("u").distinct().select("u", F.col("u").alias("low")))
    while True:
        near = both.join(state.select(F.col("u").alias("v"), "low"), "v").groupBy("u").agg(F.min("low").alias("near"))
        taken = state.join(near, "u").select("u", F.col("low").alias("was"), F.least("low", "near").alias("low"))
        jump = taken.select(F.col("u").alias("low"), F.col("low").alias("lower"))
        after = stored(taken.join(jump, "low").select("u", "was", F.least("low", "lower").alias("low")))
        changed = after.filter("low != was").limit(1).count()
        state = after.select("u", "low")
        if not changed:
            break
    moved = state.select(F.col("u").alias("label"), "low")
    return stored(labels.join(moved, "label", "left").select("rep", F.coalesce("low", "label").alias("label")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash (x, y), and text, of the rows that have a doc_id and a text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.filter("doc_id is not null and text is not null").select("doc_id", *text_hash(F.col("text")), "text")


def text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")]


def text_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per distinct text: its hash (x, y), the smallest doc_id that has it (first), its number (rep) and that of its class (label)."""
    texts = keyed_texts(docs)
    distinct = texts.groupBy("x", "y").agg(F.min("doc_id").alias("first"))
    distinct = stored(distinct.select("x", "y", "first", F.monotonically_increasing_id().alias("rep")))
    numbers = distinct.select(F.col("first").alias("doc_id"), "x", "y", "rep")

    signed = texts.select(F.struct("doc_id", "x", "y").alias("key"), "text").mapInArrow(lambda batches: sign(batches, bands, rows), _SIGNED)
    signed = stored(signed.select("key.*", "bands", "registers").join(numbers, ["doc_id", "x", "y"]))
    keyed = signed.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = keyed.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).filter("hub != most").drop("most")
    members = stored(keyed.join(shared, ["band", "hash"]).distinct())

    labels = stored(members.select("rep").distinct().select("rep", F.col("rep").alias("label")))
    candidates = signed.select("doc_id", "x", "y", "rep", "registers").join(labels, "rep", "left_semi")
    sets = texts.join(candidates, ["doc_id", "x", "y"]).select("rep", "registers", "text")
    sets = stored(sets.mapInArrow(shingle_sets, _SETS).dropDuplicates(["rep"]))

    # First each member meets the smallest hub of its buckets, which settles most of them.
    nearest = members.groupBy("rep").agg(F.min("hub").alias("hub")).filter("hub != rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    labels = components(labels, stored(verified(nearest, sets, least)))

    # Then members of one bucket and different classes are compared.
    labels = components(labels, stored(links_within(members, labels, sets, least, rows)))
    return stored(distinct.join(labels, "rep", "left").select("x", "y", "first", "rep", F.coalesce("label", "rep").alias("label")))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its class) and rep (the smallest doc_id with an equal text)."""
    classes = text_classes(docs, least, bands, rows)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hash(F.col("text").cast("string")), F.col("text").isNull().alias("no_text"))
    own = stored(ids.filter("doc_id is not null and not no_text").join(classes, ["x", "y"]).select("doc_id", "first", "label"))
    # A doc_id with several texts joins their classes.
    several = own.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("most")).filter("a != most")
    links = stored(own.join(several, "doc_id").filter("label != a").select("a", F.col("label").alias("b")).distinct())
    labels = components(classes.select(F.col("label").alias("rep"), "label").distinct(), links).withColumnRenamed("rep", "old")
    named = classes.join(labels.withColumnRenamed("label", "new"), F.col("label") == F.col("old")).groupBy("new").agg(F.min("first").alias("class_id"))
    named = labels.join(named, F.col("label") == F.col("new")).select(F.col("old").alias("label"), "class_id")
    found = own.join(named, "label").select("doc_id", "class_id", F.col("first").alias("rep"))
    rest = ids.filter("doc_id is null or no_text").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep"))
    return found.unionByName(rest)


def one_per_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each class of texts the rows with the smallest doc_id, of equal doc_id and text one; rows without a doc_id or text stay."""
    classes = text_classes(docs, least)
    best = classes.groupBy("label").agg(F.min(F.struct("first", "rep")).alias("best")).select("best.rep")
    kept = classes.join(best, "rep", "left_semi").select(F.col("first").alias("doc_id"), "x", "y")
    # All columns travel as one, so that none can clash with those that are added.
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *text_hash(F.col("text").cast("string")), F.col("text").isNull().alias("no_text"))
    chosen = rows.filter("doc_id is not null and not no_text").join(kept, ["doc_id", "x", "y"], "left_semi")
    if not keyed_texts(docs).groupBy("doc_id", "x", "y").count().filter("count > 1").isEmpty():
        # Copies of a row: Spark sends on one per task only.
        order = Window.partitionBy("doc_id", "x", "y").orderBy(F.xxhash64("row"))
        chosen = chosen.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return chosen.select("row.*").unionByName(rows.filter("doc_id is null or no_text").select("row.*"))
