"""The prefix trie of rebuilt conversations.

Conversation c is rebuilt as the first h turns of its base, conversation c - c % 100, followed by its own turns after the first h; h is crc32 of
the decimal c, modulo 6. A node of the trie is a distinct sequence of the first d rebuilt turns.

No rebuilt text is ever put together. A sequence of turns is an element (hash, length) of a monoid: turn t alone is (f(t), 1), and
(x, m)(y, n) = (x + A^m y, m + n), modulo a prime. Running sums of A^place f(t) along the stored turns give the hash of every
prefix; the hash of a conversation's own turns between two places is the difference of two of them times a power of A, and
the rebuilt prefix is the base's head times that suffix: a few numbers per turn. Four such hashes with different A, modulo 2^31 - 1, make one fingerprint of 124 bits.

Prefixes of equal depth and fingerprint are a node. That they are equal is verified through the stored turns they refer to: turns
of equal fingerprint have one role and text, each node has one last turn and one parent, and so by induction one sequence. Should a check
fail, all is done again with another seed.

Sums over subtrees need no walk along the tree. A node is owned by its smallest member; a member that owns a node owns all further nodes on its way, so
every conversation owns the end of its way from some depth on, perhaps nothing. The sum over a node's subtree is that over the rest of its owner's own
nodes and, of every other member, the total over its own nodes.

Turns are laid out by ranges of (conversation, turn), so a conversation of any length is spread; nodes are counted ahead of the shuffle, so a turn that
starts many conversations is one row per task. Lists of the conversations that end at a node are digested as streams of pieces of 4,096 numbers.

Null roles and texts are empty; turns without a number come first; rows of equal turn are ordered by role and text, and equal rows stay. Rows without
a conv_id are left out. An absent base, or one shorter than h, gives what it has. Other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ranks import numbered, running_sums

from .shared import partitions, stored

BASE_STEP = 100
HEADS = 6  # a head has fewer turns
PRIME = (1 << 31) - 1
BASES = (1103515245, 742938285, 950706376, 1226874159)  # of the four hashes
LANES = range(len(BASES))
PIECE = 4096
_LIST = "node string, ends_sha256 string"


def times(a: Column, b: Column) -> Column:
    """Of numbers below the prime, or below twice the prime for one of them."""
    return (a * b) % PRIME


def power(base: int, exponent: Column) -> Column:
    """base ^ exponent modulo the prime, from the powers of every hexadecimal digit; exponents below 2^40."""
    found = F.lit(1).cast("long")
    for digit in range(10):
        table = F.array(*[F.lit(pow(base, n << (4 * digit), PRIME)).cast("long") for n in range(16)])
        found = times(found, F.get(table, F.shiftright(exponent, 4 * digit).bitwiseAND(F.lit(15)).cast("int")))
    return found


def inverse(base: int, n: int) -> int:
    return pow(pow(base, n, PRIME), PRIME - 2, PRIME)


def turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, place (from 0), n_chars, and the turn's fingerprint f0 to f3; written once."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    words = [F.xxhash64(F.lit(2 * seed + k), "role", "text") for k in (0, 1)]
    marked = rows.select("*", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    placed = numbered(marked, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"])
    parts = {
        "f0": F.col("w0").bitwiseAND(F.lit(PRIME)) % PRIME,
        "f1": F.shiftrightunsigned("w0", 32).bitwiseAND(F.lit(PRIME)) % PRIME,
        "f2": F.col("w1").bitwiseAND(F.lit(PRIME)) % PRIME,
        "f3": F.shiftrightunsigned("w1", 32).bitwiseAND(F.lit(PRIME)) % PRIME,
    }
    return stored(placed.select("conv_id", (F.col("place") - 1).alias("place"), "role", "text", F.length("text").cast("long").alias("n_chars"), *[c.alias(n) for n, c in parts.items()]))


def same_texts(rows: DataFrame) -> bool:
    """Whether turns of one fingerprint have one role and text."""
    prints = [f"f{k}" for k in LANES]
    texts = rows.groupBy(*prints, "role", "text").agg(F.lit(1).alias("one"))
    return texts.groupBy(*prints).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def with_sums(rows: DataFrame) -> DataFrame:
    """Per turn: conv_id, place, n_chars, its term q = A^place f and the hash s of the turns up to and with it, for each of the four hashes."""
    terms = rows.select("conv_id", "place", "n_chars", *[times(power(BASES[k], F.col("place")), F.col(f"f{k}")).alias(f"q{k}") for k in LANES])
    summed = running_sums(terms, ["conv_id"], ["place"], {f"s{k}": F.col(f"q{k}") for k in LANES})
    return stored(summed.select("conv_id", "place", "n_chars", *[f"q{k}" for k in LANES], *[(F.col(f"s{k}") % PRIME).alias(f"s{k}") for k in LANES]))


def prefixes(sums: DataFrame) -> DataFrame:
    """Every first d turns of every rebuilt conversation: conv_id, depth, node, parent, the last turn's hash and length, and whether all ends here."""
    lanes = [F.struct(*[F.col(f"{x}{k}") for k in LANES]) for x in ("q", "s")]
    sizes = sums.groupBy("conv_id").agg((F.max("place") + 1).alias("n_own"))
    wanted = sizes.select("conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE_STEP).alias("base"))
    # Of a base, all turns that a head can have: at most five.
    turn = F.struct("place", "n_chars", lanes[0].alias("q"), lanes[1].alias("s"))
    heads = sums.where((F.col("conv_id") % BASE_STEP == 0) & (F.col("place") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    empty = F.array().cast(heads.schema["turns"].dataType)
    plans = wanted.join(heads, "base", "left").select("conv_id", "n_own", "h", F.coalesce(F.slice("turns", 1, F.col("h")), empty).alias("head"))
    # The own turns' sum before place h: that of the turn ahead of it.
    before = sums.where(F.col("place") < HEADS - 1).select("conv_id", F.col("place").alias("_place"), *[F.col(f"s{k}").alias(f"cut{k}") for k in LANES])
    cut_at = plans.join(before.withColumnRenamed("conv_id", "_conv"), (F.col("conv_id") == F.col("_conv")) & (F.col("h") - 1 == F.col("_place")), "left")
    n_head = F.size("head")
    end = F.try_element_at("head", F.lit(-1))["s"]
    plans = stored(
        cut_at.select(
            "conv_id",
            "h",
            "head",
            n_head.alias("n_head"),
            (n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size"),
            *[F.coalesce(F.col(f"cut{k}"), F.lit(0)).alias(f"cut{k}") for k in LANES],
            *[F.when(n_head > 0, end[f"s{k}"]).otherwise(F.lit(0)).alias(f"end{k}") for k in LANES],
        )
    )

    def key(depth: Column, hashes: list[Column]) -> Column:
        return F.struct(depth.cast("long").alias("depth"), *[h.cast("long").alias(f"x{k}") for k, h in enumerate(hashes)])

    zero = [F.lit(0)] * len(BASES)
    no_last = F.struct(*[F.lit(-1).cast("long").alias(f"x{k}") for k in LANES])
    root = F.struct(key(F.lit(0), zero).alias("node"), key(F.lit(-1), [F.lit(-1)] * len(BASES)).alias("parent"), no_last.alias("last"), F.lit(0).cast("long").alias("n_chars"))
    # A head's prefixes are prefixes of the base.
    in_head = F.transform(
        "head",
        lambda t: F.struct(
            key(t["place"] + 1, [t["s"][f"s{k}"] for k in LANES]).alias("node"),
            key(t["place"], [(t["s"][f"s{k}"] - t["q"][f"q{k}"] + PRIME) % PRIME for k in LANES]).alias("parent"),
            F.struct(*[t["q"][f"q{k}"].cast("long").alias(f"x{k}") for k in LANES]).alias("last"),
            t["n_chars"].alias("n_chars"),
        ),
    )
    first = plans.select("conv_id", "size", F.inline(F.concat(F.array(root), in_head)))
    # Own turns after the first h: the head's hash plus the difference of sums, moved from place h to place n_head.
    moved = sums.join(plans.drop("head"), "conv_id").where("place >= h")
    shift = F.col("h") - F.col("n_head")
    depth = F.col("place") - shift + 1
    scale = [F.get(F.array(*[F.lit(inverse(BASES[k], n)).cast("long") for n in range(HEADS)]), shift.cast("int")) for k in LANES]
    between = [(F.col(f"s{k}") - F.col(f"cut{k}") + PRIME) % PRIME for k in LANES]
    here = [(F.col(f"end{k}") + times(scale[k], between[k])) % PRIME for k in LANES]
    above = [(F.col(f"end{k}") + times(scale[k], between[k] - F.col(f"q{k}") + PRIME)) % PRIME for k in LANES]
    last = F.struct(*[times(scale[k], F.col(f"q{k}")).alias(f"x{k}") for k in LANES])
    own = moved.select("conv_id", "size", key(depth, here).alias("node"), key(depth - 1, above).alias("parent"), last.alias("last"), "n_chars")
    return first.unionByName(own).select("conv_id", F.col("node.depth").alias("depth"), "node", "parent", "last", "n_chars", (F.col("node.depth") == F.col("size")).alias("ends"))


def digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes' lists; a list's pieces come one after the other."""
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    current, digest = None, None
    for batch in batches:
        done = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != current:
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = node, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], schema=schema)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (current, digest.hexdigest())], schema=schema)


def ends(found: DataFrame) -> DataFrame:
    """Per node at which conversations end: the digest of their numbers, ascending and joined by commas."""
    placed = numbered(found.where("ends").select("node", "conv_id"), ["node"], ["conv_id"])
    pieces = placed.groupBy("node", F.floor((F.col("place") - 1) / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = pieces.select("node", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    laid = texts.repartition(partitions(found.sparkSession), "node").sortWithinPartitions("node", "piece")
    return laid.select(F.to_json("node").alias("node"), "text").mapInArrow(digest_pieces, _LIST)


def conversation_trie(conversations: DataFrame, seed: int = 0, attempts: int = 4) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for attempt in range(seed, seed + attempts):
        rows = turns(conversations, attempt)
        if not same_texts(rows):
            continue
        found = stored(prefixes(with_sums(rows)))
        refers = {f"{x}{k}": F.col(f"{x}.x{k}") for x in ("parent", "last") for k in LANES}
        nodes = found.groupBy("node").agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("owner"),
            F.count_if("ends").alias("n_ends"),
            F.max("n_chars").alias("n_chars"),
            *[F.min(c).alias(n) for n, c in refers.items()],
            *[F.max(c).alias(f"_{n}") for n, c in refers.items()],
        )
        nodes = stored(nodes)
        if nodes.where(reduce(or_, [F.col(n) != F.col(f"_{n}") for n in refers])).isEmpty():
            above = F.struct((F.col("node.depth") - 1).alias("depth"), *[F.col(f"parent{k}").alias(f"x{k}") for k in LANES])
            return summed_up(found, nodes.select("node", above.alias("parent"), "n_convs", "owner", "n_ends", "n_chars"))
    raise ValueError(f"{attempts} seeds in a row gave unlike turns one fingerprint")


def summed_up(found: DataFrame, nodes: DataFrame) -> DataFrame:
    depth = F.col("node.depth")
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    own = nodes.select(F.col("owner").alias("conv_id"), depth.alias("depth"), saved.alias("saved"), (F.col("n_convs") == F.col("n_ends")).alias("leaf"))
    # From the end of an owner's way up to each of its nodes.
    rests = running_sums(own, ["conv_id"], [F.desc("depth")], {"rest": F.col("saved")}).select("conv_id", "depth", "rest")
    owners = own.groupBy("conv_id").agg(
        F.min("depth").alias("from_depth"),
        F.max("depth").alias("last_depth"),
        F.sum("saved").alias("total"),
        F.max(F.col("leaf").cast("int")).alias("own_leaf"),
    )
    # What other members bring to the nodes above their own; the next one down is a child.
    brought = (
        found.select("conv_id", "depth", "node")
        .join(owners, "conv_id")
        .where("depth < from_depth")
        .groupBy("node")
        .agg(F.sum("total").alias("total"), F.sum("own_leaf").alias("leaves"), F.count_if(F.col("depth") == F.col("from_depth") - 1).alias("branches"))
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    base = nodes.select("node", "parent", "n_convs", F.col("owner").alias("conv_id"), depth.alias("depth"))
    tops = (
        base.join(rests, ["conv_id", "depth"])
        .join(owners.drop("total"), "conv_id")
        .join(brought, "node", "left")
        .withColumn("list", F.to_json("node"))
        .join(ends(found).withColumnRenamed("node", "list"), "list", "left")
    )
    # Below its top node an owner's parents are its own; the top one's is looked up.
    parents = base.join(owners, "conv_id").where("depth = from_depth AND depth > 0").select("conv_id", "parent").join(above, "parent").select(F.col("conv_id").alias("_conv"), "parent_conv_id")
    whole = tops.join(parents, F.col("conv_id") == F.col("_conv"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("from_depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
        "n_convs",
        (zero("branches") + (F.col("depth") < F.col("last_depth")).cast("long")).alias("n_children"),
        (F.col("own_leaf") + zero("leaves")).cast("long").alias("n_leaves"),
        (F.col("rest") + zero("total")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
