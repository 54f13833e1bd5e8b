"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: a share of all words, divided by weight, but at most ``cap`` times its own size; what a
capped source leaves is divided again among the others. All documents of a source expect the same number of copies, target /
source size. Lined up by size, their expected copies are added up from one random offset per source, and a document is taken
once for every whole number that its stretch crosses. Since neighbours have like sizes, the words taken stay near the target.

A document's place in its source is a sum of counts: of smaller size blocks, of cells of a block, and its place in its own cell. A cell
holds the documents of one source and size whose hash starts alike, so that a source or a size with a third of all rows is
spread over thousands of cells and no task sorts a source. Only the table with one row per source is ordered as a whole.

Null text has no words, documents without words take part and add nothing, a null source is a source like others and comes last. Rows of
equal id, size and text change places at will: they get the same copies in another order. Other columns go along unchanged;
names that start with ``mix_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns_of

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words: 150 %
CAP = 2
BLOCK = 64  # sizes per block
SEED = "mix-1"

_SPACE = "[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and the controls from tab to carriage return."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, _SPACE))).cast("long")


def unit(text: Column) -> Column:
    """A number from 0 to below 1 by the text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Targets from one row per source (mix_source, mix_key, mix_source_size): adds mix_target, mix_rate, mix_offset.

    A source is capped if, with all sources of smaller size per weight capped, its part of the rest exceeds its cap. Sums and
    comparisons are in whole numbers.
    """
    upper, lower = share
    by_source = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("mix_source_size") / F.col("mix_weight"), "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("mix_source_size") * cap
    weighed = sizes.withColumn("mix_weight", weight)
    ordered = weighed.select(
        "*",
        limit.alias("mix_limit"),
        (F.sum("mix_source_size").over(everything) * upper).alias("mix_total"),
        F.coalesce(F.sum(limit).over(before), F.lit(0)).alias("mix_used"),
        (F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0))).alias("mix_open"),
    )
    capped = F.col("mix_limit") * lower * F.col("mix_open") <= (F.col("mix_total") - F.col("mix_used") * lower) * F.col("mix_weight")
    marked = ordered.withColumn("mix_capped", capped)
    used = F.coalesce(F.sum(F.when(F.col("mix_capped"), F.col("mix_limit"))).over(everything), F.lit(0))
    open_ = F.sum(F.when(~F.col("mix_capped"), F.col("mix_weight"))).over(everything)
    part = ((F.col("mix_total") - used * lower) * F.col("mix_weight")).cast("double") / (open_ * lower).cast("double")
    target = F.when(F.col("mix_capped"), F.col("mix_limit").cast("double")).otherwise(part)
    return marked.select("mix_source", "mix_key", "mix_source_size", target.alias("mix_target")).select(
        "*",
        F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0).alias("mix_rate"),
        unit(F.concat(F.lit(seed + "/"), F.col("mix_key"))).alias("mix_offset"),
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """All columns of ``docs``, and mix_size, mix_source_size, mix_target and mix_copies (0 to ``cap``)."""
    own = docs.select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("mix_key"),
        n_words(F.col("text")).alias("mix_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mix_hash"),
        F.xxhash64("text").alias("mix_tie"),
    ).withColumn("mix_salt", F.substring("mix_hash", 1, 3))
    cell = ["mix_key", "mix_size", "mix_salt"]
    cells = own.groupBy(*cell).agg(F.count("*").alias("mix_n"), F.min("source").alias("mix_source")).withColumn("mix_block", F.expr(f"mix_size div {BLOCK}"))
    blocks = cells.groupBy("mix_key", "mix_block").agg(
        F.sum("mix_n").alias("mix_n"), F.sum(F.col("mix_n") * F.col("mix_size")).alias("mix_words"), F.min("mix_source").alias("mix_source")
    )
    sources = blocks.groupBy("mix_key").agg(F.min("mix_source").alias("mix_source"), F.sum("mix_words").alias("mix_source_size"))
    targets = source_targets(sources, weights, share, cap, seed).drop("mix_source")
    ahead = lambda *by: F.coalesce(F.sum("mix_n").over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("mix_key", "mix_block", ahead("mix_key", ["mix_block"]).alias("mix_blocks_ahead")).join(targets, "mix_key")
    cells = cells.select(*cell, "mix_block", ahead("mix_key", "mix_block", ["mix_size", "mix_salt"]).alias("mix_cells_ahead")).join(blocks, ["mix_key", "mix_block"])
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("mix_hash", F.col("doc_id"), "mix_tie")) + F.col("mix_cells_ahead") + F.col("mix_blocks_ahead")
    placed = own.join(cells.drop("mix_block"), cell).withColumn("mix_place", place)
    upto = lambda n: F.floor(n * F.col("mix_rate") + F.col("mix_offset"))
    # A stretch of at most ``cap`` crosses at most so many whole numbers; rounding must not add one.
    crossed = F.least(upto(F.col("mix_place")) - upto(F.col("mix_place") - 1), F.lit(cap)).cast("int")
    return placed.select(*columns_of(docs), "mix_size", "mix_source_size", "mix_target", crossed.alias("mix_copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken, with the same columns."""
    taken = copies(docs, weights, share, cap, seed).filter("mix_copies > 0")
    return taken.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")).drop("mix_copy")
