"""Running sums and ranks along an order, also where one key has most of the rows.

Rows are laid out by ranges of (keys, order), so a key with many rows spreads over many partitions of even size. Sums run
within each partition; what the partitions before it hold of the same key is added. Only a key that continues from one partition to the
next needs that, so there is at most one such offset per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import ROW_KEY, as_column, named, row_key, with_row_key
from skyledger.sources.files import shared_folder

_ROW_BITS = 33  # of monotonically_increasing_id: the place within the partition


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows, written once to the shared folder in ranges of ``order``; ``_part`` and ``_row`` say where each is.

    Rows that tie may stand in either order. Everything that is computed from the two numbers reads the same files, so
    they agree, also when an executor is lost.
    """
    columns = [as_column(c) for c in order]
    place = F.monotonically_increasing_id()
    arranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    numbered = arranged.select("*", place.alias("_place")).select(
        "*",
        F.shiftrightunsigned("_place", _ROW_BITS).cast("int").alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    path = shared_folder(df.sparkSession, "ranges")
    numbered.drop("_place").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column]
) -> DataFrame:
    """Sums over the rows of the same key up to and with this one, as columns of type BIGINT; NULL keys are equal.

    ``df`` should not have columns that begin with an underscore. The sum over equal places of the order is
    that of one of their possible orders.
    """
    laid = in_ranges(df, [*[named(k) for k in keys], *order])
    names = list(sums)
    same = Window.partitionBy("_part", *[named(k) for k in keys]).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = laid.select("*", *[F.sum(sums[n]).over(same).cast("long").alias(f"_sum_{n}") for n in names])
    # A partition's first key is the only one that can have begun before it.
    heads = laid.where("_row = 0").select(row_key(keys).alias("_key"))
    totals = laid.groupBy("_part", row_key(keys).alias("_key")).agg(*[F.sum(sums[n]).cast("long").alias(n) for n in names])
    totals = totals.join(F.broadcast(heads.distinct()), "_key", "left_semi")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", "_key", *[F.sum(n).over(before).alias(f"_before_{n}") for n in names])
    offsets = offsets.where(F.col(f"_before_{names[0]}").isNotNull())  # at most one row per partition
    whole = [(F.col(f"_sum_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in names]
    kept = [named(c) for c in df.columns]
    return local.withColumn("_key", row_key(keys)).join(F.broadcast(offsets), ["_part", "_key"], "left").select(*kept, *whole)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """The rows with their number, from 1, among those of the same key."""
    return running_sums(df, keys, order, {name: F.lit(1)})


def rank_hot(df: DataFrame, keys: Sequence[str], value: str, descending: bool = True) -> DataFrame:
    """``rank() OVER (PARTITION BY keys ORDER BY value)`` as column ``rank``, for keys of any number of distinct values.

    Rows are counted per (key, value) first, so copies of a value are one row of the running sum; the sums are
    taken along ranges, so no task has a key's values to itself. NULL values come first ascending and last descending.
    """
    columns = [*keys, value]
    counts = df.groupBy(*[named(c) for c in columns]).agg(F.count(F.lit(1)).alias("row_count"))
    order = named(value).desc() if descending else named(value).asc()
    summed = running_sums(counts, keys, [order], {"upto": F.col("row_count")})
    ranks = with_row_key(summed, columns).select(*ROW_KEY, (F.col("upto") - F.col("row_count") + 1).alias("rank"))
    return with_row_key(df, columns).join(ranks, ROW_KEY).drop(*ROW_KEY)
