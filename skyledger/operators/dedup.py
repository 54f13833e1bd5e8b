"""Duplicates of a composite key: remove, find, count and rank them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import ROW_KEY, as_column, named, with_row_key


def drop_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, whichever Spark meets first. NULL keys are equal to each other."""
    return df.dropDuplicates(list(keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per key, the same one in every run.

    The survivor is the first in ``order_by``; all other columns follow as tie-break, so
    only identical rows can tie. Spark turns the ``= 1`` filter into a group limit ahead of the
    shuffle: a task sends on at most one row per key it has seen, however many copies a key has.
    """
    rest = [named(c).asc_nulls_first() for c in df.columns if c not in keys]
    order = [as_column(c) for c in order_by or []] + rest
    # The hash ahead of the key gives the sort a number to go by; it splits no group.
    key = [named(k) for k in keys]
    place = Window.partitionBy("_hash", *key).orderBy(*(order or [F.lit(1)]))
    ranked = df.withColumn("_hash", F.xxhash64(*key)).withColumn("_place", F.row_number().over(place))
    return ranked.where("_place = 1").drop("_place", "_hash")


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("row_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return key_counts(df, keys).where("row_count > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key is not unique, with the size of its group as ``row_count``.

    What ``count(*) OVER (PARTITION BY keys)`` filtered to > 1 returns, without bringing a
    group together: keys are counted with map-side combine and only the duplicated ones are
    joined back, so a key with a third of all rows is split by AQE like any skewed join side.
    """
    repeated = with_row_key(duplicate_keys(df, keys), keys).select(*ROW_KEY, "row_count")
    return with_row_key(df, keys).join(repeated, ROW_KEY).drop(*ROW_KEY)


def rank_within_key(df: DataFrame, keys: Sequence[str], value: str, descending: bool = True) -> DataFrame:
    """``rank() OVER (PARTITION BY keys ORDER BY value)`` as column ``rank``.

    A row's rank is one more than the number of rows ahead of it, so rows are first
    counted per (key, value); the window then runs over distinct values only, not over all
    rows of a key, and the ranks are joined back.
    """
    columns = [*keys, value]
    counts = with_row_key(key_counts(df, columns), columns)
    order = named(value).desc() if descending else named(value).asc()
    ahead = Window.partitionBy(*[named(k) for k in keys]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("row_count").over(ahead), F.lit(0)) + 1
    return with_row_key(df, columns).join(counts.select(*ROW_KEY, rank.alias("rank")), ROW_KEY).drop(*ROW_KEY)
