"""Rows that a stored relation already has: anti joins and insert-only merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import ROW_KEY, named, with_row_key


def _keys_of(stored: DataFrame, names: Sequence[str], distinct: bool) -> DataFrame:
    """The stored side of a comparison: its row keys alone.

    Grouping by the columns but joining on their row key makes Spark shuffle the distinct keys
    once more. That is wanted: AQE splits a skewed join side only if both sides come
    straight from a shuffle, and the batch may hold one key a million times.
    """
    columns = stored.select(*[named(c) for c in names])
    return with_row_key(columns.distinct() if distinct else columns, names).select(ROW_KEY)


def _folded(batch: DataFrame, names: Sequence[str], null_safe: bool = True) -> DataFrame:
    """The batch with its row key in place of the key's columns: a join ships each column once."""
    rest = [named(c) for c in batch.columns if c not in names]
    return with_row_key(batch, names, null_safe).select(*ROW_KEY, *rest)


def _unfolded(folded: DataFrame, batch: DataFrame, names: Sequence[str]) -> DataFrame:
    """The batch's own columns again, in their order."""
    return folded.select(*[F.col("_key")[c].alias(c) if c in names else named(c) for c in batch.columns])


def without_existing(
    batch: DataFrame,
    stored: DataFrame,
    columns: Sequence[str] | None = None,
    null_safe: bool = True,
    stored_is_unique: bool = False,
) -> DataFrame:
    """Rows of ``batch`` that no row of ``stored`` equals on ``columns`` (default: all of the batch's).

    Copies within the batch are kept, unlike EXCEPT. With ``null_safe`` two NULLs are equal,
    without it a row with a NULL never has a match.

    A hot group of copies on the stored side is reduced to one row ahead of the shuffle; if the
    stored rows are known to be unique in ``columns`` that step is left out. Copies on the batch
    side are spread by AQE's skew join.
    """
    names = list(columns or batch.columns)
    seen = _keys_of(stored, names, not stored_is_unique)
    return _unfolded(_folded(batch, names, null_safe).join(seen, ROW_KEY, "left_anti"), batch, names)


def changed_existing(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is stored, but with other values in some column."""
    known = _folded(batch, keys).join(_keys_of(stored, keys, True), ROW_KEY, "left_semi")
    return without_existing(_unfolded(known, batch, keys), stored)


def merge_insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """State of ``target`` after inserting the source rows whose key it lacks; matched rows stay as they are."""
    fresh = without_existing(source, target, keys, null_safe)
    return target.unionByName(fresh, allowMissingColumns=True)


def merge_replace(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of ``target`` after the source's rows took the place of those with the same key."""
    return without_existing(target, source, keys).unionByName(source, allowMissingColumns=True)
