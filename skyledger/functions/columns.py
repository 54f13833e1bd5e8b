"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> str:
    """A column name safe inside SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def flight_date(year: Column | str = "year", month: Column | str = "month", day: Column | str = "day") -> Column:
    """DATE from three integers; NULL when a part is NULL or the date does not exist.

    The guards keep ``make_date`` away from values it would raise on under ANSI, and
    no string is built or parsed per row.
    """
    y, m, d = as_column(year), as_column(month), as_column(day)
    first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return F.when(d.between(F.lit(1), F.dayofmonth(F.last_day(first))), F.date_add(first, (d - 1).cast("int")))


def month_key(date: Column | str = "date") -> Column:
    """Partition value of a date: year and month, e.g. ``2015-03``."""
    return F.date_format(as_column(date), "yyyy-MM")


def delay_flag(delay: Column | str = "departure_delay") -> Column:
    """1 for a late departure, 0 for an early, punctual or unknown one."""
    return F.coalesce((as_column(delay) > 0).cast("int"), F.lit(0))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as DOUBLE, NULL (not an error) for an empty whole."""
    return F.try_divide(as_column(part).cast("double"), as_column(whole).cast("double"))


def date_parts(date: Column | str = "date") -> dict[str, Column]:
    """Calendar attributes of a date; ``day_of_week`` counts from 1 = Sunday."""
    d = as_column(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.dayofweek(d),
        "quarter": F.quarter(d),
    }


def same_row(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Predicate: both rows agree on every column, NULL agreeing with NULL."""
    return reduce(and_, [left[quoted(c)].eqNullSafe(right[quoted(c)]) for c in columns])


def row_key(columns: Sequence[str]) -> Column:
    """The columns as one non-NULL struct.

    Two such structs are equal when all their fields are, NULL fields included, so a
    plain equi-join or a grouping on it is null-safe and both hash-partition alike.
    """
    return F.struct(*[named(c) for c in columns])


# Fixed names of the two columns that `with_row_key` adds.
ROW_KEY = ["_hash", "_key"]


def with_row_key(df: DataFrame, columns: Sequence[str], null_safe: bool = True) -> DataFrame:
    """The rows with the columns' `row_key` and, ahead of it, its hash.

    Joining on both sorts by a plain number first, which Spark does several times faster than
    comparing structs. Without ``null_safe`` the hash of a row with a NULL is NULL, so it matches nothing.
    """
    hashed = F.xxhash64(*[named(c) for c in columns])
    if not null_safe:
        hashed = F.when(reduce(and_, [named(c).isNotNull() for c in columns]), hashed)
    return df.withColumns({"_hash": hashed, "_key": row_key(columns)})


def level_label(columns: Sequence[str], present: dict[str, Column]) -> Column:
    """Names of the present columns joined by ``_``, or ``all`` when none is."""
    label = F.concat_ws("_", *[F.when(present[c], F.lit(c)) for c in columns])
    return F.when(label == "", F.lit("all")).otherwise(label)


def label_from_nulls(columns: Sequence[str]) -> Column:
    """Grouping level read off which columns are not NULL.

    Only right while no dimension value is itself NULL; `label_from_grouping` has no such limit.
    """
    return level_label(columns, {c: named(c).isNotNull() for c in columns})


def label_from_grouping(columns: Sequence[str], grouped: Iterable[str]) -> Column:
    """Grouping level from ``grouping()``; columns outside ``grouped`` are in no grouping set."""
    grouped = set(grouped)
    return level_label(columns, {c: (F.grouping(quoted(c)) == 0) if c in grouped else F.lit(False) for c in columns})
