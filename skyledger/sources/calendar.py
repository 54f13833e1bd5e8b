"""Generated calendar relation and its holidays."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import as_column, date_parts
from skyledger.schemas import CALENDAR, ddl_columns
from skyledger.sources.files import literal_table

# The U.S. federal holidays with the years in which each rule held (NULL: to this day). A rule is
# a month with a day of the month, or with the n-th (-1: last, -2: last but one) weekday counted from 0 = Monday.
FIXED_DAYS = (
    ("New Year's Day", 1, 1, 1871, None),
    ("Presidents' Day", 2, 22, 1880, 1970),
    ("Memorial Day", 5, 30, 1888, 1970),
    ("Juneteenth", 6, 19, 2021, None),
    ("Independence Day", 7, 4, 1870, None),
    ("Veterans Day", 11, 11, 1938, 1970),
    ("Veterans Day", 11, 11, 1978, None),
    ("Christmas Day", 12, 25, 1870, None),
)
WEEKDAYS = (
    ("Martin Luther King Jr. Day", 1, 3, 0, 1986, None),
    ("Presidents' Day", 2, 3, 0, 1971, None),
    ("Memorial Day", 5, -1, 0, 1971, None),
    ("Labor Day", 9, 1, 0, 1894, None),
    ("Columbus Day", 10, 2, 0, 1971, None),
    ("Veterans Day", 10, 4, 0, 1971, 1977),
    ("Thanksgiving Day", 11, -1, 3, 1870, 1938),
    ("Thanksgiving Day", 11, -2, 3, 1939, 1941),
    ("Thanksgiving Day", 11, 4, 3, 1942, None),
)

Holidays = Sequence[tuple[str, str]]


def federal_holiday(date: Column | str = "date") -> Column:
    """Name of the federal holiday that a date was by the rules of its year, else NULL."""
    d = as_column(date)
    day, left = F.dayofmonth(d), F.dayofmonth(F.last_day(d)) - F.dayofmonth(d)

    def held(month: int, first: int, last: int | None) -> Column:
        within = (F.month(d) == month) & (F.year(d) >= first)
        return within if last is None else within & (F.year(d) <= last)

    found = F.lit(None).cast("string")
    for name, month, nth, weekday, first, last in WEEKDAYS:
        week = F.floor((day - 1) / 7) + 1 == nth if nth > 0 else F.floor(left / 7) + 1 == -nth
        found = F.when(held(month, first, last) & (F.weekday(d) == weekday) & week, name).otherwise(found)
    for name, month, number, first, last in FIXED_DAYS:
        found = F.when(held(month, first, last) & (day == number), name).otherwise(found)
    return found


def holiday_table(spark: SparkSession, holidays: Holidays) -> DataFrame:
    """Literal relation (holiday_date, holiday_name); the dates are given as text."""
    literal = literal_table(spark, holidays, "holiday_date STRING, holiday_name STRING")
    return literal.withColumn("holiday_date", F.try_to_date("holiday_date"))


def _describe(dates: DataFrame, holidays: Holidays | None) -> DataFrame:
    """Calendar columns for a relation with one ``date`` column; a caller's own holidays are a literal list."""
    described = dates.select("date", *[expr.alias(name) for name, expr in date_parts().items()])
    if holidays is None:
        described = described.withColumn("holiday_name", federal_holiday())
    else:
        named_days = holiday_table(dates.sparkSession, holidays)
        described = described.join(named_days, F.col("date") == F.col("holiday_date"), "left")
    return described.withColumn("is_holiday", F.col("holiday_name").isNotNull()).select(*ddl_columns(CALENDAR))


def calendar(
    spark: SparkSession,
    start: dt.date = dt.date(2015, 1, 1),
    end: dt.date = dt.date(2015, 12, 31),
    holidays: Holidays | None = None,
) -> DataFrame:
    """One row per day from ``start`` to ``end``, in date order; default holidays are the federal ones."""
    days = (end - start).days + 1
    first = F.make_date(F.lit(start.year), F.lit(start.month), F.lit(start.day))
    dates = spark.range(0, max(days, 0), 1, 1).select(F.date_add(first, F.col("id").cast("int")).alias("date"))
    return _describe(dates, holidays).orderBy("date")


def calendar_covering(df: DataFrame, date: Column | str = "date", holidays: Holidays | None = None) -> DataFrame:
    """Calendar from the first to the last date found in ``df``, so an inner join to it loses no dated row.

    Stays lazy: the two bounds are one aggregated row, unfolded where it is computed. At
    most the 3.65 million days of years 1-9999 can come out of it.
    """
    bounds = df.agg(F.min(as_column(date)).alias("first"), F.max(as_column(date)).alias("last"))
    dates = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    return _describe(dates, holidays)
