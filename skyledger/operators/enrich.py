"""Joins of flights with the calendar and the code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import date_parts, named

def with_calendar(flights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Inner join on ``date``: flights gain the calendar's columns, flights on other dates are dropped.

    A calendar is small beside the flights, and Spark broadcasts it where its size allows.
    """
    return flights.join(calendar, "date")


def with_date_parts(flights: DataFrame, *names: str) -> DataFrame:
    """The calendar attributes that follow from the date alone, computed in place.

    Equals `with_calendar` on a calendar that covers all dates, without any join; rows
    without a date are dropped as the join drops them.
    """
    parts = date_parts()
    return flights.where("date IS NOT NULL").select("*", *[parts[n].alias(n) for n in names or parts])


# Fixed value: shares into which rows without a code are split when a lookup is joined by shuffle.
SPREAD = 1024


def lookup(flights: DataFrame, codes: DataFrame, code: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Left join of a code table: ``columns`` maps its columns to their new names.

    Unknown codes keep the flight with NULL descriptions. Spark broadcasts the code table where its
    size allows. In a shuffle join rows without a code, often nearly all, match nothing and would meet in
    one task; they get one of many keys that no code has.
    """
    side = codes.select(F.col(key).cast("string").alias("_code"), *[F.col(c).alias(new) for c, new in columns.items()])
    share = F.pmod(F.xxhash64(*[named(c) for c in flights.columns]), F.lit(SPREAD)).cast("string")
    keyed = flights.withColumn("_key", F.coalesce(flights[code].cast("string"), F.concat(F.lit("\0"), share)))
    return keyed.join(side, keyed["_key"] == side["_code"], "left").drop("_code", "_key")
