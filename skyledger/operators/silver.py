"""Raw flights to the silver relation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyledger.functions.columns import delay_flag, flight_date, named
from skyledger.schemas import RAW_DATE_PARTS


def to_silver(raw: DataFrame, ordered: bool = False) -> DataFrame:
    """``date`` first, then the raw columns without the date parts, then ``is_delayed``.

    One projection, no shuffle. ``ordered`` adds the global sort by date and scheduled
    departure for callers that show or export the rows; the load path leaves it out because
    deduplication and the table layout would destroy that order again.
    """
    kept = [named(c) for c in raw.columns if c not in RAW_DATE_PARTS]
    silver = raw.select(flight_date().alias("date"), *kept, delay_flag().alias("is_delayed"))
    return silver.orderBy("date", "scheduled_departure") if ordered else silver


def move_first(df: DataFrame, *columns: str) -> DataFrame:
    """The same columns with the given ones in front."""
    return df.select(*[named(c) for c in columns], *[named(c) for c in df.columns if c not in columns])
