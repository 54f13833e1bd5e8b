"""Report queries over the aggregate table.

Every report takes the aggregate table and, where the question has one, an airline pattern
(``%`` for all, else a code) and a year. `LEVELS` names the levels a report reads, so that it
can also run on an aggregate of just those.

Rates of a report over all airlines are unweighted means over the airlines, as the
dashboards show them; `headline(weighted=True)` gives the rates over flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import ratio
from skyledger.operators.levels import Level
from skyledger.operators.reshape import to_long
from skyledger.schemas import CANCELLATION_REASONS

# What the reason codes stand for, as column names and as labels.
REASON_COLUMNS = {"A": "airline_carrier", "B": "weather", "C": "national_air_system", "D": "security"}
REASON_LABELS = {
    "security": "Security",
    "national_air_system": "National Air System",
    "airline_carrier": "Airline/Carrier",
    "weather": "Weather",
}
VOLUMES = ("total_flights", "delayed_flights", "cancelled_flights")

BY_AIRLINE: Level = ("airline",)
BY_AIRLINE_YEAR: Level = ("airline", "year")
BY_AIRLINE_MONTH: Level = ("airline", "year", "month")
BY_AIRLINE_WEEKDAY: Level = ("airline", "day_of_week")
BY_ORIGIN_MONTH: Level = ("origin_airport", "year", "month")


def level(gold: DataFrame, time: str, dimension: str) -> DataFrame:
    """Rows of one level of the aggregate table."""
    return gold.where((F.col("time_agg_level") == time) & (F.col("agg_level") == dimension))


def airline_level(gold: DataFrame, time: str, airline: str = "%", year: int | None = None) -> DataFrame:
    """Per-airline rows of a time level; a NULL airline matches no pattern."""
    rows = level(gold, time, "airline").where(F.col("airline").like(airline))
    return rows if year is None else rows.where(F.col("year") == year)


def _sums(*columns: str) -> list:
    return [F.sum(c).alias(c) for c in columns]


def _means(*columns: str) -> list:
    return [F.avg(c).alias(c) for c in columns]


def airlines(gold: DataFrame) -> DataFrame:
    """Airlines to choose from, one row per airline and year."""
    return level(gold, "year", "airline").select("airline")


def headline(gold: DataFrame, airline: str = "%", year: int | None = None, weighted: bool = False) -> DataFrame:
    """Totals and rates per year."""
    by_year = airline_level(gold, "year", airline, year).groupBy("year")
    if not weighted:
        means = _means("delayed_rate", "avg_delay_time", "cancelled_rate")
        found = by_year.agg(*_sums(*VOLUMES), *means)
        order = ["total_flights", "delayed_flights", "delayed_rate", "avg_delay_time", "cancelled_flights"]
        return found.select("year", *order, "cancelled_rate")
    return by_year.agg(*_sums(*VOLUMES)).select(
        "year",
        *VOLUMES,
        ratio("delayed_flights", "total_flights").alias("delayed_rate"),
        ratio("cancelled_flights", "total_flights").alias("cancelled_rate"),
    )


def monthly_volume(gold: DataFrame, airline: str = "%") -> DataFrame:
    return airline_level(gold, "year_month", airline).groupBy("year", "month").agg(*_sums(*VOLUMES)).orderBy("month")


def weekday_volume(gold: DataFrame, airline: str = "%") -> DataFrame:
    """Per day of week over all years; ``year`` is NULL at this level."""
    found = airline_level(gold, "day_of_week", airline).groupBy("year", "day_of_week").agg(*_sums(*VOLUMES))
    return found.orderBy("day_of_week")


def monthly_volume_long(gold: DataFrame, airline: str = "%") -> DataFrame:
    return to_long(monthly_volume(gold, airline), VOLUMES, "metric", "volume")


def weekday_volume_long(gold: DataFrame, airline: str = "%") -> DataFrame:
    return to_long(weekday_volume(gold, airline), VOLUMES, "metric", "volume")


def monthly_delays(gold: DataFrame, airline: str = "%") -> DataFrame:
    rows = airline_level(gold, "year_month", airline)
    return rows.groupBy("year", "month").agg(*_means("delayed_rate", "avg_delay_time"))


def monthly_delays_by_origin(gold: DataFrame, origin: str = "%") -> DataFrame:
    rows = level(gold, "year_month", "origin_airport").where(F.col("origin_airport").like(origin))
    return rows.select("year", "month", "origin_airport", "delayed_rate", "avg_delay_time")


def airline_reliability(gold: DataFrame) -> DataFrame:
    return level(gold, "all", "airline").select("airline", "delayed_rate", "avg_delay_time").orderBy("airline")


def most_reliable(gold: DataFrame, k: int) -> DataFrame:
    """The k airlines with the smallest share of late departures."""
    return level(gold, "all", "airline").select("airline", "delayed_rate").orderBy("delayed_rate", "airline").limit(k)


def least_reliable(gold: DataFrame, k: int) -> DataFrame:
    ordered = level(gold, "all", "airline").select("airline", "delayed_rate")
    return ordered.orderBy(F.desc("delayed_rate"), "airline").limit(k)


def monthly_cancellation_rates(gold: DataFrame, airline: str = "%") -> DataFrame:
    shares = [f"percent_cancellations_{r}" for r in CANCELLATION_REASONS]
    return airline_level(gold, "year_month", airline).groupBy("year", "month").agg(*_means("cancelled_rate", *shares))


def _by_reason(gold: DataFrame, time: str, airline: str, *periods: str) -> DataFrame:
    sums = [F.sum(f"cancellations_{code}").alias(name) for code, name in REASON_COLUMNS.items()]
    return airline_level(gold, time, airline).groupBy(*periods).agg(*sums)


def monthly_cancellations(gold: DataFrame, airline: str = "%") -> DataFrame:
    """Cancellations per month and reason, long form."""
    wide = _by_reason(gold, "year_month", airline, "year", "month")
    return to_long(wide, list(REASON_COLUMNS.values()), "reason", "volume")


def yearly_cancellations(gold: DataFrame, airline: str = "%") -> DataFrame:
    """Cancellations per reason, one row per reason and year."""
    wide = _by_reason(gold, "year", airline, "year")
    return to_long(wide.drop("year"), REASON_LABELS, "name", "count", keep_nulls=True)


def cancellation_shares(gold: DataFrame, airline: str = "%") -> DataFrame:
    """`yearly_cancellations` with the column names of a pie chart."""
    return yearly_cancellations(gold, airline).withColumnRenamed("count", "value")


def overall_totals(gold: DataFrame) -> DataFrame:
    """All columns of the yearly totals over all flights."""
    return level(gold, "year", "all")


def overall_monthly_volume(gold: DataFrame) -> DataFrame:
    return level(gold, "year_month", "all").select("year", "month", "total_flights").orderBy("year", "month")


def overall_weekday_volume(gold: DataFrame) -> DataFrame:
    return level(gold, "day_of_week", "all").select("day_of_week", "total_flights").orderBy("day_of_week")


def overall_delays(gold: DataFrame) -> DataFrame:
    return level(gold, "year", "all").select("year", "delayed_rate", "avg_delay_time")


def overall_monthly_delays(gold: DataFrame) -> DataFrame:
    found = level(gold, "year_month", "all").select("year", "month", "delayed_rate", "avg_delay_time")
    return found.orderBy("year", "month")


def overall_cancellations(gold: DataFrame) -> DataFrame:
    shares = [f"percent_cancellations_{r}" for r in CANCELLATION_REASONS]
    return level(gold, "year", "all").select("year", "cancelled_flights", *shares)


def on_time_rates(gold: DataFrame) -> DataFrame:
    """Punctual and early departures per airline; needs the extended aggregate."""
    return level(gold, "all", "airline").select("airline", "total_flights", "on_time_flights", "on_time_rate")


LEVELS: dict[str, tuple[Level, ...]] = {
    "airlines": (BY_AIRLINE_YEAR,),
    "headline": (BY_AIRLINE_YEAR,),
    "monthly_volume": (BY_AIRLINE_MONTH,),
    "weekday_volume": (BY_AIRLINE_WEEKDAY,),
    "monthly_volume_long": (BY_AIRLINE_MONTH,),
    "weekday_volume_long": (BY_AIRLINE_WEEKDAY,),
    "monthly_delays": (BY_AIRLINE_MONTH,),
    "monthly_delays_by_origin": (BY_ORIGIN_MONTH,),
    "airline_reliability": (BY_AIRLINE,),
    "most_reliable": (BY_AIRLINE,),
    "least_reliable": (BY_AIRLINE,),
    "monthly_cancellation_rates": (BY_AIRLINE_MONTH,),
    "monthly_cancellations": (BY_AIRLINE_MONTH,),
    "yearly_cancellations": (BY_AIRLINE_YEAR,),
    "cancellation_shares": (BY_AIRLINE_YEAR,),
    "overall_totals": (("year",),),
    "overall_monthly_volume": (("year", "month"),),
    "overall_weekday_volume": (("day_of_week",),),
    "overall_delays": (("year",),),
    "overall_monthly_delays": (("year", "month"),),
    "overall_cancellations": (("year",),),
    "on_time_rates": (BY_AIRLINE,),
}
