"""Every operator and report as a query over the given tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import delay_flag, label_from_nulls, month_key
from skyledger.operators import dedup, enrich, existing, explore, levels, ranks
from skyledger.plans import metrics, proxy, publish, reports, states
from skyledger.quality import constraints, profile, rules, sketches, suggest
from skyledger.schemas import FLIGHT_KEY, GOLD_KEY, MONTH_COLUMN
from skyledger.sources import buckets, calendar, files, tables

Query = Callable[[SparkSession, str], DataFrame]

# One airline and one origin for reports with a parameter, and the split into two loads.
AIRLINE = "1-URGENT"
ORIGIN = "NATION_7"

FIRST_LOAD = "date < DATE '1999-01-01'"
DIGITS = 9

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _flights_once(spark, sf_dir):
    """Flights for a query that reads them several times: joined once, read from files then."""
    return files.written_once(proxy.flights(spark, sf_dir), "flights")


def _unique_flights_once(spark, sf_dir):
    """The same with one row per flight key."""
    return files.written_once(dedup.first_per_key(proxy.flights(spark, sf_dir), FLIGHT_KEY), "unique-flights")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of fractions depend on the order of summation in their last digits; compare them rounded."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# --- silver, duplicates, calendar ---------------------------------------------------------------


@query
def silver_flights(spark, sf_dir):
    return proxy.flights(spark, sf_dir)


@query
def dedup_first(spark, sf_dir):
    return dedup.first_per_key(proxy.flights(spark, sf_dir), FLIGHT_KEY)


@query
def dedup_any_keys(spark, sf_dir):
    return dedup.drop_duplicate_keys(proxy.flights(spark, sf_dir), FLIGHT_KEY).select(*FLIGHT_KEY)


@query
def dup_keys_having(spark, sf_dir):
    return dedup.duplicate_keys(proxy.flights(spark, sf_dir, destination=False), FLIGHT_KEY)


@query
def dup_rows_window(spark, sf_dir):
    return dedup.duplicate_rows(proxy.flights(spark, sf_dir), FLIGHT_KEY)


@query
def rank_in_airline_day(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    return dedup.rank_within_key(flights, ["date", "airline"], "departure_delay")


@query
def rank_hot_key(spark, sf_dir):
    """Ranks within one key that holds every row, and has nearly as many distinct values as rows."""
    lines = proxy.table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("fleet"), "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return ranks.rank_hot(lines, ["fleet"], "l_extendedprice")


@query
def numbered_events(spark, sf_dir):
    """Number of an event among those of its type, by time; types are few and hold many rows each."""
    events = proxy.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.col("ts").cast("date").alias("day"))
    return ranks.numbered(events, ["event_type"], ["day", "event_id"])


@query
def dim_dates(spark, sf_dir):
    orders = proxy.table(spark, sf_dir, "orders")
    return calendar.calendar_covering(orders, F.col("o_orderdate").cast("date"))


@query
def flights_enriched(spark, sf_dir):
    return enrich.with_calendar(proxy.flights(spark, sf_dir), dim_dates(spark, sf_dir))


@query
def flights_on_holidays(spark, sf_dir):
    flights = enrich.with_calendar(proxy.flights(spark, sf_dir, destination=False), dim_dates(spark, sf_dir))
    return flights.where("is_holiday").groupBy("holiday_name").agg(F.count(F.lit(1)).alias("flights"))


@query
def lookup_descriptions(spark, sf_dir):
    airports = proxy.airports(spark, sf_dir)
    found = enrich.lookup(
        proxy.flights(spark, sf_dir), proxy.airlines(spark), "airline", "iata_code", {"airline": "airline_name"}
    )
    found = enrich.lookup(
        found, airports, "origin_airport", "iata_code", {"city": "origin_city", "state": "origin_state"}
    )
    codes = {"cancellation_description": "cancellation_description"}
    return enrich.lookup(found, proxy.cancellation_codes(spark), "cancellation_reason", "cancellation_reason", codes)


# --- aggregate table -----------------------------------------------------------------------------


def _gold(spark, sf_dir, wanted=levels.GOLD_LEVELS, extended=False):
    return levels.gold(proxy.flights(spark, sf_dir, destination=False), levels=wanted, extended=extended)


@query
def gold_grouping_sets(spark, sf_dir):
    return _gold(spark, sf_dir)


@query
def gold_with_calendar(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    weekdays_off = dim_dates(spark, sf_dir).where("NOT is_holiday")
    return levels.gold(flights, weekdays_off)


@query
def gold_extended(spark, sf_dir):
    return _gold(spark, sf_dir, extended=True)


@query
def gold_levels(spark, sf_dir):
    labels = _gold(spark, sf_dir).groupBy("time_agg_level", "agg_level")
    return labels.agg(F.count(F.lit(1)).alias("groups"), F.sum("total_flights").alias("flights"))


@query
def gold_labels_from_nulls(spark, sf_dir):
    labelled = _gold(spark, sf_dir).select(
        *GOLD_KEY[:-2],
        label_from_nulls(levels.TIME_DIMENSIONS).alias("time_agg_level"),
        label_from_nulls(levels.OTHER_DIMENSIONS).alias("agg_level"),
    )
    return labelled


@query
def gold_distinct_levels(spark, sf_dir):
    return _gold(spark, sf_dir).select("agg_level").distinct()


DELAYS = ("total_flights", "delayed_flights", "delayed_rate", "avg_delay_time")


def _delay_levels(spark, sf_dir, time, other, chosen):
    dated = enrich.with_date_parts(proxy.flights(spark, sf_dir, destination=False), *levels.TIME_DIMENSIONS)
    found = levels.aggregate_levels(dated, chosen, time, other)
    return found.select(*time, *other, *DELAYS, "time_agg_level", "agg_level")


@query
def rollup_airline_month(spark, sf_dir):
    chosen = levels.rollup_levels(["airline", "year", "month"])
    return _delay_levels(spark, sf_dir, ["year", "month"], ["airline"], chosen)


@query
def rollup_reason(spark, sf_dir):
    chosen = levels.rollup_levels(["cancellation_reason", "year", "month", "day_of_week", "airline"])
    other = ["cancellation_reason", "airline"]
    return _delay_levels(spark, sf_dir, list(levels.TIME_DIMENSIONS), other, chosen)


@query
def cube_month_airline(spark, sf_dir):
    chosen = levels.cube_levels(["month", "airline"])
    return _delay_levels(spark, sf_dir, ["month"], ["airline"], chosen).select("month", "airline", "total_flights")


@query
def nested_cube(spark, sf_dir):
    chosen = levels.cube_levels(["airline", ("year", "month"), "day_of_week"])
    return _delay_levels(spark, sf_dir, list(levels.TIME_DIMENSIONS), ["airline"], chosen)


def _in_shared_folder(df):
    path = files.shared_folder(df.sparkSession, "levels")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SIX_DIMENSIONS = ("year", "airline", "origin_airport", "tail_number", "cancelled", "cancellation_reason")


@query
def powerset_63(spark, sf_dir):
    """All 63 combinations of six dimensions, one of them with many values."""
    dated = enrich.with_date_parts(proxy.wide_flights(spark, sf_dir), "year")
    chosen = levels.cube_levels(SIX_DIMENSIONS, grand_total=False)
    found = levels.aggregate_lattice(dated, chosen, _in_shared_folder, SIX_DIMENSIONS[:1], SIX_DIMENSIONS[1:])
    return found.select(*SIX_DIMENSIONS, *DELAYS, "time_agg_level", "agg_level")


@query
def rollup_tail_number(spark, sf_dir):
    dated = enrich.with_date_parts(proxy.wide_flights(spark, sf_dir), "year", "month")
    chosen = levels.rollup_levels(["airline", "tail_number", ("year", "month")])
    found = levels.aggregate_levels(dated, chosen, ["year", "month"], ["airline", "tail_number"])
    return found.select("year", "month", "airline", "tail_number", *DELAYS, "time_agg_level", "agg_level")


@query
def powerset_sets(spark, sf_dir):
    dimensions = ["year", "airline", "origin_airport", "cancelled", "cancellation_reason"]
    chosen = levels.cube_levels(dimensions, grand_total=False)
    return _delay_levels(spark, sf_dir, dimensions[:1], dimensions[1:], chosen)


# --- reports ---------------------------------------------------------------------------------------


def _report(name: str, title: str, means: tuple[str, ...] = (), extended: bool = False, **parameters) -> None:
    """Register a report over an aggregate of just the levels it reads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gold = _gold(spark, sf_dir, reports.LEVELS[name], extended)
        return rounded(getattr(reports, name)(gold, **parameters), *means)

    run.__name__ = title
    query(run)


SHARES = tuple(f"percent_cancellations_{r}" for r in "ABCD")
HEADLINE_RATES = ("delayed_rate", "avg_delay_time", "cancelled_rate")
_report("airlines", "q01_airlines")
_report("headline", "q02_headline", HEADLINE_RATES)
_report("headline", "q02_headline_one_airline_year", HEADLINE_RATES, airline=AIRLINE, year=1997)
_report("headline", "q02_headline_weighted", weighted=True)
_report("monthly_volume_long", "q03_monthly_volume_long")
_report("monthly_volume_long", "q03_monthly_volume_long_one_airline", airline=AIRLINE)
_report("weekday_volume_long", "q04_weekday_volume_long")
_report("weekday_volume_long", "q04_weekday_volume_long_one_airline", airline=AIRLINE)
_report("monthly_volume", "q05_monthly_volume")
_report("monthly_volume", "q05_monthly_volume_one_airline", airline=AIRLINE)
_report("weekday_volume", "q06_weekday_volume")
_report("weekday_volume", "q06_weekday_volume_one_airline", airline=AIRLINE)
_report("monthly_delays", "q07_monthly_delays", ("delayed_rate", "avg_delay_time"))
_report("monthly_delays", "q07_monthly_delays_one_airline", ("delayed_rate", "avg_delay_time"), airline=AIRLINE)
_report("monthly_delays_by_origin", "q08_delay_by_origin")
_report("monthly_delays_by_origin", "q08_delay_by_one_origin", origin=ORIGIN)
_report("airline_reliability", "q09_airline_reliability")
_report("monthly_cancellation_rates", "q10_monthly_cancellation_rates", ("cancelled_rate", *SHARES))
_report(
    "monthly_cancellation_rates", "q10_monthly_cancellation_rates_one_airline", ("cancelled_rate", *SHARES),
    airline=AIRLINE,
)
_report("monthly_cancellations", "q11_monthly_cancellations")
_report("monthly_cancellations", "q11_monthly_cancellations_one_airline", airline=AIRLINE)
_report("yearly_cancellations", "q12_yearly_cancellations")
_report("yearly_cancellations", "q12_yearly_cancellations_one_airline", airline=AIRLINE)
_report("cancellation_shares", "q13_cancellation_shares")
_report("overall_totals", "q15_totals")
_report("overall_monthly_volume", "q15_monthly_volume")
_report("overall_weekday_volume", "q15_weekday_volume")
_report("overall_delays", "q15_delays")
_report("overall_monthly_delays", "q15_monthly_delays")
_report("overall_cancellations", "q15_cancellations")
_report("on_time_rates", "q16_on_time_rates", extended=True)
_report("most_reliable", "most_reliable_topk", k=3)
_report("least_reliable", "least_reliable_topk", k=3)


def _over_all_levels(name: str, title: str, means: tuple[str, ...] = ()) -> None:
    """The same report over the aggregate of all twelve levels, where its filter on labels has to find the right one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(getattr(reports, name)(_gold(spark, sf_dir)), *means)

    run.__name__ = title
    query(run)


_over_all_levels("headline", "all_levels_headline", HEADLINE_RATES)
_over_all_levels("monthly_volume_long", "all_levels_monthly_volume_long")
_over_all_levels("weekday_volume", "all_levels_weekday_volume")
_over_all_levels("monthly_delays_by_origin", "all_levels_delay_by_origin")
_over_all_levels("yearly_cancellations", "all_levels_yearly_cancellations")
_over_all_levels("overall_totals", "all_levels_totals")


@query
def q14_full_listing(spark, sf_dir):
    """The aggregate table as reports read it: exported as parquet and read back."""
    path = files.shared_folder(spark, "gold")
    _gold(spark, sf_dir).write.parquet(path)
    return files.read_gold(spark, path)


# --- reports as SQL text over the aggregate table ---------------------------------------------------


@query
def sql_nested_cube(spark, sf_dir):
    dated = enrich.with_date_parts(proxy.flights(spark, sf_dir, destination=False), *levels.TIME_DIMENSIONS)
    return spark.sql(
        """SELECT airline, year, month, day_of_week, count(*) AS total_flights,
                  count_if(is_delayed = 1) AS delayed_flights,
                  try_divide(delayed_flights, total_flights) AS delayed_rate, avg(departure_delay) AS avg_delay_time
           FROM {flights} GROUP BY GROUPING SETS (CUBE (airline, (year, month), day_of_week))""",
        flights=dated,
    )


@query
def sql_volume_group_by_all(spark, sf_dir):
    return spark.sql(
        """SELECT year, month, sum(total_flights) AS total_flights, sum(delayed_flights) AS delayed_flights,
                  sum(cancelled_flights) AS cancelled_flights
           FROM {gold} WHERE time_agg_level = 'year_month' AND agg_level = 'airline' AND airline LIKE :airline
           GROUP BY ALL ORDER BY year, month""",
        {"airline": "%"},
        gold=_gold(spark, sf_dir, (reports.BY_AIRLINE_MONTH,)),
    )


def _stacked(names: dict[str, str]) -> str:
    """``stack`` over the sums of the reasons: one row per reason, under its name."""
    pairs = ", ".join(f"'{names[column]}', sum(cancellations_{code})" for code, column in reports.REASON_COLUMNS.items())
    return f"stack({len(names)}, {pairs})"


@query
def sql_unpivot_reasons(spark, sf_dir):
    names = {column: column for column in reports.REASON_COLUMNS.values()}
    return spark.sql(
        f"SELECT year, month, {_stacked(names)} AS (reason, volume) FROM {{gold}}"
        " WHERE time_agg_level = 'year_month' AND agg_level = 'airline' GROUP BY year, month",
        gold=_gold(spark, sf_dir, (reports.BY_AIRLINE_MONTH,)),
    )


@query
def sql_union_reasons(spark, sf_dir):
    return spark.sql(
        f"SELECT {_stacked(reports.REASON_LABELS)} AS (name, count) FROM {{gold}}"
        " WHERE time_agg_level = 'year' AND agg_level = 'airline' GROUP BY year",
        gold=_gold(spark, sf_dir, (reports.BY_AIRLINE_YEAR,)),
    )


@query
def gold_other_levels(spark, sf_dir):
    """Rows outside the given levels."""
    return _gold(spark, sf_dir).where(~F.col("agg_level").isin("all", "airline"))


# --- anti joins and merges -------------------------------------------------------------------------


@query
def anti_null_safe(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir)
    return existing.without_existing(flights, flights.where(FIRST_LOAD))


@query
def anti_plain(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir).drop("cancellation_reason")
    return existing.without_existing(flights, flights.where(FIRST_LOAD), null_safe=False)


@query
def merge_insert_only_flights(spark, sf_dir):
    flights = dedup.first_per_key(proxy.flights(spark, sf_dir), FLIGHT_KEY)
    return existing.merge_insert_only(flights.where(FIRST_LOAD), flights, FLIGHT_KEY, null_safe=False)


def _bucketed(spark, sf_dir):
    """The first load in a new table bucketed by the flight key, and all flights."""
    flights = _unique_flights_once(spark, sf_dir)
    table = _new_table(spark, "bucketed_flights")
    buckets.create(flights, table, FLIGHT_KEY, buckets=buckets.fitting(flights, at_least=8))
    buckets.insert_new(flights.where(FIRST_LOAD), table)
    return table, flights


@query
def merge_bucketed(spark, sf_dir):
    """A second load with changed values into a bucketed table: known keys stay as they are."""
    table, flights = _bucketed(spark, sf_dir)
    buckets.insert_new(flights.withColumn("departure_delay", F.col("departure_delay") + 1), table)
    return buckets.read(spark, table).select(*proxy.COLUMNS)


@query
def replace_bucketed(spark, sf_dir):
    """Flights of two years take the place of stored ones, in their months alone."""
    table, flights = _bucketed(spark, sf_dir)
    later = flights.where("year(date) = 1998 AND month(date) > 6 OR year(date) = 1996 AND cancelled = 0")
    buckets.replace(later.withColumn("departure_delay", F.col("departure_delay") + 30), table)
    return buckets.read(spark, table).select(*proxy.COLUMNS)


def _two_golds(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    return levels.gold(flights.where(FIRST_LOAD)), levels.gold(flights)


@query
def merge_insert_only(spark, sf_dir):
    stored, batch = _two_golds(spark, sf_dir)
    return existing.merge_insert_only(stored, batch, GOLD_KEY)


@query
def merge_plain_keys(spark, sf_dir):
    """NULL keys never match with plain equality, so rolled-up rows are inserted beside the stored ones."""
    stored, batch = _two_golds(spark, sf_dir)
    return existing.merge_insert_only(stored, batch, GOLD_KEY[:-2], null_safe=False)


@query
def merge_replace(spark, sf_dir):
    stored, batch = _two_golds(spark, sf_dir)
    return existing.merge_replace(stored, batch, GOLD_KEY)


@query
def changed_existing(spark, sf_dir):
    stored, batch = _two_golds(spark, sf_dir)
    return existing.changed_existing(batch, stored, GOLD_KEY)


@query
def delete_by_predicate(spark, sf_dir):
    return tables.without_matching(proxy.flights(spark, sf_dir), F.col("departure_delay") > 20)


def _new_table(spark, name):
    """Name of a table in a new database of the session's warehouse."""
    database = f"flights_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    return tables.full_name(database, name)


@query
def wap_two_loads(spark, sf_dir):
    """Two loads through write-audit-publish, the second one repeating the first one's rows."""
    table = _new_table(spark, "fact_flights")
    flights = _unique_flights_once(spark, sf_dir)
    config = {"fact_flights": FLIGHT_RULES}
    for batch in (flights.where(FIRST_LOAD), flights):
        publish.write_audit_publish(batch, table, rules=config)
    return tables.read_table(spark, table)


@query
def wap_rejects_cross_month_duplicate(spark, sf_dir):
    """A load whose key repeats in another month is rejected, and the table stays as it was."""
    table = _new_table(spark, "fact_flights")
    config = {"fact_flights": {"uniqueness": ["airline", "origin_airport", "scheduled_departure"]}}
    key = config["fact_flights"]["uniqueness"]
    flights = dedup.first_per_key(proxy.flights(spark, sf_dir), key)
    publish.write_audit_publish(flights, table, FLIGHT_KEY, rules=config)
    moved = flights.where("airline = '5-LOW'").withColumn("date", F.add_months("date", 14))
    try:
        publish.write_audit_publish(moved, table, FLIGHT_KEY, rules=config)
    except publish.AuditFailed:
        pass
    return tables.read_table(spark, table).select(*FLIGHT_KEY, "origin_airport")


@query
def gold_after_delete(spark, sf_dir):
    """Load, publish the aggregate, delete facts, publish again: groups that are gone leave the aggregate."""
    fact, summary = _new_table(spark, "fact_flights"), _new_table(spark, "agg_fact_flights")
    flights = dedup.first_per_key(proxy.flights(spark, sf_dir), FLIGHT_KEY)
    publish.write_audit_publish(flights, fact, rules={"fact_flights": FLIGHT_RULES})
    publish.write_audit_publish(levels.gold(tables.read_table(spark, fact)), summary, mode="sync")
    tables.delete_where(spark, fact, "airline = '5-LOW' OR year(date) = 1997")
    publish.write_audit_publish(levels.gold(tables.read_table(spark, fact)), summary, mode="sync")
    return tables.read_table(spark, summary)


@query
def gold_from_cells(spark, sf_dir):
    """The aggregate from stored cells, after an insert, a replacement and a delete, each of which refreshes its own months."""
    fact = _new_table(spark, "fact_flights")
    store = states.cell_store(spark, fact, tables.sibling(fact, "cells"))
    config = {"fact_flights": FLIGHT_RULES}
    flights = _unique_flights_once(spark, sf_dir)
    later = flights.where("airline = '2-HIGH' AND year(date) = 1996 AND cancelled = 0").withColumn("departure_delay", F.col("departure_delay") + 30)
    later = later.withColumn("is_delayed", delay_flag())
    for batch, mode in ((flights.where(FIRST_LOAD), "insert_only"), (flights, "insert_only"), (later, "replace")):
        publish.write_audit_publish(batch, fact, mode=mode, rules=config, before_write=store.note)
        store.refresh()
    tables.delete_where(spark, fact, "airline = '5-LOW' OR year(date) = 1997", before_write=store.note)
    store.refresh()
    return levels.gold_from_cells(store.read().drop(MONTH_COLUMN))


@query
def delete_from_table(spark, sf_dir):
    """A table delete; rows for which the predicate is NULL stay."""
    table = _new_table(spark, "fact_flights")
    tables.write_new(dedup.first_per_key(proxy.flights(spark, sf_dir), FLIGHT_KEY), table)
    tables.delete_where(spark, table, "departure_delay > 20")
    return tables.read_table(spark, table).select(*proxy.COLUMNS)


@query
def wap_switch(spark, sf_dir):
    """Two loads and a replacement, published by pointing the catalog to new files of the touched months."""
    table = _new_table(spark, "fact_flights")
    flights = _unique_flights_once(spark, sf_dir)
    config = {"fact_flights": FLIGHT_RULES}
    later = flights.where("year(date) = 1996 AND cancelled = 0").withColumn("departure_delay", F.col("departure_delay") + 30)
    later = later.withColumn("is_delayed", delay_flag())
    for batch, mode in ((flights.where(FIRST_LOAD), "insert_only"), (flights, "insert_only"), (later, "replace")):
        publish.write_audit_publish(batch, table, mode=mode, rules=config, switch=True)
    return tables.read_table(spark, table).select(*proxy.COLUMNS)


@query
def append_twice(spark, sf_dir):
    """An idempotent append by key, repeated: the second one writes nothing."""
    table = _new_table(spark, "customers")
    customers = proxy.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    first = tables.write_new(customers.where("c_custkey % 3 > 0"), table, keys=["c_custkey"])
    second = tables.write_new(customers, table, keys=["c_custkey"])
    third = tables.write_new(customers, table, keys=["c_custkey"])
    written = [F.lit(x).alias(n) for x, n in ((first, "first"), (second, "second"), (third, "third"))]
    return tables.read_table(spark, table).select("c_custkey", "c_name", "c_mktsegment", *written)


@query
def new_rows_flag(spark, sf_dir):
    """Rows that a table lacks, and whether there are any, for a batch with new rows and one without."""
    table = _new_table(spark, "parts")
    parts = proxy.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    tables.write_new(parts.where("p_size <= 40"), table)
    fresh, some = tables.new_rows(parts, table)
    _, again = tables.new_rows(parts.where("p_size <= 40"), table)
    return fresh.select("p_partkey", "p_size", F.lit(some).alias("has_new"), F.lit(again).alias("again_has_new"))


# --- exploration -------------------------------------------------------------------------------------


@query
def null_profile(spark, sf_dir):
    return explore.null_counts(proxy.flights(spark, sf_dir))


@query
def null_by_cancelled(spark, sf_dir):
    return explore.nulls_by_condition(proxy.flights(spark, sf_dir), "cancelled = 1")


@query
def key_counts_sorted(spark, sf_dir):
    keys = ["date", "airline", "flight_number"]
    return dedup.key_counts(proxy.flights(spark, sf_dir, destination=False), keys).orderBy(*keys)


@query
def airline_delay_counts(spark, sf_dir):
    return explore.delay_by(proxy.flights(spark, sf_dir, destination=False), "airline")


@query
def late_departures_by_airline(spark, sf_dir):
    return explore.late_departures_by(proxy.flights(spark, sf_dir, destination=False), "airline")


@query
def flight_counts(spark, sf_dir):
    return explore.flight_counts(proxy.flights(spark, sf_dir, destination=False))


@query
def date_bounds(spark, sf_dir):
    return explore.date_bounds(proxy.flights(spark, sf_dir, destination=False))


@query
def flights_in_month(spark, sf_dir):
    return explore.in_month(proxy.flights(spark, sf_dir), 1996, 3)


@query
def cancelled_urgent_1996(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir)
    return flights.where("airline = '1-URGENT' AND date BETWEEN '1996-01-01' AND '1996-12-31' AND cancelled = 1")


@query
def partition_stats(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    return explore.partition_stats(flights, "departure_delay", month_key("date"))


@query
def file_stats(spark, sf_dir):
    """Files and rows behind a table."""
    found = explore.file_stats(proxy.table(spark, sf_dir, "lineitem"))
    return found.agg(F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("row_count"))


@query
def csv_round_trip(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir)
    path = files.shared_folder(spark, "csv")
    files.write_csv(flights, path)
    return files.read_csv(spark, path, flights.schema)


@query
def csv_rejects(spark, sf_dir):
    """Records of a CSV file that do not read as declared, with their reasons; every fault is planted by a line's own values."""
    lines = proxy.table(spark, sf_dir, "lineitem")
    bad_number = (F.col("l_partkey") % 11) == 0
    bad_date = (F.col("l_suppkey") % 7) == 0
    cells = [
        F.col("l_orderkey").cast("string"),
        F.when(bad_number, F.concat(F.lit("x"), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.when(bad_date, F.lit("yesterday")).otherwise(F.col("l_shipdate").cast("date").cast("string")),
    ]
    short = F.concat_ws(",", *cells[:2])
    text = F.when(F.col("l_linenumber") == 7, short).otherwise(F.concat_ws(",", *cells))
    path = files.shared_folder(spark, "faulty")
    header = "order_key,quantity,ship_date"
    lines.select(text.alias(header)).write.option("quote", "").option("header", True).csv(path)
    good, rejected = files.read_csv_checked(spark, path, "order_key BIGINT, quantity INT, ship_date DATE")
    counted = rejected.select(F.split("record", ",")[0].cast("long").alias("order_key"), F.array_join("reasons", "; ").alias("reasons"))
    return counted.unionByName(good.groupBy("order_key").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" read")).alias("reasons")))


@query
def sample_keys(spark, sf_dir):
    return explore.key_sample(proxy.flights(spark, sf_dir), FLIGHT_KEY, 10)


@query
def sample_rows(spark, sf_dir):
    return explore.random_sample(proxy.flights(spark, sf_dir), 0.1, seed=7)


@query
def sample_per_airline(spark, sf_dir):
    """A hundred flights of each airline, by the hash of their key."""
    return explore.sample_per_group(proxy.flights(spark, sf_dir), ["airline"], 100, FLIGHT_KEY, seed=7)


# --- data quality ------------------------------------------------------------------------------------

# The configured flight rules on the columns there are counterparts for, with the airlines of these tables.
FLIGHT_RULES = {
    "uniqueness": list(FLIGHT_KEY),
    "completeness": [
        "date", "airline", "flight_number", "origin_airport", "destination_airport", "scheduled_departure",
        "cancelled", "is_delayed",
    ],
    "non_negative": ["flight_number", "scheduled_departure"],
    "containment": {
        "airline": [code for code, _ in proxy.CARRIER_NAMES],
        "cancelled": rules.FLAG,
        "cancellation_reason": ["A", "B", "C", "D", ""],
        "is_delayed": rules.FLAG,
    },
}
# Checks that these tables do not pass in full.
FLIGHT_PROBES = constraints.Check(
    "probes",
    (
        constraints.completeness("departure_delay", constraints.at_least(0.9)),
        constraints.completeness("cancellation_reason"),
        constraints.non_negative("departure_delay"),
        constraints.contained_in("cancellation_reason", ["A", "B"], constraints.at_least(0.98)),
        constraints.contained_in("airline", rules.CARRIERS),
        constraints.in_range("departure_delay", -20, 20),
        constraints.matches("airline", "[0-9]-[A-Z]+"),
        constraints.satisfies(["departure_delay", "is_delayed"], "(departure_delay > 0) = (is_delayed = 1)"),
        constraints.uniqueness(["date", "airline", "flight_number"], constraints.at_least(0.5)),
    ),
    "Warning",
)
METRIC_COLUMNS = ("check", "check_level", "rule", "columns", "metric", "passed")


def _metrics(df: DataFrame, *checks: constraints.Check) -> DataFrame:
    return rounded(constraints.constraint_metrics(df, checks).select(*METRIC_COLUMNS), "metric")


@query
def dq_results(spark, sf_dir):
    check = rules.table_check("fact_flights", {"fact_flights": FLIGHT_RULES})
    return _metrics(proxy.flights(spark, sf_dir), check, FLIGHT_PROBES)


# Constraints that see the whole table: shares, a condition over aggregates, and keys without the date, one within the other.
WHOLE_TABLE = constraints.Check(
    "whole table",
    (
        constraints.holds_overall(["cancelled", "cancellation_reason"], "count(*) = count_if(cancelled = 1) + count_if(cancellation_reason IS NULL)"),
        constraints.holds_overall(["departure_delay"], "sum(departure_delay) < 2 * count(departure_delay)"),
        constraints.uniqueness(["airline", "flight_number", "origin_airport"], constraints.at_least(0.4)),
        constraints.uniqueness(["airline", "flight_number"], constraints.at_least(0.4)),
    ),
)


@query
def dq_incremental(spark, sf_dir):
    """Metrics from state per month, after two loads and a delete; each refreshes the months it touched."""
    fact = _new_table(spark, "fact_flights")
    check = rules.table_check("fact_flights", {"fact_flights": FLIGHT_RULES})
    state = metrics.MetricStates(spark, fact, tables.sibling(fact, "metrics"), [check, FLIGHT_PROBES, WHOLE_TABLE])
    flights = _flights_once(spark, sf_dir)
    for batch in (flights.where(FIRST_LOAD), flights.where(f"NOT ({FIRST_LOAD})")):
        if not spark.catalog.tableExists(fact):
            tables.create_for(batch, fact, True)
        state.note(tables.months_of(batch.select(month_key("date").alias(MONTH_COLUMN))))
        tables.append(batch, fact)
        state.refresh()
    tables.delete_where(spark, fact, "airline = '5-LOW' OR year(date) = 1997", before_write=state.note)
    state.refresh()
    return rounded(state.metrics().select(*METRIC_COLUMNS), "metric")


@query
def dq_gold_results(spark, sf_dir):
    check = rules.table_check("agg_fact_flights")
    return _metrics(_gold(spark, sf_dir), check)


@query
def dq_spec_results(spark, sf_dir):
    flights = proxy.wide_flights(spark, sf_dir)
    flight_check = rules.table_check("fact_flights", rules.DESIGN_RULES)
    gold_check = rules.table_check("agg_fact_flights", rules.DESIGN_RULES)
    dates_check = rules.table_check("dim_dates", rules.DESIGN_RULES)
    gold = _metrics(levels.gold(flights), gold_check)
    dates = _metrics(dim_dates(spark, sf_dir), dates_check)
    return _metrics(flights, flight_check).unionByName(gold).unionByName(dates)


@query
def dq_violations(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    probes = {
        "reason_without_cancellation": explore.ANOMALIES["reason_without_cancellation"],
        "cancelled_after_pushback": explore.ANOMALIES["cancelled_after_pushback"],
        "delay_unknown": "departure_delay IS NULL",
    }
    return explore.anomaly_counts(flights, probes)


# Rules at the edges of types, over columns of the given tables.
EDGE_CHECK = constraints.Check(
    "edges",
    (
        constraints.non_negative("overflow"),
        constraints.non_negative("infinite"),
        constraints.non_negative("number_text"),
        constraints.non_negative("word"),
        constraints.contained_in("fractional_flag", ["0", "1"]),
        constraints.matches("code", "[A-Z]"),
    ),
)


@query
def dq_edge_values(spark, sf_dir):
    lines = proxy.table(spark, sf_dir, "lineitem").select(
        ((F.col("l_quantity") - 25) * 1e30).alias("overflow"),
        F.when(F.col("l_quantity") < 5, F.lit(float("-inf"))).otherwise(F.col("l_quantity")).alias("infinite"),
        F.concat((F.col("l_quantity") - 25).cast("int").cast("string"), F.lit("e40")).alias("number_text"),
        F.col("l_returnflag").alias("word"),
        (F.col("l_linenumber") % 3).cast("double").alias("fractional_flag"),
        F.concat("l_returnflag", F.when(F.col("l_linenumber") == 1, "\n").otherwise("")).alias("code"),
    )
    return _metrics(lines, EDGE_CHECK)


@query
def dq_dim_results(spark, sf_dir):
    """Design checks of the dimensions, over tables of keys that grow: suppliers as places, customers as carriers, parts as reasons."""
    supplier = proxy.table(spark, sf_dir, "supplier")
    letters = F.upper(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 3))
    places = supplier.select(
        letters.alias("iata_code"),
        F.col("s_name").alias("airport"),
        F.when(F.col("s_nationkey") > 2, F.col("s_name")).alias("city"),
        F.lit("XX").alias("state"),
        F.lit("US").alias("country"),
        (F.col("s_nationkey") * 8 - 100).cast("float").alias("latitude"),
        (F.col("s_nationkey") * 15 - 100).cast("float").alias("longitude"),
    )
    carriers = proxy.table(spark, sf_dir, "customer").select(
        F.substring("c_mktsegment", 1, 2).alias("iata_code"), F.when(F.col("c_custkey") % 10 > 0, F.col("c_name")).alias("airline")
    )
    reasons = proxy.table(spark, sf_dir, "part").select(
        F.substring(F.lit("ABCDE"), F.col("p_size") % 5 + 1, F.lit(1)).alias("cancellation_reason"), F.col("p_name").alias("cancellation_description")
    )
    parts = [(places, "dim_airports"), (carriers, "dim_airlines"), (reasons, "dim_cancellation_codes")]
    found = [_metrics(df, rules.table_check(name, rules.DESIGN_RULES)) for df, name in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def dq_fact_rules(spark, sf_dir):
    """The configured and the design rules of the fact table, all of them, on all 29 columns."""
    flights = proxy.wide_flights(spark, sf_dir)
    return _metrics(flights, rules.table_check("fact_flights"), rules.table_check("fact_flights", rules.DESIGN_RULES))


@query
def anomalies(spark, sf_dir):
    return explore.anomaly_counts(proxy.wide_flights(spark, sf_dir))


@query
def diverted_counts(spark, sf_dir):
    return explore.flight_counts(proxy.wide_flights(spark, sf_dir))


@query
def profile_exact(spark, sf_dir):
    found = profile.profile(proxy.flights(spark, sf_dir), approximate=False)
    return rounded(found, "completeness", "mean", "std_dev")


@query
def profile_approx(spark, sf_dir):
    return profile.profile(proxy.flights(spark, sf_dir))


@query
def profile_histograms(spark, sf_dir):
    flights = proxy.flights(spark, sf_dir, destination=False)
    return profile.histogram(flights, ["airline", "origin_airport", "cancellation_reason", "cancelled"])


CHOSEN_PERCENTILES = (0.1, 0.5, 0.9, 0.99)
SKETCHED = ("flight_number", "departure_delay", "scheduled_departure", "airline", "cancellation_reason")


@query
def profile_sketched(spark, sf_dir):
    """A profile merged from sketches per month, of two loads: exact where it is exact, and whether the rest is within the sketches' errors."""
    fact = _new_table(spark, "fact_flights")
    make = lambda rows: sketches.column_sketches(rows, SKETCHED, [MONTH_COLUMN])
    store = states.MonthlyState(spark, fact, tables.sibling(fact, "sketches"), make)
    flights = _flights_once(spark, sf_dir)
    tables.create_for(flights, fact, True)
    for batch in (flights.where(FIRST_LOAD), flights.where(f"NOT ({FIRST_LOAD})")):
        store.note(tables.months_of(batch.select(month_key("date").alias(MONTH_COLUMN))))
        tables.append(batch, fact)
        store.refresh()
    found = {r["column_name"]: r for r in sketches.merged_profile(store.read(), CHOSEN_PERCENTILES).collect()}
    rows = []
    for name in SKETCHED:
        value, r = F.col(name), found[name]
        ranks = [
            F.struct(F.count_if(value < v).alias("below"), F.count_if(value <= v).alias("upto")) for v in r["percentiles"] or []
        ]
        n, error = F.count(value), 3 * sketches.rank_error()
        close = [
            (x["below"] <= (p + error) * n) & (x["upto"] >= (p - error) * n) for p, x in zip(CHOSEN_PERCENTILES, ranks)
        ]
        off = F.abs(F.count_distinct(value) - F.lit(r["approx_distinct"])) / F.count_distinct(value)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                *[F.lit(r[c]).cast("double" if c[0] == "m" else "long").alias(c) for c in ("row_count", "minimum", "maximum")],
                F.round(F.lit(r["completeness"]), DIGITS).alias("completeness"),
                (reduce(and_, close) if close else F.lit(True)).alias("percentiles_close"),
                (off <= 3 * sketches.distinct_error()).alias("distinct_close"),
            )
        )
    return flights.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query
def profile_full(spark, sf_dir):
    """Histograms as part of the profile; one text reads "NullValue" and is not NULL."""
    flights = proxy.flights(spark, sf_dir, destination=False).withColumn(
        "cancellation_reason", F.when(F.col("cancellation_reason") == "D", "NullValue").otherwise(F.col("cancellation_reason"))
    )
    found = profile.profile_with_histograms(flights, ["airline", "cancellation_reason", "cancelled", "flight_number"], (0.5, 0.95))
    entries = found.select("column_name", "data_type", F.size("percentiles").alias("n_percentiles"), F.explode_outer("histogram").alias("entry"))
    shown = entries.select("column_name", "data_type", "n_percentiles", "entry.*").where("column_name <> 'flight_number' OR value IS NULL")
    return rounded(shown, "fraction")


def _held_out():
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in FLIGHT_KEY])
    return F.md5(key) < "5"


@query
def suggestions_evaluated(spark, sf_dir):
    """Constraints suggested from some rows, held against the others."""
    found = suggest.evaluated(_flights_once(spark, sf_dir), _held_out())
    return rounded(found.select("column_name", "rule", "share"), "share")


@query
def suggestions(spark, sf_dir):
    return suggest.suggestions_table(_flights_once(spark, sf_dir))
