"""Flight relations over an order-management schema.

No flight data comes with the test tables, so orders stand in for it: a line item is a
flight, its order's date the flight date, the supplier's nation the origin. Returned lines with
a high discount are cancellations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import delay_flag
from skyledger.operators.silver import to_silver
from skyledger.schemas import AIRLINES, CANCELLATION_CODES
from skyledger.sources.files import literal_table

# Made-up names for the five order priorities, and the meaning of the reason codes.
CARRIER_NAMES = [
    ("1-URGENT", "Urgent Airways"),
    ("2-HIGH", "High Airlines"),
    ("3-MEDIUM", "Medium Air"),
    ("4-NOT SPECIFIED", "Unspecified Air Lines"),
    ("5-LOW", "Low Cost Air"),
]
REASONS = [
    ("A", "Airline/Carrier"),
    ("B", "Weather"),
    ("C", "National Air System"),
    ("D", "Security"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_cancelled() -> Column:
    return (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)


def raw_flights(spark: SparkSession, sf_dir: str, destination: bool = True) -> DataFrame:
    """One row per line item in the raw column layout, as far as there are counterparts.

    Customers are joined to orders, of which there are fewer than lines. A side is broadcast
    when its size allows, none is forced; nations come last, so that the size Spark compares
    is that of the supplier or customer file. An order without a customer has no destination; so without
    ``destination`` that join, needed for this column only, is left out and the rows are the same.
    """
    nation = table(spark, sf_dir, "nation")
    origins = nation.select(F.col("n_nationkey").alias("_origin_key"), F.col("n_name").alias("origin_airport"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("_origin_key"))
    orders = table(spark, sf_dir, "orders")
    if destination:
        destinations = nation.select("n_nationkey", F.col("n_name").alias("destination_airport"))
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(
            destinations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(origins, "_origin_key")
    )
    cancelled, date = _is_cancelled(), F.col("o_orderdate")
    return lines.select(
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        (F.weekday(date) + 1).alias("day_of_week"),
        F.col("o_orderpriority").alias("airline"),
        F.col("l_partkey").cast("int").alias("flight_number"),
        "origin_airport",
        *(["destination_airport"] if destination else []),
        F.col("l_linenumber").alias("scheduled_departure"),
        F.when(~cancelled, F.col("l_quantity").cast("int") - 25).alias("departure_delay"),
        cancelled.cast("int").alias("cancelled"),
        F.when(cancelled, F.substring(F.lit("ABCD"), F.col("l_linenumber") % 4 + 1, F.lit(1))).alias(
            "cancellation_reason"
        ),
    )


def flights(spark: SparkSession, sf_dir: str, destination: bool = True) -> DataFrame:
    """Silver flights."""
    return to_silver(raw_flights(spark, sf_dir, destination))


def airlines(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CARRIER_NAMES, AIRLINES)


def cancellation_codes(spark: SparkSession) -> DataFrame:
    return literal_table(spark, REASONS, CANCELLATION_CODES)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as airports, their region as state."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        F.col("n_name").alias("iata_code"),
        F.concat("n_name", F.lit(" Airport")).alias("airport"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
    )


# Names of the silver columns that the order tables have counterparts for.
COLUMNS = (
    "date", "airline", "flight_number", "origin_airport", "destination_airport", "scheduled_departure",
    "departure_delay", "cancelled", "cancellation_reason", "is_delayed",
)


def wide_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 29 columns of the fact table, from columns of lines and orders; some rows break each kind of rule."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("origin_airport"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    cancelled = _is_cancelled()
    diverted = ~cancelled & (F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.08)
    arrived = ~cancelled & ~diverted
    number = lambda column: F.col(column).cast("int")
    delay = number("l_quantity") - 25
    late = ~cancelled & (delay > 0)
    base = rows.select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("airline"),
        number("l_partkey").alias("flight_number"),
        F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("tail_number"),
        "origin_airport",
        F.when(F.col("l_linenumber") < 7, F.col("o_orderstatus")).alias("destination_airport"),
        number("l_linenumber").alias("scheduled_departure"),
        F.when(~cancelled, number("l_linenumber") + 1).alias("departure_time"),
        F.when(~cancelled | (F.col("l_linenumber") == 1), delay).alias("departure_delay"),
        F.round(F.col("l_tax") * 100).cast("int").alias("taxi_out"),
        F.when(~cancelled, number("l_linenumber") + 2).alias("wheels_off"),
        F.when(F.col("l_tax") > 0, number("l_quantity") * 7).alias("scheduled_time"),
        F.when(arrived, number("l_quantity") * 7 + 3).alias("elapsed_time"),
        F.when(arrived, number("l_quantity") * 6).alias("air_time"),
        (number("l_extendedprice") - 1000).alias("distance"),
        F.when(arrived, number("l_linenumber") + 3).alias("wheels_on"),
        F.round(F.col("l_discount") * 100).cast("int").alias("taxi_in"),
        (number("l_linenumber") + 4).alias("scheduled_arrival"),
        F.when(arrived, number("l_linenumber") + 5).alias("arrival_time"),
        F.when(arrived | (F.col("l_linenumber") == 2), delay + 1).alias("arrival_delay"),
        diverted.cast("int").alias("diverted"),
        cancelled.cast("int").alias("cancelled"),
        F.when(
            cancelled | (F.col("l_linenumber") == 7), F.substring(F.lit("ABCD"), F.col("l_linenumber") % 4 + 1, F.lit(1))
        ).alias("cancellation_reason"),
        F.when(late, F.floor(delay / 5).cast("int")).alias("air_system_delay"),
        F.when(late, F.lit(0)).alias("security_delay"),
        F.when(late, F.floor(delay / 3).cast("int")).alias("airline_delay"),
        F.when(late, delay - F.floor(delay / 5).cast("int") - F.floor(delay / 3).cast("int")).alias("late_aircraft_delay"),
        F.when(late, (F.col("l_tax") == 0.02).cast("int")).alias("weather_delay"),
    )
    return base.withColumn("is_delayed", delay_flag())
