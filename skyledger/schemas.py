"""Relations of the flight model, as DDL strings.

Spark's readers, ``StructType.fromDDL`` and ``CREATE TABLE`` all take the same
text, so each schema is written once and used everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

# File names, column names, types and their order are the data contract.
RAW_FLIGHTS = """
    year INT, month INT, day INT, day_of_week INT, airline STRING, flight_number INT, tail_number STRING,
    origin_airport STRING, destination_airport STRING, scheduled_departure INT, departure_time INT,
    departure_delay INT, taxi_out INT, wheels_off INT, scheduled_time INT, elapsed_time INT, air_time INT,
    distance INT, wheels_on INT, taxi_in INT, scheduled_arrival INT, arrival_time INT, arrival_delay INT,
    diverted INT, cancelled INT, cancellation_reason STRING, air_system_delay INT, security_delay INT,
    airline_delay INT, late_aircraft_delay INT, weather_delay INT
"""
AIRLINES = "iata_code STRING, airline STRING"
AIRPORTS = (
    "iata_code STRING, airport STRING, city STRING, state STRING, country STRING, latitude FLOAT, longitude FLOAT"
)
CANCELLATION_CODES = "cancellation_reason STRING, cancellation_description STRING"
CALENDAR = (
    "date DATE, year INT, month INT, day INT, day_of_week INT, quarter INT, holiday_name STRING, is_holiday BOOLEAN"
)
GOLD = """
    year INT, month INT, day_of_week INT, airline STRING, origin_airport STRING, total_flights BIGINT,
    delayed_flights BIGINT, delayed_rate DOUBLE, avg_delay_time DOUBLE, cancelled_flights BIGINT,
    cancelled_rate DOUBLE, cancellations_A BIGINT, cancellations_B BIGINT, cancellations_C BIGINT,
    cancellations_D BIGINT, percent_cancellations_A DOUBLE, percent_cancellations_B DOUBLE,
    percent_cancellations_C DOUBLE, percent_cancellations_D DOUBLE, time_agg_level STRING, agg_level STRING
"""

RAW_FILES = {
    "flights": ("flights.csv", RAW_FLIGHTS),
    "airlines": ("airlines.csv", AIRLINES),
    "airports": ("airports.csv", AIRPORTS),
    "cancellation_codes": ("cancellation_codes.csv", CANCELLATION_CODES),
}

RAW_DATE_PARTS = ("year", "month", "day", "day_of_week")
FLIGHT_KEY = ("date", "airline", "flight_number", "scheduled_departure")
GOLD_DIMENSIONS = ("year", "month", "day_of_week", "airline", "origin_airport")
GOLD_KEY = (*GOLD_DIMENSIONS, "time_agg_level", "agg_level")
CANCELLATION_REASONS = ("A", "B", "C", "D")

MONTH_COLUMN = "date_month"


def ddl_fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string; the schemas above have no nested types."""
    return [tuple(field.split()) for field in ddl.split(",")]


def ddl_columns(ddl: str) -> list[str]:
    return [name for name, _ in ddl_fields(ddl)]


def _fact_ddl() -> str:
    kept = [f"{name} {kind}" for name, kind in ddl_fields(RAW_FLIGHTS) if name not in RAW_DATE_PARTS]
    return ", ".join(["date DATE", *kept, "is_delayed INT"])


FLIGHTS = _fact_ddl()


@dataclass(frozen=True)
class TableSpec:
    """A published table: its contract columns, merge key and whether it is laid out by month of ``date``."""

    ddl: str
    key: tuple[str, ...]
    by_month: bool = False

    @property
    def columns(self) -> list[str]:
        return ddl_columns(self.ddl)


TABLES = {
    "fact_flights": TableSpec(FLIGHTS, FLIGHT_KEY, by_month=True),
    "dim_airlines": TableSpec(AIRLINES, ("iata_code",)),
    "dim_airports": TableSpec(AIRPORTS, ("iata_code",)),
    "dim_cancellation_codes": TableSpec(CANCELLATION_CODES, ("cancellation_reason",)),
    "dim_dates": TableSpec(CALENDAR, ("date",)),
    "agg_fact_flights": TableSpec(GOLD, GOLD_KEY),
}
