"""Hand-made flights with the awkward cases, and small conveniences."""

import datetime as dt
from contextlib import contextmanager

from skyledger.schemas import FLIGHTS, RAW_FLIGHTS, ddl_fields


def rows(df):
    """All rows as a sorted list of tuples, NULLs first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def tiny_shuffles(spark):
    """Joins by shuffle only, and partitions of 100 KB counting as skewed."""
    chosen = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in chosen}
    for name, value in chosen.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def raw_row(**values):
    """A raw flight with plausible defaults."""
    row = {name: (None if kind == "STRING" else 0) for name, kind in ddl_fields(RAW_FLIGHTS)}
    row |= dict(
        year=2015, month=1, day=1, day_of_week=4, airline="AA", flight_number=100, tail_number="N1",
        origin_airport="SFO", destination_airport="JFK", scheduled_departure=1000, departure_time=1005,
        departure_delay=5, distance=2586, scheduled_arrival=1800,
    )
    return row | values


CANCELLED = dict(cancelled=1, departure_delay=None, departure_time=None)
RAW = [
    raw_row(),
    raw_row(flight_number=101, departure_delay=-4),
    raw_row(flight_number=102, departure_delay=0),
    raw_row(flight_number=103, cancellation_reason="B", **CANCELLED),
    raw_row(flight_number=104, cancellation_reason="A", cancelled=1, departure_delay=30),
    raw_row(flight_number=105, diverted=1, arrival_delay=None, origin_airport="BOS"),
    raw_row(flight_number=106, scheduled_time=None, airline="DL", origin_airport="BOS"),
    raw_row(flight_number=100, origin_airport="PHL"),
    raw_row(flight_number=107, airline="DL", month=2, day=28, departure_delay=60),
    raw_row(flight_number=108, airline="UA", month=2, day=28, cancellation_reason="C", **CANCELLED),
]


def raw_frame(spark, data=None):
    names = [name for name, _ in ddl_fields(RAW_FLIGHTS)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in data or RAW], RAW_FLIGHTS)


def silver_row(**values):
    """A silver flight that passes all configured checks."""
    raw = raw_row()
    row = {name: raw.get(name) for name, _ in ddl_fields(FLIGHTS)}
    row |= dict(date=dt.date(2015, 1, 1), is_delayed=1)
    return row | values


def silver_frame(spark, data):
    names = [name for name, _ in ddl_fields(FLIGHTS)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in data], FLIGHTS)
