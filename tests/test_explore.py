import datetime as dt

import pytest

from skyledger.operators import explore
from skyledger.operators.silver import to_silver
from skyledger.sources import tables
from tests.helpers import plan, raw_frame, rows, silver_frame, silver_row


@pytest.fixture(scope="module")
def flights(spark):
    return to_silver(raw_frame(spark)).cache()


def test_null_counts(flights):
    row = explore.null_counts(flights).first()
    assert (row.departure_delay, row.scheduled_time, row.cancellation_reason, row.airline) == (2, 1, 7, 0)
    assert explore.null_counts(flights, ["airline"]).columns == ["airline"]


def test_nulls_by_condition(flights):
    assert rows(explore.nulls_by_condition(flights, "cancelled = 1")) == [
        ("arrival_delay", 1, 0), ("cancellation_reason", 7, 0), ("departure_delay", 2, 2), ("departure_time", 2, 2),
        ("scheduled_time", 1, 0),
    ]


def test_counts(flights):
    assert tuple(explore.flight_counts(flights).first()) == (10, 3, 1)
    assert tuple(explore.date_bounds(flights).first()) == (dt.date(2015, 1, 1), dt.date(2015, 2, 28))
    assert rows(explore.delay_by(flights, "airline")) == [("AA", 7, 4, 4 / 7), ("DL", 2, 2, 1.0), ("UA", 1, 0, 0.0)]
    assert rows(explore.late_departures_by(flights, "airline")) == [("AA", 4), ("DL", 2)]


def test_anomalies(spark, flights):
    assert rows(explore.anomaly_counts(flights)) == [
        ("cancelled_after_pushback", 1), ("diverted_with_arrival_delay", 0), ("reason_without_cancellation", 0),
        ("scheduled_time_missing", 1),
    ]
    assert [r.flight_number for r in explore.anomalous_rows(flights, "cancelled_after_pushback").collect()] == [104]
    odd = silver_frame(spark, [silver_row(cancellation_reason="A")])
    assert explore.anomalous_rows(odd, "reason_without_cancellation").count() == 1


def test_in_month(spark, database, flights):
    assert explore.in_month(flights, 2015, 2).count() == 2
    assert explore.in_month(flights, 2016, 2).count() == 0
    table = tables.full_name(database, "fact_flights")
    tables.create_like(flights, table, by_month=True)
    month = explore.in_month(spark.table(table), 2015, 2)
    assert month.count() == 2
    assert "2015-02" in plan(month).split("PartitionFilters")[1][:120]


def test_samples(spark):
    keys = spark.range(10000).selectExpr("id % 2000 AS k", "id")
    sample = explore.key_sample(keys, ["k"], 10)
    assert 100 < sample.select("k").distinct().count() < 300
    assert sample.count() == 5 * sample.select("k").distinct().count()
    assert rows(sample) == rows(explore.key_sample(keys.repartition(7), ["k"], 10))
    one, two = (explore.random_sample(keys, 0.1, seed=3) for _ in range(2))
    assert rows(one) == rows(two) and 500 < one.count() < 1500


def test_partition_and_file_stats(spark, database, flights):
    table = tables.full_name(database, "fact_flights")
    tables.create_like(flights, table, by_month=True)
    stored = spark.table(table)
    assert rows(explore.partition_stats(stored, "departure_delay")) == [("2015-01", 8, 1, -4, 30), ("2015-02", 2, 1, 60, 60)]
    nulls = explore.partition_stats(stored, "scheduled_time").where("null_count > 0")
    assert [r.partition for r in nulls.collect()] == ["2015-01"]
    files = explore.file_stats(stored)
    assert files.agg({"row_count": "sum"}).first()[0] == 10
    total = explore.total_bytes(stored).first()
    assert total.files == len(stored.inputFiles()) and total.total_bytes > 0
