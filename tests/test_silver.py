import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.functions.columns import delay_flag, flight_date, month_key, quoted, ratio
from skyledger.operators.silver import move_first, to_silver
from skyledger.schemas import FLIGHTS, ddl_columns
from tests.helpers import plan, raw_frame, rows


@pytest.mark.parametrize(
    ("year", "month", "day", "expected"),
    [
        (2015, 1, 2, "2015-01-02"),
        (2016, 2, 29, "2016-02-29"),
        (2015, 2, 29, None),
        (2015, 2, 30, None),
        (2015, 13, 1, None),
        (2015, 0, 1, None),
        (2015, 4, 31, None),
        (2015, 4, 0, None),
        (2015, 4, -1, None),
        (0, 4, 1, None),
        (None, 4, 1, None),
        (2015, None, 2, None),
        (2015, 4, None, None),
    ],
)
def test_flight_date(spark, year, month, day, expected):
    parts = spark.createDataFrame([(year, month, day)], "year INT, month INT, day INT")
    found = parts.select(flight_date().alias("date")).first().date
    assert (found and str(found)) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9999), st.integers(-2, 15), st.integers(-2, 34)), min_size=20, max_size=60))
def test_flight_date_agrees_with_the_standard_library(spark, triples):
    def expected(triple):
        try:
            return dt.date(*triple)
        except ValueError:
            return None

    parts = spark.createDataFrame(triples, "year INT, month INT, day INT")
    found = parts.select("year", "month", "day", flight_date().alias("date")).collect()
    assert all(r.date == expected((r.year, r.month, r.day)) for r in found)


def test_delay_flag(spark):
    delays = spark.createDataFrame([(5,), (0,), (-3,), (None,)], "departure_delay INT")
    assert rows(delays.select("departure_delay", delay_flag())) == [(None, 0), (-3, 0), (0, 0), (5, 1)]


def test_to_silver(spark):
    silver = to_silver(raw_frame(spark))
    assert silver.columns == ddl_columns(FLIGHTS)
    assert dict(silver.dtypes)["date"] == "date" and dict(silver.dtypes)["is_delayed"] == "int"
    assert silver.count() == 10
    late = silver.where("is_delayed = 1").select("flight_number").distinct()
    assert [r[0] for r in rows(late)] == [100, 104, 105, 106, 107]
    assert "Exchange" not in plan(silver)


def test_to_silver_in_order(spark):
    found = to_silver(raw_frame(spark), ordered=True).select("date", "scheduled_departure").collect()
    assert [tuple(r) for r in found] == sorted(tuple(r) for r in found)


def test_move_first(spark):
    assert move_first(spark.range(1).selectExpr("1 AS a", "2 AS b", "3 AS c"), "c").columns == ["c", "a", "b"]


def test_ratio_of_nothing_is_null(spark):
    one = spark.range(1)
    assert one.select(ratio(one.id, one.id)).first()[0] is None
    assert spark.sql("SELECT 3 AS a, 4 AS b").select(ratio("a", "b")).first()[0] == 0.75


def test_month_key(spark):
    assert spark.sql("SELECT DATE '2015-03-09' AS date").select(month_key()).first()[0] == "2015-03"


def test_quoted_names_survive_any_character(spark):
    odd = spark.range(1).withColumnRenamed("id", "a.b`c")
    assert odd.select(quoted("a.b`c")).first()[0] == 0
