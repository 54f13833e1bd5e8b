import pytest

from skyledger.operators import levels
from skyledger.operators.reshape import to_long
from skyledger.operators.silver import to_silver
from skyledger.plans import reports
from tests.helpers import plan, raw_frame, rows, silver_frame, silver_row


@pytest.fixture(scope="module")
def gold(spark):
    return levels.gold(to_silver(raw_frame(spark)), extended=True).cache()


def test_airlines(gold):
    assert rows(reports.airlines(gold)) == [("AA",), ("DL",), ("UA",)]


def test_headline(gold):
    row = reports.headline(gold, year=2015).first()
    assert (row.total_flights, row.delayed_flights, row.cancelled_flights) == (10, 6, 3)
    assert row.delayed_rate == pytest.approx((4 / 7 + 1 + 0) / 3)
    assert reports.headline(gold, weighted=True).first().delayed_rate == 0.6
    assert reports.headline(gold, "DL").first().total_flights == 2
    assert reports.headline(gold, year=2014).count() == 0


def test_null_airline_matches_no_pattern(spark):
    found = levels.gold(silver_frame(spark, [silver_row(airline=None), silver_row()]))
    assert reports.headline(found).first().total_flights == 1


def test_volumes(gold):
    assert rows(reports.monthly_volume(gold)) == [(2015, 1, 8, 5, 2), (2015, 2, 2, 1, 1)]
    assert rows(reports.weekday_volume(gold)) == [(None, 5, 8, 5, 2), (None, 7, 2, 1, 1)]
    assert rows(reports.monthly_volume_long(gold, "UA")) == [
        (2015, 2, "cancelled_flights", 1), (2015, 2, "delayed_flights", 0), (2015, 2, "total_flights", 1)
    ]
    assert reports.weekday_volume_long(gold).count() == 6


def test_delays(gold):
    assert rows(reports.monthly_delays(gold, "DL")) == [(2015, 1, 1.0, 5.0), (2015, 2, 1.0, 60.0)]
    assert rows(reports.monthly_delays_by_origin(gold, "BOS")) == [(2015, 1, "BOS", 1.0, 5.0)]
    assert [r.airline for r in reports.airline_reliability(gold).collect()] == ["AA", "DL", "UA"]


def test_most_and_least_reliable(gold):
    assert [r.airline for r in reports.most_reliable(gold, 2).collect()] == ["UA", "AA"]
    assert [r.airline for r in reports.least_reliable(gold, 1).collect()] == ["DL"]


def test_cancellations(gold):
    assert rows(reports.yearly_cancellations(gold)) == [
        ("Airline/Carrier", 1), ("National Air System", 1), ("Security", 0), ("Weather", 1)
    ]
    assert reports.cancellation_shares(gold).columns == ["name", "value"]
    assert (2015, 1, "weather", 1) in rows(reports.monthly_cancellations(gold))
    assert reports.monthly_cancellation_rates(gold, "UA").first().percent_cancellations_C == 1.0


def test_on_time(gold):
    assert rows(reports.on_time_rates(gold).where("airline = 'AA'")) == [("AA", 7, 2, 2 / 7)]


def test_overall(gold):
    assert rows(reports.overall_monthly_volume(gold)) == [(2015, 1, 8), (2015, 2, 2)]
    assert rows(reports.overall_weekday_volume(gold)) == [(5, 8), (7, 2)]
    assert reports.overall_totals(gold).first().total_flights == 10
    assert reports.overall_delays(gold).first().delayed_rate == 0.6
    assert reports.overall_monthly_delays(gold).count() == 2
    assert reports.overall_cancellations(gold).first().cancelled_flights == 3


def test_levels_of_a_report_are_enough_for_it(spark, gold):
    flights = to_silver(raw_frame(spark))
    for name, wanted in reports.LEVELS.items():
        report = getattr(reports, name)
        arguments = {"k": 2} if name.endswith("reliable") else {}
        part = levels.gold(flights, levels=wanted, extended=True)
        assert rows(report(part, **arguments)) == rows(report(gold, **arguments)), name


def test_long_form(spark):
    wide = spark.createDataFrame([(1, 10, None), (2, None, 20)], "id INT, a INT, b INT")
    assert rows(to_long(wide, ["a", "b"], "name", "value")) == [(1, "a", 10), (2, "b", 20)]
    assert to_long(wide, ["a", "b"], "name", "value", keep_nulls=True).count() == 4
    assert rows(to_long(wide.drop("b"), {"a": "A (total)"}, "name", "value")) == [(1, "A (total)", 10)]
    assert plan(to_long(spark.range(5).selectExpr("id", "id AS a", "id AS b"), ["a", "b"], "n", "v")).count("Range") == 1
