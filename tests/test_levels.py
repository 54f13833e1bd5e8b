import datetime as dt
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyledger.functions.columns import label_from_nulls
from skyledger.operators import enrich, levels
from skyledger.operators.silver import to_silver
from skyledger.schemas import GOLD, ddl_columns, ddl_fields
from skyledger.sources.calendar import calendar
from tests.helpers import plan, raw_frame, rows, silver_frame, silver_row, tiny_shuffles


@pytest.fixture(scope="module")
def flights(spark):
    return to_silver(raw_frame(spark)).cache()


@pytest.fixture(scope="module")
def gold(flights):
    return levels.gold(flights).cache()


def brute_force(flights):
    """Groups and measures of every level, by looping over the flights."""
    found = defaultdict(lambda: [0, 0, [], 0, 0, 0, 0, 0])
    for f in flights.collect():
        values = dict(
            year=f.date.year, month=f.date.month, day_of_week=f.date.isoweekday() % 7 + 1, airline=f.airline,
            origin_airport=f.origin_airport,
        )
        for level in levels.GOLD_LEVELS:
            group = found[tuple(values[d] if d in level else None for d in values) + (level,)]
            group[0] += 1
            group[1] += f.departure_delay is not None and f.departure_delay > 0
            group[2] += [] if f.departure_delay is None else [f.departure_delay]
            group[3] += f.cancelled == 1
            for n, reason in enumerate("ABCD"):
                group[4 + n] += f.cancellation_reason == reason
    return found


def test_schema(gold):
    assert gold.columns == ddl_columns(GOLD)
    assert dict(gold.dtypes) == {name: kind.lower() for name, kind in ddl_fields(GOLD)}
    assert levels.gold_columns() == gold.columns


def test_twelve_levels():
    assert len(set(levels.GOLD_LEVELS)) == 12
    assert () in levels.GOLD_LEVELS and ("origin_airport", "year", "month") in levels.GOLD_LEVELS


def test_gold_against_brute_force(flights, gold):
    expected = {}
    for key, (total, late, delays, cancelled, *reasons) in brute_force(flights).items():
        *values, level = key
        time = "_".join(d for d in levels.TIME_DIMENSIONS if d in level) or "all"
        other = "_".join(d for d in levels.OTHER_DIMENSIONS if d in level) or "all"
        expected[(*values, time, other)] = (
            total, late, late / total, sum(delays) / len(delays) if delays else None, cancelled, cancelled / total,
            *reasons, *[r / cancelled if cancelled else None for r in reasons],
        )
    found = {(*r[:5], *r[-2:]): tuple(r[5:-2]) for r in map(tuple, gold.collect())}
    assert found == expected


def test_levels_add_up(gold):
    per_level = gold.groupBy("time_agg_level", "agg_level").agg(F.sum("total_flights").alias("n")).collect()
    assert {r.n for r in per_level} == {10}
    assert {r.time_agg_level for r in per_level} == {"all", "year", "year_month", "day_of_week"}
    assert {r.agg_level for r in per_level} == {"all", "airline", "origin_airport"}


def test_no_cancellations_gives_null_shares(gold):
    row = gold.where("airline = 'DL' AND time_agg_level = 'all'").first()
    assert (row.cancelled_flights, row.percent_cancellations_A) == (0, None)


def test_labels_agree_while_no_dimension_is_null(gold):
    again = gold.withColumn("t", label_from_nulls(levels.TIME_DIMENSIONS)).withColumn(
        "o", label_from_nulls(levels.OTHER_DIMENSIONS)
    )
    assert again.where("t != time_agg_level OR o != agg_level").count() == 0


def test_null_dimension_value_is_not_a_total(spark):
    flights = silver_frame(spark, [silver_row(airline=None), silver_row(), silver_row()])
    found = levels.gold(flights, levels=[(), ("airline",)])
    assert [(r[0], r[2], r[1]) for r in rows(found.select("airline", "total_flights", "agg_level"))] == [
        (None, "airline", 1), (None, "all", 3), ("AA", "airline", 2)
    ]


def test_label_from_nulls(spark):
    frame = spark.createDataFrame([(2015, 1, None), (None, None, None), (None, None, 3)], "year INT, month INT, day_of_week INT")
    labels = frame.select(label_from_nulls(["year", "month", "day_of_week"]))
    assert [r[0] for r in labels.collect()] == ["year_month", "all", "day_of_week"]


def test_calendar_join_drops_other_dates(spark, flights):
    january = calendar(spark, dt.date(2015, 1, 1), dt.date(2015, 1, 31))
    assert levels.gold(flights, january, [()]).first().total_flights == 8
    assert rows(levels.gold(flights, calendar(spark))) == rows(levels.gold(flights))


def test_flights_without_date_are_dropped(spark):
    flights = silver_frame(spark, [silver_row(), silver_row(date=None)])
    assert levels.gold(flights, levels=[()]).first().total_flights == 1
    assert enrich.with_date_parts(flights, "quarter").columns[-1] == "quarter"


def test_extended_metrics(flights):
    found = levels.gold(flights, levels=[()], extended=True)
    assert found.columns == levels.gold_columns(extended=True)
    row = found.first()
    assert (row.on_time_flights, row.on_time_rate) == (2, 0.2)
    assert row.avg_delay_time_delayed == (5 + 30 + 5 + 5 + 5 + 60) / 6
    assert row.avg_delay_time == (5 + -4 + 0 + 30 + 5 + 5 + 5 + 60) / 8


def test_single_level_equals_its_part_of_the_whole(flights, gold):
    one = levels.gold(flights, levels=[("airline", "year")])
    assert rows(one) == rows(gold.where("time_agg_level = 'year' AND agg_level = 'airline'"))


def test_rollup_cube_and_power_set():
    assert levels.rollup_levels(["a", "b"]) == [("a", "b"), ("a",), ()]
    assert sorted(levels.cube_levels(["a", ("b", "c")])) == [(), ("a",), ("a", "b", "c"), ("b", "c")]
    assert () not in levels.cube_levels(["a", "b", "c"], grand_total=False)
    assert len(levels.cube_levels(list("abcdef"), grand_total=False)) == 63


@pytest.mark.parametrize("kind", ["rollup", "cube"])
def test_levels_equal_the_native_operator(flights, kind):
    dated = enrich.with_date_parts(flights, *levels.TIME_DIMENSIONS)
    columns = ["airline", "year", "month"]
    chosen = levels.rollup_levels(columns) if kind == "rollup" else levels.cube_levels(columns)
    ours = levels.aggregate_levels(dated, chosen, ["year", "month"], ["airline"])
    native = getattr(dated, kind)(*columns).agg(
        F.count(F.lit(1)).alias("total_flights"), F.avg("departure_delay").alias("avg_delay_time")
    )
    picked = [*columns, "total_flights", "avg_delay_time"]
    assert rows(ours.select(*picked)) == rows(native.select(*picked))


def test_flights_are_reduced_before_they_are_expanded(spark):
    text = plan(levels.gold(silver_frame(spark, [silver_row()])))
    assert text.count("Exchange") == 2
    assert text.rindex("Expand") < text.rindex("Exchange")


def test_lookup(spark, flights):
    names = spark.createDataFrame([("AA", "American"), ("DL", "Delta")], "iata_code STRING, airline STRING")
    found = enrich.lookup(flights, names, "airline", "iata_code", {"airline": "airline_name"})
    assert found.columns == [*flights.columns, "airline_name"]
    expected = {("AA", "American"), ("DL", "Delta"), ("UA", None)}
    assert {(r.airline, r.airline_name) for r in found.collect()} == expected
    with tiny_shuffles(spark):
        found = enrich.lookup(flights, names, "airline", "iata_code", {"airline": "airline_name"})
        assert {(r.airline, r.airline_name) for r in found.collect()} == expected


def test_rows_without_a_code_are_spread_over_a_shuffled_lookup(spark):
    coded = spark.range(20_000).selectExpr("id", "if(id % 100 = 0, 'A', NULL) AS code")
    codes = spark.createDataFrame([("A", "first")], "code STRING, meaning STRING")
    with tiny_shuffles(spark):
        found = enrich.lookup(coded, codes, "code", "code", {"meaning": "meaning"})
        assert re.search(r"hashpartitioning\(_key#\d+", plan(found))
        assert found.where("meaning = 'first'").count() == 200
        assert found.where("code IS NULL AND meaning IS NULL").count() == 19_800
