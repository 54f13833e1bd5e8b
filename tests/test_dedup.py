import datetime as dt

from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from skyledger.operators import dedup
from skyledger.schemas import FLIGHT_KEY
from tests.helpers import plan, rows, tiny_shuffles

SCHEMA = "date DATE, airline STRING, flight_number INT, scheduled_departure INT, origin_airport STRING"
FLIGHTS = [
    (dt.date(2019, 7, 9), "UA", 12, 635, "DEN"),
    (dt.date(2019, 7, 9), "UA", 12, 635, "BOI"),
    (dt.date(2019, 7, 9), "UA", 12, 640, "SEA"),
    (dt.date(2019, 7, 9), "WN", 12, 635, "OAK"),
    (dt.date(2019, 7, 10), "UA", 12, 635, "MSP"),
    (dt.date(2019, 7, 10), "UA", 12, 635, "GEG"),
]
SURVIVORS = [FLIGHTS[0], FLIGHTS[2], FLIGHTS[3], FLIGHTS[4]]


def test_any_row_per_key(spark):
    flights = spark.createDataFrame(FLIGHTS, SCHEMA)
    found = dedup.drop_duplicate_keys(flights, FLIGHT_KEY)
    assert found.count() == 4
    assert set(rows(found)) <= set(FLIGHTS)


def test_first_arrived_row_per_key(spark):
    arrived = spark.createDataFrame([(*f, n) for n, f in enumerate(FLIGHTS)], SCHEMA + ", arrival INT")
    for partitions in (1, 4):
        found = dedup.first_per_key(arrived.repartition(partitions), FLIGHT_KEY, ["arrival"]).drop("arrival")
        assertDataFrameEqual(found, spark.createDataFrame(SURVIVORS, SCHEMA))


def test_survivor_without_order_is_the_smallest_row(spark):
    flights = spark.createDataFrame(FLIGHTS, SCHEMA)
    assert [r[4] for r in rows(dedup.first_per_key(flights, FLIGHT_KEY))] == ["BOI", "SEA", "OAK", "GEG"]


def test_null_keys_are_one_key(spark):
    pairs = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k INT, v INT")
    assert rows(dedup.first_per_key(pairs, ["k"])) == [(None, 1), (1, 3)]
    assert rows(dedup.duplicate_keys(pairs, ["k"])) == [(None, 2)]
    assert rows(dedup.duplicate_rows(pairs, ["k"])) == [(None, 1, 2), (None, 2, 2)]


def test_key_of_all_columns(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "k INT, v INT")
    assert rows(dedup.first_per_key(pairs, ["k", "v"])) == [(1, 1), (1, 2)]


def test_copies_are_dropped_before_the_shuffle(spark):
    """One key with nearly all rows: a task passes on a single one of them."""
    text = plan(dedup.first_per_key(spark.range(1000).selectExpr("id % 2 AS k", "id AS v"), ["k"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_duplicate_rows_match_a_window(spark):
    numbers = spark.range(500).selectExpr("CAST(id * id % 97 AS INT) AS k", "id AS v")
    expected = numbers.selectExpr("k", "v", "count(*) OVER (PARTITION BY k) AS row_count").where("row_count > 1")
    assert rows(dedup.duplicate_rows(numbers, ["k"])) == rows(expected)


def test_rank_matches_a_window(spark):
    numbers = spark.range(500).selectExpr("id % 7 AS k", "nullif(id % 11, 3) AS v", "id")
    for descending, order in ((True, "DESC NULLS LAST"), (False, "ASC NULLS FIRST")):
        expected = numbers.selectExpr("k", "v", "id", f"rank() OVER (PARTITION BY k ORDER BY v {order}) AS rank")
        assert rows(dedup.rank_within_key(numbers, ["k"], "v", descending)) == [
            (k, v, i, int(r)) for k, v, i, r in rows(expected)
        ]


def test_key_counts(spark):
    flights = spark.createDataFrame(FLIGHTS, SCHEMA)
    assert dedup.key_counts(flights, FLIGHT_KEY).agg(F.sum("row_count")).first()[0] == len(FLIGHTS)


def test_hot_key_is_split(spark):
    """A key with half of all rows is counted on the map side and joined back in several tasks."""
    numbers = spark.range(200_000).selectExpr("if(id % 2 = 0, -1, id) AS k", "sha2(string(id), 256) AS v")
    with tiny_shuffles(spark):
        found = dedup.duplicate_rows(numbers.repartition(16), ["k"])
        assert len(found.collect()) == 100_000
        text = plan(found)
        assert len(dedup.first_per_key(numbers.repartition(16), ["k"]).collect()) == 100_001
    assert "skew=true" in text and "Window" not in text
