"""What is computed once stays so: flights behind several steps, and the rows that a load has to touch."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators.dedup import first_per_key
from skyledger.plans import catalogue, metrics, publish, states
from skyledger.quality import constraints as c
from skyledger.quality import suggest
from skyledger.sources import buckets, tables
from tests.helpers import plan, silver_frame, silver_row, tiny_shuffles

FLIGHTS = (
    "date DATE, airline STRING, flight_number INT, origin_airport STRING, destination_airport STRING, scheduled_departure INT,"
    " departure_delay INT, cancelled INT, cancellation_reason STRING, is_delayed INT"
)
DATES = [dt.date(1996, 3, 1), dt.date(1997, 5, 2), dt.date(1998, 8, 3), dt.date(1999, 1, 4), dt.date(1999, 1, 5)]
ROWS = [
    (day, airline, number, "SFO", "JFK", 1, 5 * number - 7, 0, None, int(5 * number > 7))
    for day in DATES
    for airline in ("2-HIGH", "5-LOW")
    for number in (1, 2)
] + [(DATES[-1], "2-HIGH", 3, "SFO", "JFK", 1, None, 1, "A", 0)]
ONCE = [
    "suggestions_evaluated", "wap_switch", "gold_from_cells", "dq_incremental", "merge_bucketed", "wap_two_loads",
    "replace_bucketed", "delete_from_table", "profile_sketched",
]


@pytest.mark.parametrize("name", ONCE)
def test_flights_are_computed_once(spark, monkeypatch, name):
    """A Python function in the input counts the rows that go through it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    rows = spark.createDataFrame(ROWS, FLIGHTS).withColumn("flight_number", F.udf(counted, "int").asNondeterministic()("flight_number"))
    monkeypatch.setattr(catalogue.proxy, "flights", lambda *_, **__: rows)
    catalogue.QUERIES[name](spark, "").collect()
    assert seen.value == len(ROWS)


def test_suggested_ranges_are_held_against_the_rows_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(90).selectExpr("id", "concat('a', id % 2) AS u", "if(id % 5 = 0, NULL, concat('b', id % 3 + if(id > 80, 1, 0))) AS w").write.parquet(path)
    found = suggest.evaluated(spark.read.parquet(path), F.col("id") >= 60)
    assert len(re.findall(r"FileScan parquet \[id#", plan(found))) == 2
    shares = {(r.column_name, r.rule): r.share for r in found.collect()}
    assert shares[("u", "categorical_range")] == 1.0 and shares[("w", "categorical_range")] == 27 / 30


def days(spark, *months):
    return silver_frame(spark, [silver_row(date=dt.date(2015, m, d), flight_number=d) for m in months for d in (1, 2, 3)])


@pytest.mark.parametrize("switch", [True, False])
def test_only_months_that_the_table_has_are_compared_and_shuffled(spark, database, monkeypatch, switch):
    table, rules = f"{database}.fact_flights", {"fact_flights": {"uniqueness": ["date", "flight_number"]}}
    publish.write_audit_publish(days(spark, 1, 2), table, rules=rules, switch=switch)
    compared, switched = [], []
    real = publish.without_existing

    def watched(batch, *rest, **named):
        compared.extend(tables.months_of(batch))
        return real(batch, *rest, **named)

    monkeypatch.setattr(publish, "without_existing", watched)
    if switch:
        monkeypatch.setattr(publish, "switch_months", lambda rows, *rest: switched.append(rows.count()) or tables.switch_months(rows, *rest))
    batch = days(spark, 2, 3).union(silver_frame(spark, [silver_row(date=dt.date(2015, 2, 9), flight_number=9)]))
    assert publish.write_audit_publish(batch, table, rules=rules, switch=switch)
    assert compared == ["2015-02"]
    assert switched == ([4] if switch else [])
    assert tables.read_table(spark, table).groupBy(F.month("date").alias("m")).count().orderBy("m").collect() == [(1, 3), (2, 4), (3, 3)]


def test_cells_are_made_in_one_pass_over_the_facts(spark, database, monkeypatch):
    fact, rules = f"{database}.fact_flights", {"fact_flights": {"uniqueness": ["date", "flight_number"]}}
    store = states.cell_store(spark, fact, f"{database}.cells")
    publish.write_audit_publish(days(spark, 1, 2), fact, rules=rules, before_write=store.note)
    store.refresh()
    tables.delete_where(spark, fact, "month(date) = 1 OR flight_number = 1", before_write=store.note)

    def again(rows):
        raise AssertionError("the rows are computed for their months alone")

    monkeypatch.setattr(tables, "months_of", again)
    assert store.refresh() == ["2015-01", "2015-02"]
    assert [r[0] for r in store.read().select("date").distinct().orderBy("date").collect()] == [dt.date(2015, 2, 2), dt.date(2015, 2, 3)]


def test_a_key_within_another_has_no_state_of_its_own(spark, database):
    fact = f"{database}.fact_flights"
    keys = [["airline", "flight_number"], ["airline", "flight_number", "origin_airport"]]
    state = metrics.MetricStates(spark, fact, f"{database}.metrics", [c.Check("t", tuple(c.uniqueness(k) for k in keys))])
    tables.create_for(days(spark, 1), fact, True)
    tables.append(days(spark, 1, 2).union(silver_frame(spark, [silver_row(flight_number=7), silver_row(flight_number=7, origin_airport="BOS")])), fact)
    state.refresh()
    assert len(state.keys) == 1
    assert [r.metric for r in state.metrics().orderBy("number").collect()] == [0.0, 2 / 8]


def test_a_load_without_repeated_keys_is_not_deduplicated(spark, database, monkeypatch):
    schema = "date DATE, number INT, delay INT"
    table = f"{database}.facts"
    buckets.create(spark.createDataFrame([], schema), table, ["date", "number"], 4)
    calls = []
    monkeypatch.setattr(buckets, "first_per_key", lambda df, keys: calls.append(keys) or first_per_key(df, keys))
    day = dt.date(2015, 1, 3)
    buckets.insert_new(spark.createDataFrame([(day, 1, 5), (day, None, 5), (None, None, 5)], schema), table)
    assert not calls
    buckets.insert_new(spark.createDataFrame([(day, 1, 1), (day, None, 1), (day, 2, 8), (day, 2, 7)], schema), table)
    assert len(calls) == 1
    assert set(map(tuple, buckets.read(spark, table).collect())) == {(day, 1, 5), (day, None, 5), (None, None, 5), (day, 2, 7)}


def test_a_replacement_is_dealt_to_the_buckets_once(spark, database, monkeypatch):
    """Its keys and its rows are shuffled once each, and the stored rows stay where they are."""
    schema, table = "number INT, name STRING, delay INT", f"{database}.facts"
    buckets.create(spark.createDataFrame([], schema), table, ["number", "name"], 3)
    buckets.insert_new(spark.createDataFrame([(1, "a", 1), (2, None, 1), (None, "c", 1)], schema), table)
    calls, plans = [], []
    real = buckets._replace_all
    monkeypatch.setattr(buckets, "first_per_key", lambda df, keys: calls.append(keys) or first_per_key(df, keys))
    monkeypatch.setattr(buckets, "_replace_all", lambda df, name: plans.append(plan(df)) or real(df, name))
    with tiny_shuffles(spark):
        buckets.replace(spark.createDataFrame([(2, None, 5), (None, "c", 5), (None, None, 5)], schema), table)
    assert not calls
    dealt = [line for line in plans[0].splitlines() if "Exchange" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line and ", 3)" in line for line in dealt)
    assert set(map(tuple, buckets.read(spark, table).collect())) == {(1, "a", 1), (2, None, 5), (None, "c", 5), (None, None, 5)}
    buckets.replace(spark.createDataFrame([(2, None, 8), (2, None, 7), (4, "d", None), (4, "d", 9)], schema), table)
    assert len(calls) == 1
    assert set(map(tuple, buckets.read(spark, table).collect())) == {(1, "a", 1), (2, None, 7), (None, "c", 5), (None, None, 5), (4, "d", None)}


def test_kept_and_new_rows_of_a_bucket_share_a_file(spark, database):
    table = f"{database}.facts"
    rows = spark.range(60).selectExpr("DATE '2015-03-01' AS date", "CAST(id AS INT) AS number", "1 AS delay")
    buckets.create(rows, table, ["date", "number"], 3)
    buckets.insert_new(rows, table)
    with tiny_shuffles(spark):
        buckets.replace(rows.where("number % 2 = 0").withColumn("delay", F.lit(2)), table)
    assert len(spark.table(table).inputFiles()) == 3
    assert sorted(r[1:] for r in buckets.read(spark, table).collect()) == [(n, 2 - n % 2) for n in range(60)]


def test_a_load_is_dealt_without_its_hash(spark, database):
    table = f"{database}.facts"
    rows = spark.range(60).selectExpr("id AS number", "1 AS delay")
    buckets.create(rows, table, ["number"], 3)
    dealt = buckets._dealt(rows, table)
    assert "hashpartitioning(xxhash64(" in plan(dealt)
    assert dealt.select(F.expr("pmod(hash(key_hash), 3)").alias("b"), F.spark_partition_id().alias("p")).where("b <> p").isEmpty()


def test_keys_of_a_replacement_are_told_apart_in_the_types_of_the_table(spark, database):
    table = f"{database}.facts"
    buckets.create(spark.createDataFrame([], "number INT, delay INT"), table, ["number"], 3)
    buckets.replace(spark.createDataFrame([("1", 5), ("01", 4)], "number STRING, delay INT"), table)
    assert buckets.read(spark, table).collect() == [(1, 4)]


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 10)
    assert [buckets.fitting(spark.range(n), 8) for n in (0, 80, 81, 200)] == [8, 8, 9, 20]


def test_a_delete_shuffles_no_stored_rows(spark, database, monkeypatch):
    fact = f"{database}.fact_flights"
    assert tables.write_new(days(spark, 1, 2, 3), fact)
    monkeypatch.setattr(tables, "laid_out", None)
    tables.delete_where(spark, fact, "month(date) = 1 OR flight_number = 1")
    assert sorted(tables.stored_months(spark, fact)) == ["2015-02", "2015-03"]
    assert spark.table(fact).count() == 4
