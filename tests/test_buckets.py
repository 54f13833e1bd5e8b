"""Tables bucketed by key: merges against plain loops, and plans that leave the stored side where it is."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyledger.sources import buckets
from tests.helpers import plan, rows, tiny_shuffles

SCHEMA = "date DATE, number INT, airline STRING, delay INT"
KEY = ["date", "number", "airline"]


def day(month, d=3):
    return dt.date(2015, month, d)


def new(spark, database, keys=KEY, schema=SCHEMA, n=4):
    table = f"{database}.facts"
    buckets.create(spark.createDataFrame([], schema), table, keys, n)
    return table


def random_rows(seed, n):
    r = random.Random(seed)
    date = lambda: r.choice([None, day(1), day(1, 4), day(2), day(3)])
    return [(date(), r.choice([None, 1, 2, 3]), r.choice([None, "", "AA", "DL"]), r.randrange(100)) for _ in range(n)]


def first_rows(batch):
    found = {}
    for row in sorted(batch, key=lambda x: x[3]):
        found.setdefault(row[:3], row)
    return found


def as_set(spark, table):
    found = [tuple(r) for r in buckets.read(spark, table).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_merges_equal_plain_loops(spark, database):
    table = new(spark, database)
    state = {}
    for seed, merge in enumerate((buckets.insert_new, buckets.insert_new, buckets.replace, buckets.insert_new, buckets.replace)):
        batch = random_rows(seed, 25)
        merge(spark.createDataFrame(batch, SCHEMA), table)
        state = first_rows(batch) | state if merge is buckets.insert_new else state | first_rows(batch)
        assert as_set(spark, table) == set(state.values())


@pytest.mark.parametrize("merge", [buckets.insert_new, buckets.replace])
def test_nothing_and_repeats(spark, database, merge):
    table = new(spark, database)
    merge(spark.createDataFrame([], SCHEMA), table)
    assert as_set(spark, table) == set()
    batch = spark.createDataFrame(random_rows(7, 20), SCHEMA)
    merge(batch, table)
    once = as_set(spark, table)
    merge(batch, table)
    merge(spark.createDataFrame([], SCHEMA), table)
    assert as_set(spark, table) == once


def test_copies_of_a_new_key_stay_and_known_ones_go(spark, database):
    table = new(spark, database)
    buckets.insert_new(spark.createDataFrame([(day(1), 1, None, 5)], SCHEMA), table)
    batch = spark.createDataFrame([(day(1), 1, None, 9), (day(2), 1, None, 9), (day(2), 1, None, 9), (None, None, None, 1)], SCHEMA)
    assert rows(buckets.without_stored(batch, table)) == rows(spark.createDataFrame([(day(2), 1, None, 9)] * 2 + [(None, None, None, 1)], SCHEMA))
    assert rows(buckets.stored_keys(batch, table)) == [(day(1), 1, None)]


def test_a_batch_of_other_types_and_columns(spark, database):
    table = new(spark, database)
    buckets.insert_new(spark.createDataFrame([(day(1), 1, "AA", 5)], SCHEMA), table)
    other = spark.createDataFrame([("AA", "2015-01-03", 1), ("AA", "2015-01-03", 2)], "airline STRING, date STRING, number BIGINT")
    buckets.insert_new(other, table)
    assert as_set(spark, table) == {(day(1), 1, "AA", 5), (day(1), 2, "AA", None)}


@pytest.mark.parametrize("merge", [buckets.insert_new, buckets.replace])
def test_keys_without_a_date(spark, database, merge):
    schema = "`a.b` INT, `it's` STRING, v INT"
    table = new(spark, database, ["a.b", "it's"], schema)
    merge(spark.createDataFrame([(1, None, 1), (2, "x", 1)], schema), table)
    merge(spark.createDataFrame([(1, None, 2), (None, "x", 2)], schema), table)
    kept = 1 if merge is buckets.insert_new else 2
    assert as_set(spark, table) == {(1, None, kept), (2, "x", 1), (None, "x", 2)}


def test_a_table_of_another_layout_is_refused(spark, database):
    spark.range(3).write.saveAsTable(f"{database}.plain")
    with pytest.raises(ValueError):
        buckets.without_stored(spark.range(3), f"{database}.plain")


def big(spark, n=20_000):
    return spark.range(n).selectExpr(
        "date_add(DATE '2015-01-01', CAST(id % 90 AS INT)) AS date", "CAST(id AS INT) AS number", "'AA' AS airline", "1 AS delay"
    )


def stored_branch(text):
    """Lines of the plan between the scan of the table and the join above it."""
    lines = text.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and "facts" in line)
    join = max(k for k in range(at) if "SortMergeJoin" in lines[k] and lines[k].index("SortMergeJoin") < lines[at].index("FileScan"))
    branch, depth = [], lines[at].index("FileScan")
    for line in reversed(lines[join:at]):
        place = len(line) - len(line.lstrip(" :+-"))
        if place < depth:
            branch.append(line)
            depth = place
    return branch, lines[at]


def test_stored_rows_are_not_shuffled_and_other_months_not_read(spark, database):
    table = new(spark, database, n=8)
    buckets.insert_new(big(spark), table)
    load = big(spark).where("date < '2015-02-01'").limit(50)
    with tiny_shuffles(spark):
        text = plan(buckets.stored_keys(load, table))
    branch, scan = stored_branch(text)
    assert "Bucketed: true" in scan and "date_month" in scan and "2015-01" in scan
    assert any("SortMergeJoin" in line for line in branch) and not any("Exchange" in line for line in branch)


def test_a_file_holds_one_bucket_and_a_load_adds_few(spark, database):
    table = new(spark, database, n=8)
    buckets.insert_new(big(spark).where("number % 2 = 0"), table)
    before = set(spark.table(table).inputFiles())
    assert len(before) == 8 * 3
    buckets.insert_new(big(spark).where("date < '2015-02-01'"), table)
    added = set(spark.table(table).inputFiles()) - before
    assert 0 < len(added) <= 8 and all("2015-01" in f for f in added)
    buckets.replace(big(spark).where("date >= '2015-03-01'").withColumn("delay", F.lit(2)), table)
    after = set(spark.table(table).inputFiles())
    assert {f for f in before | added if "2015-03" not in f} <= after
    counts = {tuple(r) for r in spark.table(table).groupBy("date_month", "delay").count().collect()}
    all_rows = {tuple(r) for r in big(spark).selectExpr("date_format(date, 'yyyy-MM') AS m", "number").groupBy("m").count().collect()}
    n = dict(all_rows)
    even = big(spark).where("number % 2 = 0 AND date_format(date, 'yyyy-MM') = '2015-02'").count()
    assert counts == {("2015-01", 1, n["2015-01"]), ("2015-02", 1, even), ("2015-03", 2, n["2015-03"])}


def test_a_hot_key_of_the_load_is_split(spark, database):
    """Half of the load has one key that the table lacks: no task gets all of it."""
    schema = "a BIGINT, b STRING"
    table = new(spark, database, ["a"], schema)
    buckets.insert_new(spark.range(0, 60_000, 3).selectExpr("id AS a", "'x' AS b"), table)
    batch = spark.range(200_000).selectExpr("if(id % 2 = 0, -1, id) AS a", "sha2(string(id), 256) AS b").repartition(16)
    with tiny_shuffles(spark):
        found = buckets.without_stored(batch, table)
        assert len(found.collect()) == 100_000 + sum(1 for k in range(1, 200_000, 2) if k % 3 or k >= 60_000)
        assert "skew=true" in plan(found)
