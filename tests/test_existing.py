import re

import pytest
from pyspark.testing import assertDataFrameEqual

from skyledger.functions.columns import same_row
from skyledger.operators import existing
from tests.helpers import plan, rows, tiny_shuffles

PEOPLE = "name STRING, age INT"


def test_null_safe_anti_join(spark):
    batch = spark.createDataFrame([("Mara", 41), ("Mara", 41), ("Ivo", None), (None, 7), ("Zoe", 18), ("Ivo", 6)], PEOPLE)
    stored = spark.createDataFrame([("Mara", 41), ("Ivo", None), (None, 7), ("Otto", 1)], PEOPLE)
    expected = spark.createDataFrame([("Zoe", 18), ("Ivo", 6)], PEOPLE)
    assertDataFrameEqual(existing.without_existing(batch, stored), expected)


def test_copies_in_the_batch_stay(spark):
    batch = spark.createDataFrame([("Mara", 41), ("Ivo", 1), ("Ivo", 1)], PEOPLE)
    stored = spark.createDataFrame([("Mara", 41)], PEOPLE)
    assert rows(existing.without_existing(batch, stored)) == [("Ivo", 1), ("Ivo", 1)]


def test_plain_and_null_safe_differ_on_nulls(spark):
    people = spark.createDataFrame([(4, "Mara"), (9, "Ivo"), (None, "Zoe")], "id INT, name STRING")
    assert rows(existing.without_existing(people, people, null_safe=False)) == [(None, "Zoe")]
    assert rows(existing.without_existing(people, people)) == []


def test_odd_column_names(spark):
    odd = spark.createDataFrame([(1, 2), (None, 3)], "`a.b` INT, `c d` INT")
    assert rows(existing.without_existing(odd, odd.where("`a.b` = 1"))) == [(None, 3)]
    assert rows(existing.without_existing(odd, odd, null_safe=False)) == [(None, 3)]


def test_same_row_predicate(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "a INT, b INT")
    right = spark.createDataFrame([(1, None), (2, 6)], "a INT, b INT")
    assert rows(left.join(right, same_row(left, right, ["a", "b"]), "left_semi")) == [(1, None)]


def test_new_and_changed_records(spark):
    schema = "id INT, name STRING, age INT"
    batch = spark.createDataFrame([(4, "Mara", 41), (5, "Ivo", None), (8, "Zoe", 18)], schema)
    stored = spark.createDataFrame([(4, "Mara", 41), (5, "Ivo", 3), (6, "Otto", 9)], schema)
    assert rows(existing.without_existing(batch, stored)) == [(5, "Ivo", None), (8, "Zoe", 18)]
    assert rows(existing.without_existing(batch, stored, ["id"])) == [(8, "Zoe", 18)]
    assert rows(existing.changed_existing(batch, stored, ["id"])) == [(5, "Ivo", None)]


def test_a_comparison_ships_each_column_once(spark):
    wide = spark.range(10).selectExpr("id", "id % 3 AS a", "id % 5 AS b")
    text = existing.without_existing(wide, wide)._jdf.queryExecution().optimizedPlan().toString()
    (folded,) = [x for x in text.splitlines() if "Project [xxhash64(" in x]
    assert re.search(r"AS _key#\d+\]$", folded.strip())  # hash and key, and no column besides


@pytest.fixture
def levels(spark):
    schema = "year INT, airline STRING, total INT"
    target = spark.createDataFrame([(2015, "AA", 1), (2015, None, 5)], schema)
    source = spark.createDataFrame([(2015, None, 7), (2015, "DL", 2)], schema)
    return target, source


def test_insert_only_merge(levels):
    merged = existing.merge_insert_only(*levels, ["year", "airline"])
    assert rows(merged) == [(2015, None, 5), (2015, "AA", 1), (2015, "DL", 2)]


def test_insert_only_merge_with_plain_keys_repeats_null_keys(levels):
    merged = existing.merge_insert_only(*levels, ["year", "airline"], null_safe=False)
    assert rows(merged) == [(2015, None, 5), (2015, None, 7), (2015, "AA", 1), (2015, "DL", 2)]


def test_replacing_merge(levels):
    merged = existing.merge_replace(*levels, ["year", "airline"])
    assert rows(merged) == [(2015, None, 7), (2015, "AA", 1), (2015, "DL", 2)]


def test_merge_fills_columns_the_source_lacks(spark, levels):
    target, source = levels
    merged = existing.merge_insert_only(target.selectExpr("*", "0.5 AS rate"), source, ["year", "airline"])
    assert (2015, "DL", 2, None) in rows(merged)


@pytest.mark.parametrize("unique", [False, True])
def test_comparison_is_an_equi_join(spark, unique):
    batch, stored = (spark.range(n).selectExpr("id * 2 AS a", "id % 3 AS b") for n in (100, 50))
    with tiny_shuffles(spark):
        text = plan(existing.without_existing(batch, stored, stored_is_unique=unique))
    assert text.count("Exchange hashpartitioning") == (2 if unique else 3)
    assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("unique", [False, True])
def test_hot_group_of_copies_is_split(spark, unique):
    """Half of the batch has one key; the join spreads it over several tasks and keeps every row."""
    batch = spark.range(200_000).selectExpr("if(id % 2 = 0, -1, id) AS a", "sha2(string(id), 256) AS b")
    stored = spark.range(0, 200_000, 3).selectExpr("id AS a").repartition(4)
    with tiny_shuffles(spark):
        found = existing.without_existing(batch.repartition(16), stored, ["a"], stored_is_unique=unique)
        count = len(found.collect())
        text = plan(found)
    assert count == 100_000 + sum(1 for n in range(1, 200_000, 2) if n % 3)
    assert "skew=true" in text
