"""Ranks and running sums against Spark's own windows, on keys of every size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators import ranks
from tests.helpers import rows


def numbers(spark, n, key):
    return spark.range(n).select(F.expr(key).alias("k"), (F.col("id") * 7919 % 1009).alias("v"), "id")


KEYS = {
    "constant": "'x'",
    "null": "CAST(NULL AS STRING)",
    "two": "CASE WHEN id % 3 > 0 THEN 'a' END",
    "many": "CAST(id % 97 AS STRING)",
    "own": "CAST(id AS STRING)",
}


@pytest.mark.parametrize("name", KEYS)
@pytest.mark.parametrize("descending", [True, False])
def test_rank_equals_the_window(spark, name, descending):
    df = numbers(spark, 3000, KEYS[name])
    order = F.col("v").desc() if descending else F.col("v").asc()
    expected = df.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(order)).cast("long"))
    assert rows(ranks.rank_hot(df, ["k"], "v", descending)) == rows(expected)


@pytest.mark.parametrize("name", KEYS)
def test_running_sums_equal_the_window(spark, name):
    df = numbers(spark, 3000, KEYS[name])
    place = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("*", F.sum("v").over(place).alias("s"), F.sum(F.lit(1)).over(place).cast("long").alias("n"))
    found = ranks.running_sums(df, ["k"], ["v", "id"], {"s": F.col("v"), "n": F.lit(1)})
    assert rows(found) == rows(expected)


def test_no_rows(spark):
    assert rows(ranks.rank_hot(numbers(spark, 0, KEYS["constant"]), ["k"], "v")) == []


def test_ties_and_copies_share_a_rank(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("a", None), ("a", 2), ("b", 1)], "k string, v int")
    found = {(r.k, r.v): r["rank"] for r in ranks.rank_hot(df, ["k"], "v").collect()}
    assert found == {("a", 2): 1, ("a", 1): 2, ("a", None): 502, ("b", 1): 1}


def test_a_hot_key_spreads_evenly(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        laid = ranks.in_ranges(spark.range(100_000).select(F.lit("x").alias("k"), F.xxhash64("id").alias("v")), ["k", "v"])
        sizes = sorted(r["count"] for r in laid.groupBy("_part").count().collect())
    finally:
        spark.conf.unset(setting)
    assert len(sizes) == 4
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
