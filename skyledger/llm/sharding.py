"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows uniformly over buckets by a seeded hash; a bucket is sized to fit a task's memory, so their number grows with
the data. Pass two reads one bucket at a time, brings its rows into a fixed order and applies a Fisher-Yates shuffle (Spark's
``shuffle``). The buckets in a row form the shuffled order of all rows, cut into shards whose counts differ by one at most
(law ``rows``); ``slot`` is the place in the shard, from 0.

The place of a bucket is a sum of counts, in two levels: within 1,024 buckets, and over these groups. Equal texts of different ids, ids of
different texts and null ids are spread over all buckets; only rows that agree in both share one. A bucket is a partition
of its own, addressed by its number. Tasks run again after a lost executor repeat the same order: a partition's bucket and the order
before the shuffle are fixed.

A null text counts one byte. Any table with the key columns can be sharded; all columns go along, and a column
called shard or slot is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns_of, partitions

BUCKET_BYTES = 16 << 20
SEED = 20240607
GROUP = 1024  # buckets whose counts are summed in one task


def size_of(text: Column) -> Column:
    """Bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bucket_places(scattered: DataFrame) -> DataFrame:
    """Per bucket, the number of rows in the buckets before it, and of all rows."""
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("_group", before.alias("_groups_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("_bucket", "_group", within.alias("_before")).join(groups, "_group").select("_bucket", (F.col("_groups_before") + F.col("_before")).alias("_first"), "_all")


def shard_rows(rows: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``rows`` with shard (0 to ``shards`` - 1) and slot."""
    rows = rows.drop("shard", "slot")
    total = rows.agg(F.sum(size_of(F.col(text)))).first()[0] or 0
    n = max(partitions(rows.sparkSession), math.ceil(total / bucket_bytes))
    tie = F.xxhash64(F.col(text))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), tie), F.lit(n)).cast("int").alias("_bucket")
    # A null text hashes like no input at all, an empty one does not: both are fine, they only choose a bucket.
    places = bucket_places(rows.select(bucket))
    item = F.struct(F.col(key).alias("_key"), tie.alias("_tie"), F.struct(*columns_of(rows)).alias("_row"))
    buckets = (
        rows.select(bucket, item.alias("_item"))
        .repartitionById(n, F.col("_bucket"))
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        .select("_bucket", F.shuffle("_items", seed).alias("_items"))
    )
    # Both sides have bucket b in partition b, so the join shuffles no rows again.
    placed = buckets.join(places.repartitionById(n, F.col("_bucket")), "_bucket").select("_first", "_all", F.posexplode("_items").alias("_at", "_item"))
    place = F.col("_first") + F.col("_at")
    # Shard s starts at the smallest place p with floor(p * shards / all) = s, which is ceil(s * all / shards).
    shard = F.expr(f"((_first + _at) * {shards}) div _all")
    start = F.expr(f"(_shard * _all + {shards} - 1) div {shards}")
    return (
        placed.select(F.col("_item._row").alias("_row"), place.alias("_place"), shard.cast("int").alias("_shard"), "_all")
        .select("_row.*", F.col("_shard").alias("shard"), (F.col("_place") - start).cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; every file holds a stretch of slots in order."""
    sharded.repartitionByRange(partitions(sharded.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
