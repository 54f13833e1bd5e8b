"""Fact tables bucketed by key within months: a load is held against the stored rows without moving these.

The rows carry a hash of their key, and files hold one bucket of that hash each. Spark reads such a table as if it were
already shuffled by the hash, so a comparison by key ships the load alone. A load's keys are made distinct first:
each then meets one bucket, however often the load repeats it, and copies of a key are matched by an ordinary
join that AQE splits.

The number of buckets is fixed when a table is made, as are its key columns; both are kept with the table. Take as many buckets as
make a bucket's rows of the months that one load touches fit a task. NULLs in a key are equal to each other. A load's key
columns are taken in the table's types, so an INT batch meets a BIGINT table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import month_key, named, quoted, row_key
from skyledger.operators.dedup import first_per_key
from skyledger.operators.existing import without_existing
from skyledger.schemas import MONTH_COLUMN
from skyledger.sources import tables

KEY_HASH = "key_hash"
PROPERTY = "bucketed_by_key"
BUCKETS = 64
ROWS_PER_BUCKET = 4_000_000  # what a task sorts in memory


def fitting(rows: DataFrame, at_least: int = BUCKETS) -> int:
    """Number of buckets such that one of them has about `ROWS_PER_BUCKET` of the rows at most."""
    return max(at_least, -(-rows.count() // ROWS_PER_BUCKET))


def create(batch: DataFrame, table: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Create an empty table of the batch's columns, by month of ``date`` where it has one, bucketed by ``keys``."""
    columns = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in batch.drop(KEY_HASH, MONTH_COLUMN).schema]
    by_month = "date" in batch.columns
    ddl = ", ".join([*columns, f"{KEY_HASH} BIGINT", *([f"{MONTH_COLUMN} STRING"] if by_month else [])])
    partitions = f"PARTITIONED BY ({MONTH_COLUMN})" if by_month else ""
    noted = json.dumps({"keys": list(keys), "buckets": buckets}).replace("\\", "\\\\").replace("'", "\\'")
    batch.sparkSession.sql(
        f"CREATE TABLE {table} ({ddl}) USING parquet {partitions}"
        f" CLUSTERED BY ({KEY_HASH}) SORTED BY ({KEY_HASH}) INTO {buckets} BUCKETS TBLPROPERTIES ('{PROPERTY}' = '{noted}')"
    )


def layout(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """A table's key columns and its number of buckets."""
    noted = {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if PROPERTY not in noted:
        raise ValueError(f"{table} is not bucketed by key")
    found = json.loads(noted[PROPERTY])
    return found["keys"], found["buckets"]


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows without the columns of its layout."""
    return spark.table(table).drop(KEY_HASH, MONTH_COLUMN)


def _as_stored(stored: DataFrame, keys: Sequence[str]) -> list[Column]:
    """A batch's key columns in the table's types."""
    types = {f.name: f.dataType for f in stored.schema}
    return [named(k).cast(types[k]).alias(k) for k in keys]


def _hashed(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch's distinct keys with the hash that the table has for them."""
    distinct = batch.select(*_as_stored(stored, keys)).distinct()
    return distinct.select(F.xxhash64(*[named(k) for k in keys]).alias("_sought"), row_key(keys).alias("_sought_key"))


def _same_key() -> Column:
    """Equal hashes, then equal keys.

    The keys are compared as members of an array, so that Spark joins by the hash alone, which is what the files are bucketed by.
    """
    return (F.col(KEY_HASH) == F.col("_sought")) & F.array_contains(F.array("_key"), F.col("_sought_key"))


def _touched(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str | None] | None]:
    """The stored rows that the batch's keys can be among, and their months if the key tells them."""
    if "date" not in keys or not tables.is_by_month(stored):
        return stored, None
    date = next(f.dataType for f in stored.schema if f.name == "date")
    months = tables.months_of(batch.select(month_key(F.col("date").cast(date)).alias(MONTH_COLUMN)))
    return tables.only_months(stored, months), months


def stored_keys(batch: DataFrame, table: str) -> DataFrame:
    """Those of the batch's keys that the table has, each once, in the table's types. The stored rows are not shuffled."""
    spark = batch.sparkSession
    keys, _ = layout(spark, table)
    stored, _ = _touched(batch, spark.table(table), keys)
    seen = stored.select(KEY_HASH, row_key(keys).alias("_key"))
    return _hashed(batch, stored, keys).join(seen, _same_key(), "left_semi").select("_sought_key.*")


def without_stored(batch: DataFrame, table: str) -> DataFrame:
    """Rows of the batch whose key the table lacks; copies within the batch stay. Key columns come in the table's types."""
    spark = batch.sparkSession
    keys, _ = layout(spark, table)
    typed = dict(zip(keys, _as_stored(spark.table(table), keys)))
    rows = batch.select(*[typed.get(c, named(c)) for c in batch.columns])
    return without_existing(rows, stored_keys(batch, table), keys, stored_is_unique=True)


def _dealt(rows: DataFrame, table: str, with_hash: bool = False) -> DataFrame:
    """Rows with all columns of the table, one bucket to a task; columns that they lack are NULL.

    The hash hardly compresses, so it is made again behind the shuffle. Only ``with_hash`` it is shipped, and Spark takes
    the rows to lie by this column alone: a union with stored rows then has one task per bucket, not two.
    """
    spark = rows.sparkSession
    keys, buckets = layout(spark, table)
    target = spark.table(table)
    plain = [f for f in target.schema if f.name not in (KEY_HASH, MONTH_COLUMN)]
    full = rows.select(*[(named(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in plain])
    hashed = F.xxhash64(*[named(k) for k in keys])
    if with_hash:
        return full.withColumn(KEY_HASH, hashed).repartition(buckets, KEY_HASH)
    return full.repartition(buckets, hashed).withColumn(KEY_HASH, hashed)


def _sorted(dealt: DataFrame, table: str) -> DataFrame:
    """Dealt rows in the order of the table's files."""
    if not tables.is_by_month(dealt.sparkSession.table(table)):
        return dealt.sortWithinPartitions(KEY_HASH)
    return dealt.withColumn(MONTH_COLUMN, month_key("date")).sortWithinPartitions(MONTH_COLUMN, KEY_HASH)


def _in_layout(rows: DataFrame, table: str) -> DataFrame:
    """Rows as the table's files hold them."""
    return _sorted(_dealt(rows, table), table)


def _one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row per key. Where all keys have different hashes these are the rows as they come, which a shuffle of the hashes alone tells."""
    repeated = rows.groupBy(F.xxhash64(*[named(k) for k in keys]).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return rows if repeated.isEmpty() else first_per_key(rows, keys)


def _unique(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of the batch, with the key in the table's types."""
    typed = dict(zip(keys, _as_stored(stored, keys)))
    return _one_per_key(batch.select(*[typed.get(c, named(c)) for c in batch.columns]), keys)


def insert_new(batch: DataFrame, table: str) -> None:
    """Add one row per key that the table lacks. Stored rows stay as they are, so a repeated load adds nothing.

    The batch is reduced to one row per key first, which a hot key leaves with one row per task, and dealt to the buckets; there
    it meets the stored rows and is written, without another shuffle.
    """
    spark = batch.sparkSession
    keys, _ = layout(spark, table)
    target = spark.table(table)
    dealt = _dealt(_unique(batch, target, keys), table).withColumnsRenamed({KEY_HASH: "_sought"}).withColumn("_sought_key", row_key(keys))
    stored, _ = _touched(batch, target, keys)
    seen = stored.select(KEY_HASH, row_key(keys).alias("_key"))
    fresh = dealt.join(seen, _same_key(), "left_anti").drop("_sought_key").withColumnRenamed("_sought", KEY_HASH)
    _sorted(fresh, table).select(*[named(c) for c in target.columns]).write.insertInto(table)


def replace(batch: DataFrame, table: str) -> None:
    """One row per key of the batch takes the place of the stored rows with that key; others are added.

    Only the months of the batch are written anew, where the key has the date and so tells the month; else the whole table.
    The batch is reduced to one row per key first; then its keys and its rows are dealt to the buckets once each.
    """
    spark = batch.sparkSession
    keys, buckets = layout(spark, table)
    everything = spark.table(table)
    stored, months = _touched(batch, everything, keys)
    unique = _unique(batch, everything, keys)
    hashed = F.xxhash64(*[named(k) for k in keys])
    sought = unique.select(*[named(k) for k in keys]).repartition(buckets, hashed).select(hashed.alias("_sought"), row_key(keys).alias("_sought_key"))
    kept = stored.withColumn("_key", row_key(keys)).join(sought, _same_key(), "left_anti")
    # The batch alone is shuffled: what is kept still lies by buckets, as it was read.
    fresh = _sorted(_dealt(unique, table, with_hash=True), table)
    columns = [named(c) for c in everything.columns]
    rows = kept.select(*columns).unionByName(fresh.select(*columns))
    if months is None:
        _replace_all(rows, table)
    elif months:
        with tables.overwrite_mode(spark, "dynamic"):
            rows.write.insertInto(table, overwrite=True)


def _replace_all(rows: DataFrame, table: str) -> None:
    """Make ``rows``, which read the table, its content: they are staged before it is overwritten."""
    spark = rows.sparkSession
    stage = tables.sibling(table, "replace")
    try:
        rows.write.format("parquet").saveAsTable(stage)
        staged = _in_layout(spark.table(stage), table)
        with tables.overwrite_mode(spark, "static"):
            staged.select(*[named(c) for c in spark.table(table).columns]).write.insertInto(table, overwrite=True)
    finally:
        tables.drop_table(spark, stage)
