"""Published tables: creation, reading, layout, appends and deletes.

Tables are plain parquet tables of the session catalog. The fact table is laid out by month
of its date, so loads, deletes and comparisons touch only the months concerned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import month_key, named, quoted
from skyledger.operators.dedup import first_per_key
from skyledger.operators.existing import without_existing
from skyledger.schemas import MONTH_COLUMN, TABLES


def full_name(database: str, table: str) -> str:
    return f"{quoted(database)}.{quoted(table)}"


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and its six tables where they do not exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
    for table, spec in TABLES.items():
        create_table(spark, full_name(database, table), spec.ddl, spec.by_month)


def create_table(spark: SparkSession, table: str, ddl: str, by_month: bool) -> None:
    """Create an empty table of the given columns, unless it exists."""
    layout = f", {MONTH_COLUMN} STRING) USING parquet PARTITIONED BY ({MONTH_COLUMN})"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}" + (layout if by_month else ") USING parquet"))


def create_for(batch: DataFrame, table: str, by_month: bool | None = None) -> None:
    """Create an empty table for the batch: by contract if the name is one of the known tables, else of its columns."""
    name = base_name(table)
    spec = TABLES.get(name)
    if spec is not None and set(batch.columns) <= set(spec.columns):
        create_table(batch.sparkSession, table, spec.ddl, spec.by_month if by_month is None else by_month)
    else:
        columns = batch.drop(MONTH_COLUMN).schema
        ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in columns)
        create_table(batch.sparkSession, table, ddl, bool(by_month))


def base_name(table: str) -> str:
    """A table's name without its database."""
    return table.replace("`", "").split(".")[-1]


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def is_by_month(df: DataFrame) -> bool:
    return MONTH_COLUMN in df.columns


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A table's contract columns, without the layout column."""
    return spark.table(table).drop(MONTH_COLUMN)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def months_of(df: DataFrame) -> list[str | None]:
    """Distinct months in the layout column; one per month of data, whatever the number of rows."""
    return [row[0] for row in df.select(MONTH_COLUMN).distinct().collect()]


def stored_months(spark: SparkSession, table: str) -> list[str | None]:
    """Months a table laid out by month has partitions for, from the catalog alone; None for rows without a date."""
    values = [row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    return [value if value[:1].isdigit() else None for value in values]


def only_months(df: DataFrame, months: Sequence[str | None]) -> DataFrame:
    """Rows of the given months, as a predicate on the partition column: other partitions are not read."""
    condition = F.col(MONTH_COLUMN).isin([m for m in months if m is not None])
    return df.where(condition | F.col(MONTH_COLUMN).isNull() if None in months else condition)


def laid_out(df: DataFrame, by_month: bool) -> DataFrame:
    """Rows as they should be written.

    By month: a rebalancing shuffle brings a month's rows together for large files and AQE
    splits a month that is too big for one task; within a task rows are sorted for narrow
    row-group bounds. Otherwise rows stay where they are.
    """
    if not by_month:
        return df
    return _in_order(df.withColumn(MONTH_COLUMN, month_key("date")).hint("rebalance", MONTH_COLUMN))


def _in_order(dated: DataFrame) -> DataFrame:
    return dated.sortWithinPartitions(*[c for c in (MONTH_COLUMN, "date", "scheduled_departure") if c in dated.columns])


def append(df: DataFrame, table: str, arranged: bool = False) -> None:
    """Append rows by column name; columns the rows lack become NULL. Not idempotent.

    ``arranged`` rows are read from a table of the same layout and need no shuffle to be written.
    """
    target = df.sparkSession.table(table)
    absent = [f for f in target.schema if f.name not in df.columns and f.name != MONTH_COLUMN]
    full = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])
    by_month = is_by_month(target)
    if arranged and by_month:
        rows = full if is_by_month(full) else full.withColumn(MONTH_COLUMN, month_key("date"))
    else:
        rows = laid_out(full.drop(MONTH_COLUMN), by_month)
    rows.select(*[named(c) for c in target.columns]).write.insertInto(table)


def create_like(df: DataFrame, table: str, by_month: bool, arranged: DataFrame | None = None) -> None:
    """Write rows to a new table of their own columns, replacing one that is left from an earlier run.

    ``arranged`` are rows of other months, read from a table of the same layout: these are not shuffled.
    """
    drop_table(df.sparkSession, table)
    rows = laid_out(df.drop(MONTH_COLUMN), by_month)
    writer = (rows if arranged is None else rows.unionByName(arranged)).write.format("parquet")
    (writer.partitionBy(MONTH_COLUMN) if by_month else writer).saveAsTable(table)


def new_rows(df: DataFrame, table: str) -> tuple[DataFrame, bool]:
    """Rows that the table does not have in full, NULLs equal, and whether there are any.

    A table that does not exist has none of them.
    """
    spark = df.sparkSession
    fresh = without_existing(df, read_table(spark, table)) if spark.catalog.tableExists(table) else df
    return fresh, not fresh.isEmpty()


def write_new(df: DataFrame, table: str, mode: str = "append", keys: Sequence[str] | None = None) -> bool:
    """Idempotent write: False and no write when there is nothing new.

    ``append`` adds the rows the table lacks - whole rows, or with ``keys`` one row per key
    that it lacks. ``overwrite`` makes the rows the table's whole content. A missing table is
    created, by its contract if it is a known one. Errors are raised, also for another mode.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be append or overwrite, not {mode}")
    spark = df.sparkSession
    is_new = not spark.catalog.tableExists(table)
    if is_new:
        create_for(df, table)
    if mode == "overwrite":
        replace_content(df, table)
        return True
    if is_new:
        append(first_per_key(df, keys) if keys else df, table)
        return not spark.table(table).isEmpty()
    stored = read_table(spark, table).select(*[named(c) for c in df.columns])
    # A row whose key the table lacks is not among its rows, so with a key that comparison is enough.
    fresh = first_per_key(without_existing(df, stored, keys), keys) if keys else without_existing(df, stored)
    stage, by_month = sibling(table, "fresh"), is_by_month(spark.table(table))
    try:
        # Written once: whether there are any, and the append, read files.
        create_like(fresh, stage, by_month)
        staged = spark.table(stage)
        has_new = not staged.isEmpty()
        if has_new:
            append(staged, table, arranged=True)
        return has_new
    finally:
        drop_table(spark, stage)


def replace_content(df: DataFrame, table: str) -> None:
    """Make ``df`` the table's content. ``df`` may read the table: rows are staged before it is overwritten."""
    spark = df.sparkSession
    target = spark.table(table)
    stage = sibling(table, "replace")
    try:
        create_like(df, stage, is_by_month(target))
        with overwrite_mode(spark, "static"):
            spark.table(stage).select(*[named(c) for c in target.columns]).write.insertInto(table, overwrite=True)
    finally:
        drop_table(spark, stage)


def without_matching(df: DataFrame, condition: Column) -> DataFrame:
    """What a DELETE leaves: rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_where(
    spark: SparkSession,
    table: str,
    predicate: Column | str,
    before_write: Callable[[list[str | None]], None] | None = None,
) -> None:
    """Delete the rows that meet the predicate; rows where it is NULL stay.

    On a table laid out by month only the months with such rows are rewritten, and those
    left empty are dropped; ``before_write`` is told these months before anything is written.
    """
    stored = spark.table(table)
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    if not is_by_month(stored):
        replace_content(without_matching(stored, condition), table)
        return
    met = F.coalesce(condition, F.lit(False))
    found = stored.groupBy(MONTH_COLUMN).agg(F.bool_or(met).alias("some"), F.bool_and(met).alias("all")).where("some").collect()
    touched = [row[MONTH_COLUMN] for row in found]
    if not touched:
        return
    if before_write is not None:
        before_write(touched)
    survivors = without_matching(only_months(stored, touched), condition)
    replace_months(survivors, table, touched, [row[MONTH_COLUMN] for row in found if not row["all"]], arranged=True)


def replace_months(
    rows: DataFrame, table: str, months: Sequence[str | None], left: Sequence[str | None] | None = None, arranged: bool = False
) -> None:
    """Make ``rows`` the content of the given months; months that have none are dropped. ``rows`` may read the table.

    ``left`` are the months that ``rows`` has, if known; ``arranged`` rows are read from a table of the same layout.
    """
    left = months_of(rows) if left is None else left
    if left:
        overwrite_months(rows, table, arranged)
    for month in set(months) - set(left):
        value = "NULL" if month is None else f"'{month}'"
        rows.sparkSession.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({MONTH_COLUMN} = {value})")


def overwrite_months(rows: DataFrame, table: str, arranged: bool = False) -> None:
    """Replace the months that ``rows`` has by its rows and leave all others; ``rows`` may read the table.

    Spark writes all new files before it touches the old ones, so nothing is staged first. ``arranged`` rows are
    read from a table of the same layout and stay where they are.
    """
    target = rows.sparkSession.table(table)
    full = _in_order(rows) if arranged else laid_out(rows.drop(MONTH_COLUMN), True)
    with overwrite_mode(rows.sparkSession, "dynamic"):
        full.select(*[named(c) for c in target.columns]).write.insertInto(table, overwrite=True)


def switch_months(rows: DataFrame, table: str, arranged: DataFrame | None = None) -> list[str]:
    """Make ``rows`` the content of the months that they have, by the catalog: readers see a month as it was or as it becomes, never half of it.

    All months are written to a new folder beside the table first. Then the catalog's pointer of each partition is set to its new files,
    one statement per month. What was there before stays on disk for readers that have begun; these folders are
    given back, for the caller to remove when no reader is left. ``rows`` may read the table. ``arranged`` are
    rows of other months, read from a table of the same layout: these are not shuffled.
    """
    spark = rows.sparkSession
    target = spark.table(table)
    name = base_name(table)
    location = _location(spark, table)
    folder = f"{location.rstrip('/')}_versions/{name}-{uuid.uuid4().hex}"
    order = [named(c) for c in target.columns]
    full = laid_out(rows.drop(MONTH_COLUMN), True).select(*order)
    if arranged is not None:
        full = full.unionByName(arranged, allowMissingColumns=True).select(*order)
    full.write.partitionBy(MONTH_COLUMN).parquet(folder)
    known = set(stored_months(spark, table))
    replaced = []
    for month in sorted(months_of(spark.read.parquet(folder).select(F.col(MONTH_COLUMN).cast("string"))), key=lambda m: m or ""):
        value = "NULL" if month is None else f"'{month}'"
        path = f"{folder}/{MONTH_COLUMN}={'__HIVE_DEFAULT_PARTITION__' if month is None else month}"
        if month in known:
            replaced.append(_location(spark, table, value))
            spark.sql(f"ALTER TABLE {table} PARTITION ({MONTH_COLUMN} = {value}) SET LOCATION '{path}'")
        else:
            spark.sql(f"ALTER TABLE {table} ADD PARTITION ({MONTH_COLUMN} = {value}) LOCATION '{path}'")
    spark.catalog.refreshTable(table)
    return replaced


def _location(spark: SparkSession, table: str, month: str | None = None) -> str:
    """Folder of a table or of one of its months, from the catalog."""
    part = f" PARTITION ({MONTH_COLUMN} = {month})" if month else ""
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}{part}").collect()}
    return described["Location"]


@contextmanager
def overwrite_mode(spark: SparkSession, mode: str) -> Iterator[None]:
    """``static``: an overwrite replaces the whole table; ``dynamic``: only the partitions it writes to."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, mode)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def sibling(table: str, role: str) -> str:
    """Name of a helper table next to ``table``, another one in every call, so that two loads do not meet."""
    *database, name = table.replace("`", "").split(".")
    return ".".join(quoted(part) for part in (*database, f"{role}_{name}_{uuid.uuid4().hex[:12]}"))
