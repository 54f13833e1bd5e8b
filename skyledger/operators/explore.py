"""Exploration: null profiles, counts, samples, anomaly probes and partition statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import as_column, delay_flag, named, ratio
from skyledger.operators.reshape import to_long
from skyledger.schemas import MONTH_COLUMN


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: NULLs per column, counted in one pass."""
    return df.select(*[F.count_if(named(c).isNull()).alias(c) for c in columns or df.columns])


def nulls_by_condition(df: DataFrame, condition: Column | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column with NULLs: how many, and how many of them in rows that meet the condition.

    One aggregation over all columns, whatever their number; the single wide row is then
    unfolded into (column_name, null_rows, null_rows_matching).
    """
    names = list(columns or df.columns)
    meets = F.expr(condition) if isinstance(condition, str) else condition
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(named(c).isNull()).alias("null_rows"),
            F.count_if(named(c).isNull() & meets).alias("null_rows_matching"),
        )
        for c in names
    ]
    return df.agg(F.array(*pairs).alias("per_column")).selectExpr("inline(per_column)").where("null_rows > 0")


def flight_counts(flights: DataFrame) -> DataFrame:
    """All, cancelled and (where the column exists) diverted flights in one row."""
    flags = [c for c in ("cancelled", "diverted") if c in flights.columns]
    return flights.agg(
        F.count(F.lit(1)).alias("flights"), *[F.count_if(named(c) == 1).alias(f"{c}_flights") for c in flags]
    )


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def delay_by(flights: DataFrame, *dimensions: str) -> DataFrame:
    """Volume, delayed flights and their share per group."""
    late = F.count_if(F.col("is_delayed") == 1)
    counted = flights.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("total_flights"), late.alias("delayed_flights"))
    return counted.withColumn("delayed_rate", ratio("delayed_flights", "total_flights"))


def late_departures_by(flights: DataFrame, *dimensions: str) -> DataFrame:
    """Flights that left late, per group; groups without one do not appear."""
    return flights.where(delay_flag() == 1).groupBy(*dimensions).agg(F.count(F.lit(1)).alias("delayed_flights"))


# Probes for rows that contradict themselves.
ANOMALIES = {
    "reason_without_cancellation": "cancelled = 0 AND cancellation_reason IS NOT NULL",
    "cancelled_after_pushback": "cancelled = 1 AND departure_delay IS NOT NULL",
    "diverted_with_arrival_delay": "diverted = 1 AND arrival_delay IS NOT NULL",
    "scheduled_time_missing": "scheduled_time IS NULL",
}


def anomaly_counts(df: DataFrame, probes: dict[str, str] | None = None) -> DataFrame:
    """(probe, row_count): rows that meet each probe, all probes in one pass."""
    chosen = probes or ANOMALIES
    counted = df.agg(*[F.count_if(F.expr(condition)).alias(name) for name, condition in chosen.items()])
    return to_long(counted, list(chosen), "probe", "row_count")


def anomalous_rows(df: DataFrame, probe: str) -> DataFrame:
    return df.where(ANOMALIES.get(probe, probe))


def in_month(df: DataFrame, year: int, month: int, date: str = "date") -> DataFrame:
    """Rows of one calendar month; on a table laid out by month only that partition is read."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    rows = df.where((F.col(date) >= start) & (F.col(date) <= F.last_day(start)))
    return rows.where(F.col(MONTH_COLUMN) == f"{year:04d}-{month:02d}") if MONTH_COLUMN in df.columns else rows


def random_sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def key_sample(df: DataFrame, keys: Sequence[str], percent: int) -> DataFrame:
    """About ``percent`` % of the keys with all their rows, the same ones whenever and wherever it runs."""
    return df.where(F.pmod(F.xxhash64(*[named(k) for k in keys]), F.lit(100)) < percent)


def sample_per_group(df: DataFrame, groups: Sequence[str], k: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``k`` rows of every group (all, if it has fewer): those whose key has the smallest seeded hash, the same ones in every run.

    Equal keys are ordered by the other columns. Spark limits each group ahead of the shuffle, so a task sends on ``k`` rows of a group, whatever its size.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(named(c).cast("string"), F.lit("")) for c in keys])
    rest = [named(c).asc_nulls_first() for c in df.columns if c not in keys]
    place = Window.partitionBy(*[named(g) for g in groups]).orderBy(F.md5(text), *rest)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")


def partition_stats(df: DataFrame, column: str, partition: Column | str = MONTH_COLUMN) -> DataFrame:
    """Rows, NULLs and bounds of a column per partition."""
    part, value = as_column(partition), named(column)
    return df.groupBy(part.alias("partition")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(value.isNull()).alias("null_count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def file_stats(df: DataFrame) -> DataFrame:
    """Rows and bytes of every file behind a file relation."""
    where = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_bytes"))
    return where.groupBy("file_path").agg(F.count(F.lit(1)).alias("row_count"), F.max("file_bytes").alias("file_bytes"))


def total_bytes(df: DataFrame) -> DataFrame:
    """Number of files and their bytes in one row."""
    return file_stats(df).agg(F.count(F.lit(1)).alias("files"), F.sum("file_bytes").alias("total_bytes"))
