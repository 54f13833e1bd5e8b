"""Column profiles from sketches that add up: percentiles by KLL, distinct counts by HLL, kept per part of a table and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from skyledger.functions.columns import named, ratio

KLL_K = 400
HLL_LG_K = 12


def rank_error(k: int = KLL_K) -> float:
    """Rank error that a KLL sketch stays within in 99 of 100 cases."""
    return 2.296 / k**0.9723


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """Relative standard error of an HLL sketch's distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def column_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = KLL_K, lg_k: int = HLL_LG_K) -> DataFrame:
    """Per group of ``by`` and column: n_rows, n_nulls, numbers (KLL sketch; NULL for columns that aren't numeric, or without a value) and values (HLL sketch).

    All columns are sketched in one pass, with map-side combine: what is shuffled is sketches, a few kilobytes per group, column and task.
    """
    entries = []
    for c in columns:
        kind = df.schema[c].dataType
        numeric = isinstance(kind, (IntegralType, FractionalType))
        numbers = F.kll_sketch_agg_double(named(c).cast("double"), k) if numeric else F.lit(None).cast("binary")
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(named(c).isNull()).alias("n_nulls"),
                F.when(F.count(named(c)) > 0, numbers).alias("numbers"),
                F.hll_sketch_agg(named(c).cast("string"), lg_k).alias("values"),
            )
        )
    grouped = df.groupBy(*[named(c) for c in by]).agg(F.array(*entries).alias("sketches"))
    return grouped.select(F.inline("sketches"), *[named(c) for c in by])


def merged_profile(sketches: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """One row per column from the sketches of all parts: row_count, completeness, approx_distinct, minimum, maximum and the percentiles asked for."""
    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("row_count"),
        F.sum("n_nulls").alias("n_nulls"),
        F.kll_merge_agg_double("numbers").alias("numbers"),
        F.count("numbers").alias("_with_numbers"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("approx_distinct"),
    )

    def at(ranks: Column) -> Column:
        return F.when(F.col("_with_numbers") > 0, F.kll_sketch_get_quantile_double("numbers", ranks))

    return merged.select(
        "column_name",
        "row_count",
        ratio(F.col("row_count") - F.col("n_nulls"), "row_count").alias("completeness"),
        "approx_distinct",
        at(F.lit(0.0)).alias("minimum"),
        at(F.lit(1.0)).alias("maximum"),
        at(F.array(*[F.lit(float(p)) for p in percentiles])).alias("percentiles"),
    )
