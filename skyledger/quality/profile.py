"""Column profiles: one aggregation over all columns, and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StringType

from skyledger.functions.columns import named, ratio

# How NULL shows up in a histogram, the default percentiles, and the values up to which a profile has a histogram.
NULL_VALUE = "NullValue"
PERCENTILES = (0.25, 0.5, 0.75)
HISTOGRAM_VALUES = 120

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$"

TEXT_KINDS = ("Integral", "Fractional", "Boolean", "String")


def _code(kind: str) -> Column:
    return F.lit(TEXT_KINDS.index(kind))


def _prepared(name: str, kind: DataType, number: int) -> list[Column]:
    """The column as ``v``, its numeric value as ``x`` and, for text, what it reads as in ``k``."""
    value = named(name)
    if isinstance(kind, (IntegralType, FractionalType)):
        return [value.alias(f"v{number}"), value.cast("double").alias(f"x{number}")]
    if isinstance(kind, StringType):
        # Casting text that is no number is slow, so the pattern decides first.
        is_number = value.rlike(_NUMBER)
        reads_as = (
            F.when(value.isNull(), None)
            .when(is_number, F.when(value.contains("."), _code("Fractional")).otherwise(_code("Integral")))
            .when(F.lower(F.trim(value)).isin("true", "false"), _code("Boolean"))
            .otherwise(_code("String"))
        )
        return [
            value.alias(f"v{number}"),
            F.when(is_number, value.cast("double")).alias(f"x{number}"),
            reads_as.alias(f"k{number}"),
        ]
    return [value.alias(f"v{number}"), F.lit(None).cast("double").alias(f"x{number}")]


def _kind(kind: DataType, number: int) -> Column:
    """Type of the values: the declared one, or for text the narrowest that all of them read as."""
    if isinstance(kind, BooleanType):
        return F.lit("Boolean")
    if isinstance(kind, IntegralType):
        return F.lit("Integral")
    if isinstance(kind, FractionalType):
        return F.lit("Fractional")
    if not isinstance(kind, StringType):
        return F.lit("Unknown")
    first, last = F.min(f"k{number}"), F.max(f"k{number}")
    only = F.element_at(F.array(*[F.lit(k) for k in TEXT_KINDS]), last + 1)
    return (
        F.when(first.isNull(), "Unknown")
        .when(first == last, only)
        .when(last <= _code("Fractional"), "Fractional")
        .otherwise("String")
    )


def _profile(name: str, kind: DataType, number: int, approximate: bool, percentiles: Sequence[float]) -> Column:
    value, x = F.col(f"v{number}"), F.col(f"x{number}")
    value_kind = _kind(kind, number)

    def stat(expression: Column) -> Column:
        """Numbers of a text column count only if all its values are numbers."""
        is_text = isinstance(kind, StringType)
        return F.when(value_kind.isin("Integral", "Fractional"), expression) if is_text else expression

    numeric = isinstance(kind, (IntegralType, FractionalType, StringType))
    fields = [
        F.lit(name).alias("column_name"),
        value_kind.alias("data_type"),
        F.lit(isinstance(kind, StringType)).alias("type_inferred"),
        F.count(F.lit(1)).alias("row_count"),
        ratio(F.count(value), F.count(F.lit(1))).alias("completeness"),
        stat(F.min(x)).alias("minimum"),
        stat(F.max(x)).alias("maximum"),
        stat(F.avg(x)).alias("mean"),
        stat(F.stddev_pop(x)).alias("std_dev"),
        stat(F.sum(x)).alias("total"),
    ]
    if approximate:
        fields += [
            F.approx_count_distinct(value).alias("approx_distinct"),
            # No sketch is built for kinds of columns that hold no numbers.
            stat(F.percentile_approx(x, list(percentiles))).alias("percentiles")
            if numeric
            else F.lit(None).cast("array<double>").alias("percentiles"),
        ]
    return F.struct(*fields)


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approximate: bool = True,
    percentiles: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """One row per column: type, completeness and, for numbers, minimum, maximum, mean, deviation and sum.

    ``approximate`` adds the distinct-count sketch and the percentiles asked for. Everything is one pass.
    """
    kinds = [(c, df.schema[c].dataType) for c in columns or df.columns]
    prepared = df.select(*[expr for n, (c, kind) in enumerate(kinds) for expr in _prepared(c, kind, n)])
    rows = [_profile(c, kind, n, approximate, percentiles) for n, (c, kind) in enumerate(kinds)]
    return prepared.agg(F.array(*rows).alias("profiles")).select(F.inline("profiles"))


def histogram(df: DataFrame, columns: Sequence[str], null_flag: bool = False) -> DataFrame:
    """(column_name, value, absolute, fraction) for all given columns in one pass.

    Rows are counted per (column, value) ahead of the shuffle, so a value that most rows
    share costs no more than a rare one. The broadcast side has one row per given column. NULL shows up as "NullValue" in a row of its own;
    ``null_flag`` adds is_null, which tells it from a text that reads so.
    """
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(named(c).cast("string"), F.lit(NULL_VALUE)).alias("value"),
            named(c).isNull().alias("is_null"),
        )
        for c in columns
    ]
    key = ["column_name", "value", "is_null"]
    counts = df.select(F.inline(F.array(*pairs))).groupBy(*key).agg(F.count(F.lit(1)).alias("absolute"))
    rows = counts.groupBy("column_name").agg(F.sum("absolute").alias("_rows"))
    shown = key if null_flag else key[:2]
    return counts.join(F.broadcast(rows), "column_name").select(
        *shown, "absolute", ratio("absolute", "_rows").alias("fraction")
    )


def profile_with_histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    percentiles: Sequence[float] = PERCENTILES,
    most: int = HISTOGRAM_VALUES,
) -> DataFrame:
    """The profile, with ``histogram`` for columns of at most ``most`` values: an array of (value, is_null, absolute, fraction), most frequent first.

    The profile's distinct counts, one number per column, tell which columns may have so few; only their values are counted.
    """
    profiles = profile(df, columns, True, percentiles)
    found = profiles.collect()  # one row per column
    few = [r["column_name"] for r in found if r["approx_distinct"] <= 1.5 * most]
    facts = df.sparkSession.createDataFrame(found, profiles.schema)
    if not few:
        return facts.withColumn("histogram", F.lit(None).cast("array<struct<value:string,is_null:boolean,absolute:bigint,fraction:double>>"))
    counts = histogram(df, few, null_flag=True)
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") <= most)
    entry = F.struct((-F.col("absolute")).alias("order"), "value", "is_null", "absolute", "fraction")
    sorted_ = F.sort_array(F.collect_list(entry))  # ``most`` entries at most
    plain = F.transform(sorted_, lambda x: F.struct(x["value"].alias("value"), x["is_null"].alias("is_null"), x["absolute"].alias("absolute"), x["fraction"].alias("fraction")))
    histograms = counts.join(F.broadcast(sizes), "column_name").groupBy("column_name").agg(plain.alias("histogram"))
    return facts.join(F.broadcast(histograms), "column_name", "left")
