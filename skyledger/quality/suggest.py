"""Constraint suggestions from column profiles.

Spark computes the profile, the counts of all values of text columns and, from these, the shares that the rules go by;
the driver gets one row of facts per column, whatever the number of values. The values of a suggested range stay a relation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from skyledger.quality import constraints as c
from skyledger.quality.profile import histogram, profile
from skyledger.sources.files import literal_table, written_once

# Thresholds of the rules.
LOWEST_RETAINED_COMPLETENESS = 0.2
CONFIDENCE_Z = 1.96
CATEGORICAL_SINGLETONS = 0.1
FRACTIONAL_SINGLETONS = 0.4
FRACTIONAL_COVERAGE = 0.9
SQL_TYPE = {"Integral": "BIGINT", "Fractional": "DOUBLE", "Boolean": "BOOLEAN"}

SUGGESTION_SCHEMA = (
    "column_name STRING, rule STRING, description STRING, current_value STRING, constraint STRING, code STRING"
)


@dataclass(frozen=True)
class ColumnFacts:
    """A profile row and, for text, what the counts of the column's values come to.

    ``values`` is the relation of its values (value, absolute), NULL left out; ``facts`` has the number of distinct ones,
    NULL being one of them, the number that occur once, and for the most frequent ones that together reach the wanted
    coverage (values of equal count all in) their least count, number and rows.
    """

    profile: Row
    facts: Row | None = None
    values: DataFrame | None = None

    @property
    def name(self) -> str:
        return self.profile["column_name"]

    @property
    def singletons(self) -> float:
        """Share of the distinct values that occur only once."""
        return self.facts["singles"] / self.facts["distinct_values"]

    @property
    def is_category(self) -> bool:
        return self.profile["data_type"] == "String" and self.facts is not None


@dataclass(frozen=True)
class Suggestion:
    column: str
    rule: str
    description: str
    current: str
    constraint: c.Constraint
    code: str


def _lower_bound(share: float, rows: int) -> float:
    """Lower end of the share's confidence interval, rounded down to two digits."""
    margin = CONFIDENCE_Z * math.sqrt(share * (1 - share) / rows)
    return max(math.floor((share - margin) * 100) / 100, 0.0)


def complete_if_complete(facts: ColumnFacts) -> Suggestion | None:
    if facts.profile["completeness"] != 1.0:
        return None
    return Suggestion(
        facts.name, "complete_if_complete", f"{facts.name} is not NULL", "completeness 1.0",
        c.completeness(facts.name), f"completeness({facts.name!r})",
    )


def retain_completeness(facts: ColumnFacts) -> Suggestion | None:
    share = facts.profile["completeness"]
    if share is None or not LOWEST_RETAINED_COMPLETENESS < share < 1.0:
        return None
    bound = _lower_bound(share, facts.profile["row_count"])
    return Suggestion(
        facts.name, "retain_completeness", f"{facts.name} has at most {1 - bound:.0%} NULLs", f"completeness {share}",
        c.completeness(facts.name, c.at_least(bound)), f"completeness({facts.name!r}, at_least({bound}))",
    )


def retain_type(facts: ColumnFacts) -> Suggestion | None:
    kind = facts.profile["data_type"]
    if not facts.profile["type_inferred"] or kind not in SQL_TYPE:
        return None
    return Suggestion(
        facts.name, "retain_type", f"{facts.name} reads as {kind}", f"type {kind}",
        c.castable(facts.name, SQL_TYPE[kind]), f"castable({facts.name!r}, {SQL_TYPE[kind]!r})",
    )


def categorical_range(facts: ColumnFacts) -> Suggestion | None:
    if not facts.is_category or facts.singletons > CATEGORICAL_SINGLETONS:
        return None
    count = facts.facts["distinct_values"] - facts.facts["null_values"]
    return Suggestion(
        facts.name, "categorical_range", f"{facts.name} has a value range of {count} values", "compliance 1",
        c.contained_in_relation(facts.name, facts.values.select("value"), count),
        f"contained_in_relation({facts.name!r}, values, {count})",
    )


def fractional_categorical_range(facts: ColumnFacts) -> Suggestion | None:
    if not facts.is_category or facts.singletons > FRACTIONAL_SINGLETONS:
        return None
    found = facts.facts
    if found["top_values"] == found["distinct_values"]:
        return None
    covered = found["top_rows"] / facts.profile["row_count"]
    bound = _lower_bound(covered, facts.profile["row_count"])
    count = found["top_values"] - found["top_null"]
    values = facts.values.where(F.col("absolute") >= found["least"]).select("value")
    return Suggestion(
        facts.name, "fractional_categorical_range", f"{facts.name} has mostly one of {count} values",
        f"compliance {covered}", c.contained_in_relation(facts.name, values, count, c.at_least(bound)),
        f"contained_in_relation({facts.name!r}, values, {count}, at_least({bound}))",
    )


def non_negative_numbers(facts: ColumnFacts) -> Suggestion | None:
    lowest = facts.profile["minimum"]
    if lowest is None or lowest < 0:
        return None
    return Suggestion(
        facts.name, "non_negative_numbers", f"{facts.name} has no negative values", f"minimum {lowest}",
        c.non_negative(facts.name), f"non_negative({facts.name!r})",
    )


Rule = Callable[[ColumnFacts], Suggestion | None]

DEFAULT_RULES: tuple[Rule, ...] = (
    complete_if_complete,
    retain_completeness,
    retain_type,
    categorical_range,
    fractional_categorical_range,
    non_negative_numbers,
)


def category_facts(counts: DataFrame) -> DataFrame:
    """One row per column from the counts of its values (column_name, value, is_null, absolute).

    Values are gathered by their count first; a column of n rows has at most about the root of 2 n different counts.
    """
    is_null = F.col("is_null").cast("long")
    by_count = counts.groupBy("column_name", "absolute").agg(F.count(F.lit(1)).alias("n"), F.sum(is_null).alias("nulls"))
    from_above = Window.partitionBy("column_name").orderBy(F.desc("absolute"))
    rows = F.col("n") * F.col("absolute")
    before = F.coalesce(F.sum(rows).over(from_above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = by_count.select("*", before.alias("before"), F.sum(rows).over(Window.partitionBy("column_name")).alias("rows"))
    top = F.col("before") < FRACTIONAL_COVERAGE * F.col("rows")
    return summed.groupBy("column_name").agg(
        F.sum("n").alias("distinct_values"),
        F.sum("nulls").alias("null_values"),
        F.coalesce(F.sum(F.when(F.col("absolute") == 1, F.col("n"))), F.lit(0)).alias("singles"),
        F.min(F.when(top, F.col("absolute"))).alias("least"),
        F.sum(F.when(top, F.col("n"))).alias("top_values"),
        F.sum(F.when(top, F.col("nulls"))).alias("top_null"),
        F.sum(F.when(top, rows)).alias("top_rows"),
    )


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> list[ColumnFacts]:
    """Profiles of the columns, and what the values of text columns come to; two passes, the second over text only.

    The counts of the values are written once: facts and ranges are read from these.
    """
    profiles = profile(df, columns).collect()
    texts = [p["column_name"] for p in profiles if p["data_type"] == "String"]
    found = {}
    if texts:
        counts = written_once(histogram(df, texts, null_flag=True), "value-counts")
        found = {row["column_name"]: row for row in category_facts(counts).collect()}

    def values(name: str) -> DataFrame:
        return counts.where((F.col("column_name") == name) & ~F.col("is_null")).select("value", "absolute")

    return [
        ColumnFacts(p, found[p["column_name"]], values(p["column_name"])) if p["column_name"] in found else ColumnFacts(p)
        for p in profiles
    ]


def suggest(
    df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, columns: Sequence[str] | None = None
) -> list[Suggestion]:
    """Constraints that the data at hand meets and that are likely meant to hold."""
    proposals = [rule(facts) for facts in column_facts(df, columns) for rule in rules]
    return [p for p in proposals if p is not None]


def suggestions_table(
    df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, columns: Sequence[str] | None = None
) -> DataFrame:
    found = suggest(df, rules, columns)
    rows = [(s.column, s.rule, s.description, s.current, s.constraint.label, s.code) for s in found]
    return literal_table(df.sparkSession, rows, SUGGESTION_SCHEMA)


def evaluated(
    df: DataFrame,
    is_held_out: Column,
    rules: Sequence[Rule] = DEFAULT_RULES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Suggestions from the rows that are not held out, each with its share of the rows that are: column_name, rule, constraint, share, passed.

    A rule that only repeats the accidents of the rows it came from shows here. ``is_held_out`` should follow from the row itself, as
    a hash of its key does, so that both parts are the same in every run.
    """
    known, other = df.where(~is_held_out), df.where(is_held_out)
    found = suggest(known, rules, columns)
    check = c.Check("suggestions", tuple(s.constraint for s in found))
    names = [(n, s.column, s.rule) for n, s in enumerate(found)]
    labels = literal_table(df.sparkSession, names, "number INT, column_name STRING, rule STRING")
    metrics = c.constraint_metrics(other, [check]).select("number", "constraint", F.col("metric").alias("share"), "passed")
    return metrics.join(F.broadcast(labels), "number").select("column_name", "rule", "constraint", "share", "passed")
