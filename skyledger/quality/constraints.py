"""Constraints and checks, and their metrics as aggregate expressions.

A constraint has a metric between 0 and 1, the fraction of rows (or keys) that satisfy it,
and an assertion on the metric. All row-level metrics of a verification are computed by one
aggregation in one pass; only uniqueness needs its own grouping, one per longest key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import named, quoted, ratio

Assertion = Callable[[Column], Column]


def fully(metric: Column) -> Column:
    return metric == 1.0


def at_least(fraction: float) -> Assertion:
    return lambda metric: metric >= fraction


@dataclass(frozen=True)
class Constraint:
    """``predicate`` is SQL over a row, ``aggregate`` SQL over the whole relation, ``values`` a relation; uniqueness has none."""

    rule: str
    columns: tuple[str, ...]
    detail: str
    predicate: str | None = None
    aggregate: str | None = None
    assertion: Assertion = fully
    values: DataFrame | None = None

    @property
    def label(self) -> str:
        return f"{self.rule}({', '.join(self.columns)}): {self.detail}"

    @property
    def is_uniqueness(self) -> bool:
        return self.predicate is None and self.aggregate is None and self.values is None


def text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def uniqueness(columns: Sequence[str], assertion: Assertion = fully) -> Constraint:
    """Fraction of rows whose key occurs once; NULL keys count as a value."""
    return Constraint("uniqueness", tuple(columns), "each key occurs once", assertion=assertion)


def completeness(column: str, assertion: Assertion = fully) -> Constraint:
    return Constraint("completeness", (column,), "is not NULL", f"{quoted(column)} IS NOT NULL", assertion=assertion)


def non_negative(column: str, assertion: Assertion = fully) -> Constraint:
    """NULL passes. Numbers are compared as they are; text has to read as a number, also one that fits no integer."""
    value = quoted(column)
    predicate = (
        f"CASE WHEN {value} IS NULL THEN TRUE"
        f" WHEN typeof({value}) = 'string' THEN COALESCE(TRY_CAST({value} AS DOUBLE) >= 0, FALSE)"
        f" ELSE {value} >= 0 END"
    )
    return Constraint("non_negative", (column,), "is non-negative", predicate, assertion=assertion)


def contained_in(column: str, values: Sequence[object], assertion: Assertion = fully) -> Constraint:
    """NULL passes. Fractional columns are compared as numbers, all others as text, so flags may be listed as strings."""
    value = quoted(column)
    listed = ", ".join(text(v) for v in values)
    numbers = ", ".join(f"TRY_CAST({text(v)} AS DOUBLE)" for v in values)
    predicate = (
        f"CASE WHEN {value} IS NULL THEN TRUE"
        f" WHEN typeof({value}) IN ('double', 'float') OR typeof({value}) LIKE 'decimal%'"
        f" THEN COALESCE(TRY_CAST({value} AS DOUBLE) IN ({numbers}), FALSE)"
        f" ELSE CAST({value} AS STRING) IN ({listed}) END"
    )
    detail = f"contained in {','.join(str(v) for v in values)}"
    return Constraint("containment", (column,), detail, predicate, assertion=assertion)


def contained_in_relation(column: str, values: DataFrame, count: int, assertion: Assertion = fully) -> Constraint:
    """NULL passes. ``values`` has one text column without repeats; with many values it is joined, never listed."""
    return Constraint("containment", (column,), f"contained in {count} values", assertion=assertion, values=values)


def in_range(column: str, low: float, high: float, assertion: Assertion = fully) -> Constraint:
    """Both ends included, NULL passes."""
    predicate = f"{quoted(column)} IS NULL OR {quoted(column)} BETWEEN {low} AND {high}"
    return Constraint("range", (column,), f"between {low} and {high}", predicate, assertion=assertion)


def matches(column: str, pattern: str, assertion: Assertion = fully) -> Constraint:
    """The whole value matches the regular expression; NULL passes."""
    predicate = f"{quoted(column)} IS NULL OR {quoted(column)} RLIKE {text(rf'\A(?:{pattern})\z')}"
    return Constraint("pattern", (column,), f"matches {pattern}", predicate, assertion=assertion)


def castable(column: str, kind: str, assertion: Assertion = fully) -> Constraint:
    """Text that reads as a value of the SQL type; NULL passes."""
    predicate = f"{quoted(column)} IS NULL OR TRY_CAST({quoted(column)} AS {kind}) IS NOT NULL"
    return Constraint("type", (column,), f"reads as {kind}", predicate, assertion=assertion)


def satisfies(columns: Sequence[str], condition: str, assertion: Assertion = fully) -> Constraint:
    """SQL condition over a row; a row where it is NULL passes."""
    return Constraint("predicate", tuple(columns), condition, f"COALESCE({condition}, TRUE)", assertion=assertion)


def holds_overall(columns: Sequence[str], condition: str) -> Constraint:
    """SQL condition over aggregates of the whole relation."""
    return Constraint("aggregate", tuple(columns), condition, aggregate=condition)


@dataclass(frozen=True)
class Check:
    """Named group of constraints; a failed one makes the verification end in the check's level."""

    name: str
    constraints: tuple[Constraint, ...] = field(default_factory=tuple)
    level: str = "Error"

    def and_also(self, *more: Constraint) -> Check:
        return Check(self.name, (*self.constraints, *more), self.level)


def missing_columns(df: DataFrame, constraints: Sequence[Constraint]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return sorted({c for k in constraints for c in k.columns if c.lower() not in have})


def row_metric(constraint: Constraint) -> Column:
    """Metric of a row-level or aggregate constraint, NULL over no rows."""
    if constraint.aggregate is not None:
        return F.when(F.count(F.lit(1)) > 0, F.expr(constraint.aggregate).cast("int").cast("double"))
    return ratio(F.count_if(F.expr(constraint.predicate)), F.count(F.lit(1)))


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per key as ``_rows``, from rows or from the counts of a longer key."""
    counted = F.sum("_rows") if "_rows" in df.columns else F.count(F.lit(1))
    return df.groupBy(*[named(c) for c in columns]).agg(counted.alias("_rows"))


def nested_key_counts(df: DataFrame, keys: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], DataFrame]:
    """Rows per key for each key: the relation is counted once per longest key, keys within it are summed from those counts."""
    counts: dict[tuple[str, ...], DataFrame] = {}
    for key in sorted(keys, key=len, reverse=True):
        longer = [k for k in counts if set(key) < set(k)]
        counts[key] = key_counts(counts[min(longer, key=len)] if longer else df, key)
    return counts


def uniqueness_metric(counts: DataFrame) -> DataFrame:
    """One row ``metric``: rows with a key of their own among all rows, from `key_counts`."""
    return counts.agg(ratio(F.count_if(F.col("_rows") == 1), F.sum("_rows")).alias("metric"))


def containment_metrics(df: DataFrame, relations: dict[int, tuple[str, DataFrame]]) -> DataFrame:
    """One row with a column ``m<number>`` per numbered (column, relation of values): rows whose value is NULL or in the relation among all rows.

    All columns are counted per value in one pass; what meets the relations is one row per column and value.
    """
    columns = list(dict.fromkeys(column for column, _ in relations.values()))
    pairs = [F.struct(F.lit(k).alias("_column"), named(c).cast("string").alias("_value")) for k, c in enumerate(columns)]
    counts = df.select(F.inline(F.array(*pairs))).groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("_rows"))
    users = [F.array(*[F.lit(n) for n, (column, _) in relations.items() if column == c]) for c in columns]
    sought = counts.select(F.explode(F.element_at(F.array(*users), F.col("_column") + 1)).alias("_number"), "_value", "_rows")
    known = None
    for n, (_, values) in relations.items():
        part = values.select(F.lit(n).alias("_of"), F.col(quoted(values.columns[0])).cast("string").alias("_known"))
        known = part if known is None else known.unionByName(part)
    joined = sought.join(known, (F.col("_number") == F.col("_of")) & (F.col("_value") == F.col("_known")), "left")
    inside = F.when(F.col("_value").isNull() | F.col("_known").isNotNull(), F.col("_rows")).otherwise(0)
    own = lambda n, rows: F.sum(F.when(F.col("_number") == n, rows))
    return joined.agg(*[ratio(own(n, inside), own(n, F.col("_rows"))).alias(f"m{n}") for n in relations])


def described(number: int, check: Check, constraint: Constraint, metric: Column) -> Column:
    return F.struct(
        F.lit(number).alias("number"),
        F.lit(check.name).alias("check"),
        F.lit(check.level).alias("check_level"),
        F.lit(constraint.rule).alias("rule"),
        F.lit(", ".join(constraint.columns)).alias("columns"),
        F.lit(constraint.label).alias("constraint"),
        metric.alias("metric"),
        F.coalesce(constraint.assertion(metric), F.lit(False)).alias("passed"),
    )


def constraint_metrics(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per constraint: check, check_level, rule, columns, constraint, metric, passed. Lazy.

    The relation is read once for all row-level constraints together and once per key set that lies within no other,
    and once for all constraints against relations.
    """
    numbered = list(enumerate((check, constraint) for check in checks for constraint in check.constraints))
    parts = []
    plain = [(n, check, c) for n, (check, c) in numbered if not c.is_uniqueness and c.values is None]
    if plain:
        metrics = df.agg(*[row_metric(c).alias(f"m{n}") for n, _, c in plain])
        rows = F.array(*[described(n, check, c, F.col(f"m{n}")) for n, check, c in plain])
        parts.append(metrics.select(F.inline(rows)))
    keys: dict[tuple[str, ...], list[tuple[int, Check, Constraint]]] = {}
    for n, (check, c) in numbered:
        if c.is_uniqueness:
            keys.setdefault(c.columns, []).append((n, check, c))
    counts = nested_key_counts(df, list(keys))
    for columns, users in keys.items():
        rows = F.array(*[described(n, check, c, F.col("metric")) for n, check, c in users])
        parts.append(uniqueness_metric(counts[columns]).select(F.inline(rows)))
    related = {n: (check, c) for n, (check, c) in numbered if c.values is not None}
    if related:
        metrics = containment_metrics(df, {n: (c.columns[0], c.values) for n, (_, c) in related.items()})
        rows = F.array(*[described(n, check, c, F.col(f"m{n}")) for n, (check, c) in related.items()])
        parts.append(metrics.select(F.inline(rows)))
    if not parts:
        raise ValueError("no constraints to compute")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
