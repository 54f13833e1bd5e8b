"""Quality metrics from state kept per month: a load is audited against the whole table without reading it.

The state of a month has, for every constraint, how many of its rows there are and how many satisfy it; for a condition over aggregates
the counts and sums that it is made of; for a key with the date, which no other month can have, its rows and those whose key is their own.
All these add up over months. A key without the date needs its counts: these are stored per month and key, and summed over months. What
the metrics become with a load is found from the state of the other months and that of the touched months as they would be.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import month_key, named, ratio
from skyledger.plans.states import MonthlyState, Months
from skyledger.quality.constraints import Check, Constraint, described, key_counts, uniqueness_metric
from skyledger.schemas import MONTH_COLUMN

_ADDITIVE = re.compile(r"\b(count_if|count|sum)\s*\(")
_AGGREGATE = re.compile(r"\b(avg|mean|min|max|median|stddev\w*|var\w*|percentile\w*|approx\w*|first|last|any_value)\s*\(", re.IGNORECASE)


def additive_parts(condition: str) -> tuple[str, list[str]]:
    """The condition with ``p0``, ``p1`` ... in place of its counts and sums, and these; ValueError for other aggregates."""
    parts: list[str] = []
    out, at = "", 0
    while found := _ADDITIVE.search(condition, at):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(condition[end], 0)
            end += 1
        out += condition[at : found.start()] + f"p{len(parts)}"
        parts.append(condition[found.start() : end])
        at = end
    out += condition[at:]
    if not parts or _AGGREGATE.search(out):
        raise ValueError(f"not made of counts and sums alone: {condition}")
    return out, parts


class MetricStates:
    """State of a check's constraints beside a table laid out by month. Constraints against a relation of values have none."""

    def __init__(self, spark: SparkSession, facts: str, table: str, checks: Sequence[Check]) -> None:
        self.numbered = list(enumerate((check, c) for check in checks for c in check.constraints))
        if any(c.values is not None for _, (_, c) in self.numbered):
            raise ValueError("constraints against a relation have no state")
        self.wide_keys = list(dict.fromkeys(c.columns for _, (_, c) in self.numbered if c.is_uniqueness and "date" not in c.columns))
        # A key within a longer one has no state of its own: its counts are sums of the longer one's.
        self.stored_keys = [k for k in self.wide_keys if not any(set(k) < set(other) for other in self.wide_keys)]
        *database, name = table.split(".")
        beside = lambda role: ".".join([*database, f"{name.strip('`')}_{role}"])
        self.sums = MonthlyState(spark, facts, table, self.sums_of)
        self.keys = [MonthlyState(spark, facts, beside(f"key{self.wide_keys.index(k)}"), lambda rows, k=k: self.keys_of(rows, k)) for k in self.stored_keys]

    def sums_of(self, rows: DataFrame) -> DataFrame:
        """Per month one row of numbers: of all rows, and of each constraint."""
        numbers: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
        for n, (_, c) in self.numbered:
            if c.predicate is not None:
                numbers.append(F.count_if(F.expr(c.predicate)).alias(f"met{n}"))
            elif c.aggregate is not None:
                numbers += [F.coalesce(F.expr(part), F.lit(0)).cast("double" if part.startswith("sum") else "long").alias(f"part{n}_{k}") for k, part in enumerate(additive_parts(c.aggregate)[1])]
        sums = rows.groupBy(MONTH_COLUMN).agg(*numbers)
        for n, (_, c) in self.numbered:
            if c.is_uniqueness and "date" in c.columns:
                own = key_counts(rows, [MONTH_COLUMN, *c.columns]).groupBy(MONTH_COLUMN).agg(F.count_if(F.col("_rows") == 1).alias(f"own{n}"))
                sums = sums.join(own.withColumnRenamed(MONTH_COLUMN, "_month"), F.col(MONTH_COLUMN).eqNullSafe(F.col("_month")), "left").drop("_month")
        return sums.select(*[named(c) for c in sums.columns if c != MONTH_COLUMN], MONTH_COLUMN)

    @staticmethod
    def keys_of(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
        counts = key_counts(rows, [MONTH_COLUMN, *key])
        return counts.select(*[named(c) for c in key], "_rows", MONTH_COLUMN)

    def note(self, months: Months) -> None:
        for state in (self.sums, *self.keys):
            state.note(months)

    def refresh(self) -> list[str | None]:
        months = [state.refresh() for state in (self.sums, *self.keys)]
        return months[0]

    def metrics(self) -> DataFrame:
        """What `constraint_metrics` gives for the whole table, from the state alone."""
        return self._evaluated(self.sums.read(), [state.read() for state in self.keys])

    def metrics_after(self, rows: DataFrame, months: Months) -> DataFrame:
        """The same as it would be with ``rows`` for all content of the given months; no other month of the table is read."""
        dated = rows.drop(MONTH_COLUMN).withColumn(MONTH_COLUMN, month_key("date"))
        month = F.col(MONTH_COLUMN)
        touched = month.isin([m for m in months if m is not None])
        touched = F.coalesce(touched, F.lit(None in months)) if months else F.lit(False)

        def with_new(state: MonthlyState) -> DataFrame:
            made = state.make(dated)
            if not state.spark.catalog.tableExists(state.table):
                return made
            return state.read().where(~touched).unionByName(made)

        return self._evaluated(with_new(self.sums), [with_new(state) for state in self.keys])

    def _evaluated(self, sums: DataFrame, keys: Sequence[DataFrame]) -> DataFrame:
        totals = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != MONTH_COLUMN])
        rows = [described(n, check, c, self._metric(n, c)) for n, (check, c) in self.numbered if not (c.is_uniqueness and "date" not in c.columns)]
        parts = [totals.select(F.inline(F.array(*rows)))] if rows else []
        for key in self.wide_keys:
            counts = next(state for stored, state in zip(self.stored_keys, keys) if set(key) <= set(stored))
            users = [described(n, check, c, F.col("metric")) for n, (check, c) in self.numbered if c.is_uniqueness and c.columns == key]
            parts.append(uniqueness_metric(key_counts(counts, key)).select(F.inline(F.array(*users))))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    @staticmethod
    def _metric(n: int, c: Constraint) -> Column:
        if c.is_uniqueness:
            return ratio(f"own{n}", "n_rows")
        if c.aggregate is None:
            return ratio(f"met{n}", "n_rows")
        condition, parts = additive_parts(c.aggregate)
        for k in reversed(range(len(parts))):
            condition = re.sub(rf"\bp{k}\b", f"part{n}_{k}", condition)
        return F.when(F.col("n_rows") > 0, F.expr(condition).cast("int").cast("double"))
