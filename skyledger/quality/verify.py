"""Verification runs: metrics to statuses and a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from skyledger.quality.constraints import Check, constraint_metrics, missing_columns
from skyledger.quality.rules import table_check
from skyledger.sources.files import literal_table

RESULT_SCHEMA = (
    "check STRING, check_level STRING, check_status STRING, constraint STRING, constraint_status STRING,"
    " constraint_message STRING"
)


@dataclass(frozen=True)
class Verification:
    """Outcome of a run: ``status`` is Success, Warning or Error; one result row per constraint."""

    status: str
    results: DataFrame
    rows: tuple[Row, ...]

    @property
    def passed(self) -> bool:
        return self.status == "Success"

    @property
    def failures(self) -> list[str]:
        return [r["constraint"] for r in self.rows if not r["passed"]]


def verify(df: DataFrame, checks: Sequence[Check]) -> Verification:
    """Compute all checks and decide. What reaches the driver is one row per constraint."""
    return verify_parts([(df, check) for check in checks], df.sparkSession)


def verify_parts(parts: Sequence[tuple[DataFrame, Check]], spark: SparkSession) -> Verification:
    """The same for checks that each have a relation of their own; checks of one relation are computed together."""
    relations: dict[int, tuple[DataFrame, list[Check]]] = {}
    for df, check in parts:
        relations.setdefault(id(df), (df, []))[1].append(check)
    rows: list[Row] = []
    for df, checks in relations.values():
        constraints = [c for check in checks for c in check.constraints]
        absent = missing_columns(df, constraints)
        if absent:
            raise ValueError(f"checks name columns the relation lacks: {', '.join(absent)}")
        rows += constraint_metrics(df, checks).orderBy("number").collect() if constraints else []
    return conclude(rows, spark)


def conclude(rows: Sequence[Row], spark: SparkSession) -> Verification:
    """The outcome of metric rows, however they were computed."""
    failed = {(r["check"], r["check_level"]) for r in rows if not r["passed"]}
    levels = {level for _, level in failed}
    status = "Error" if "Error" in levels else "Warning" if levels else "Success"
    report = [
        (
            r["check"],
            r["check_level"],
            r["check_level"] if (r["check"], r["check_level"]) in failed else "Success",
            r["constraint"],
            "Success" if r["passed"] else "Failure",
            "" if r["passed"] else _message(r["metric"]),
        )
        for r in rows
    ]
    return Verification(status, literal_table(spark, report, RESULT_SCHEMA), tuple(rows))


def _message(metric: float | None) -> str:
    return "no rows to check" if metric is None else f"value {metric} does not meet the requirement"


def check_table(df: DataFrame, table: str, rules: dict[str, dict] | None = None) -> Verification:
    """Run the configured check of a table on a relation; ValueError for a table without configuration."""
    outcome = verify(df, [table_check(table, rules)])
    print(f"Data quality of {table}: {outcome.status}")
    if not outcome.passed:
        outcome.results.where("constraint_status = 'Failure'").show(n=len(outcome.rows), truncate=False)
    return outcome
