"""Write-audit-publish: rows are staged, checked and only then added to the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from skyledger.functions.columns import named, quoted
from skyledger.operators.existing import merge_replace, without_existing
from skyledger.plans.metrics import MetricStates
from skyledger.quality.constraints import Check, Constraint, fully
from skyledger.quality.rules import TABLE_RULES, table_check
from skyledger.quality.verify import Verification, conclude, verify_parts
from skyledger.schemas import MONTH_COLUMN, TABLES
from skyledger.sources.tables import (
    append,
    base_name,
    create_for,
    create_like,
    drop_table,
    is_by_month,
    only_months,
    overwrite_months,
    read_table,
    replace_content,
    sibling,
    stored_months,
    switch_months,
)


class AuditFailed(ValueError):
    """Staged rows did not pass; the table is as it was."""

    def __init__(self, table: str, outcome: Verification):
        super().__init__(f"{table}: publishing aborted, {len(outcome.failures)} checks failed: {outcome.failures}")
        self.outcome = outcome


def write_audit_publish(
    batch: DataFrame,
    table: str,
    keys: Sequence[str] | None = None,
    mode: str = "insert_only",
    rules: dict[str, dict] | None = None,
    audit_scope: str = "months",
    by_month: bool | None = None,
    before_write: Callable[[list[str | None]], None] | None = None,
    switch: bool = False,
) -> bool:
    """Stage, audit, publish. True when rows were published, False when there was nothing new.

    ``insert_only`` adds the rows whose key the table lacks; a stored row with the same
    key stays, also if its values differ. ``replace`` lets the batch's rows take the place of
    stored ones with the same key. ``sync`` makes the batch the table's whole content, so rows that it no
    longer has go. Keys are compared null-safely, so rolled-up rows of the aggregate match. A table
    that does not exist is created when rows are published, never before, by its contract if it
    is a known one.

    The audit sees the table as it would be. With ``audit_scope="months"``, a table laid out
    by month and the date in its key, constraints for which that is exact see only the months the batch
    touches: predicates that every row has to meet and uniqueness of keys with the date, as what is
    stored has passed them before. All others - tolerances, aggregates, keys without the date -
    see the whole table in either scope. ``audit_scope="state"`` keeps the metrics' state per month in a table beside
    this one, so these too are exact and yet only the touched months are read; a table that has none yet is read once.

    Stored rows are unique in their key, having passed the audit or replaced their
    predecessors, so the comparison shuffles them as they are.

    The batch is computed once, into a staging table next to the target; everything after
    that reads files, so a lost executor costs no recomputation of the batch. The staging tables have
    names of their own in every load and are dropped in any case. After a crash during the final
    append, running the load again completes it, as rows already there are not added twice.

    With ``switch``, a table laid out by month whose key has the date gets its new state of the touched months in new files, and the
    catalog is then pointed to them month by month: a reader never sees half a month. It costs writing the touched months anew.

    ``before_write`` is told the months that the rows to publish have, after the audit and before anything is written.
    """
    if mode not in ("insert_only", "replace", "sync"):
        raise ValueError(f"mode must be insert_only, replace or sync, not {mode}")
    if audit_scope not in ("table", "months", "state"):
        raise ValueError(f"audit_scope must be table, months or state, not {audit_scope}")
    spark = batch.sparkSession
    name = base_name(table)
    check = table_check(name, TABLE_RULES if rules is None else rules)
    key = list(keys or (TABLES[name].key if name in TABLES else batch.columns))
    exists = spark.catalog.tableExists(table)
    if exists:
        by_month = is_by_month(spark.table(table))
    elif by_month is None:
        by_month = name in TABLES and TABLES[name].by_month
    # Rows with the same key are in the same month, so other months need not be looked at.
    key_has_month = by_month and "date" in key
    incoming, audit = sibling(table, "incoming"), sibling(table, "audit")
    try:
        create_like(batch, incoming, by_month)
        arrived = spark.table(incoming)
        if mode == "sync":
            return _synchronize(arrived, table, check, by_month)
        if arrived.isEmpty():
            return False
        stored = spark.table(table) if exists else arrived.limit(0)
        if exists and key_has_month:
            stored = only_months(stored, stored_months(spark, incoming))
        if not exists or stored.isEmpty():
            stage = incoming
        else:
            stage = audit
            same = key if mode == "insert_only" else None
            known, unknown = _by_stored(spark, incoming, table) if key_has_month else (arrived, None)
            create_like(without_existing(known, stored, same, stored_is_unique=True), stage, by_month, unknown)
        staged = read_table(spark, stage)
        if staged.isEmpty():
            return False
        if exists and mode == "replace" and key_has_month:
            stored = only_months(spark.table(table), stored_months(spark, stage))
        months = stored_months(spark, stage) if by_month else []
        state = None
        if audit_scope == "state" and key_has_month and check.constraints:
            state = MetricStates(spark, table, metrics_table(table), [check])
            state.refresh()
            after = _after(only_months(stored, months).drop(MONTH_COLUMN) if exists else stored.drop(MONTH_COLUMN), staged, key, mode)
            outcome = conclude(state.metrics_after(after, months).orderBy("number").collect(), spark)
        else:
            narrow, wide = _split(check) if audit_scope == "months" and key_has_month else (None, check)
            everything = spark.table(table) if exists else stored
            parts = [(_after(everything.drop(MONTH_COLUMN), staged, key, mode), wide)]
            if narrow is not None:
                parts.append((_after(stored.drop(MONTH_COLUMN), staged, key, mode), narrow))
            outcome = verify_parts(parts, spark)
        if not outcome.passed:
            raise AuditFailed(table, outcome)
        if before_write is not None:
            before_write(months)
        if state is not None:
            state.note(months)
        if not exists:
            create_for(batch, table, by_month)
        if switch and key_has_month:
            # Months that the table lacks are written as they lie in the staging table.
            known, unknown = _by_stored(spark, stage, table)
            current = only_months(spark.table(table), months).drop(MONTH_COLUMN)
            switch_months(_after(current, known.drop(MONTH_COLUMN), key, mode), table, unknown)
        elif mode == "insert_only" or not exists:
            append(spark.table(stage), table, arranged=True)
        elif key_has_month:
            overwrite_months(_after(stored.drop(MONTH_COLUMN), staged, key, mode), table)
        else:
            replace_content(_after(read_table(spark, table), staged, key, mode), table)
        if state is not None:
            state.refresh()
        return True
    finally:
        drop_table(spark, audit)
        drop_table(spark, incoming)


def _by_stored(spark: SparkSession, stage: str, table: str) -> tuple[DataFrame, DataFrame | None]:
    """A staging table's rows in the months that the table has, which alone can have its keys, and the others; None if there are no such months."""
    stored, staged = set(stored_months(spark, table)), stored_months(spark, stage)
    others = [m for m in staged if m not in stored]
    rows = spark.table(stage)
    return (only_months(rows, [m for m in staged if m in stored]), only_months(rows, others)) if others else (rows, None)


def metrics_table(table: str) -> str:
    """Name of the table with the state of a table's metrics."""
    *database, name = table.replace("`", "").split(".")
    return ".".join(quoted(part) for part in (*database, f"metrics_{name}"))


def _synchronize(arrived: DataFrame, table: str, check: Check, by_month: bool) -> bool:
    """Publish the staged rows as the whole content; False if the table has just these rows already."""
    spark = arrived.sparkSession
    rows = arrived.drop(MONTH_COLUMN)
    exists = spark.catalog.tableExists(table)
    if exists:
        stored = read_table(spark, table).select(*[named(c) for c in rows.columns])
        counted = rows.count() == stored.count()
        if counted and without_existing(rows, stored).isEmpty() and without_existing(stored, rows).isEmpty():
            return False
    elif rows.isEmpty():
        return False
    outcome = verify_parts([(rows, check)], spark) if not rows.isEmpty() else None
    if outcome is not None and not outcome.passed:
        raise AuditFailed(table, outcome)
    if not exists:
        create_for(rows, table, by_month)
    replace_content(rows, table)
    return True


def _split(check: Check) -> tuple[Check, Check]:
    """The constraints for which the touched months are enough, and the others."""

    def is_exact(constraint: Constraint) -> bool:
        if constraint.assertion is not fully:
            return False
        return constraint.predicate is not None or (constraint.is_uniqueness and "date" in constraint.columns)

    narrow = tuple(c for c in check.constraints if is_exact(c))
    wide = tuple(c for c in check.constraints if not is_exact(c))
    return Check(check.name, narrow, check.level), Check(check.name, wide, check.level)


def _after(current: DataFrame, staged: DataFrame, key: Sequence[str], mode: str) -> DataFrame:
    """The table's rows once the staged ones are published."""
    if mode == "insert_only":
        return current.unionByName(staged, allowMissingColumns=True)
    return merge_replace(current, staged, key)
