"""State kept beside a table laid out by month, from which summaries follow without the table's rows.

A state is a relation made of the rows of one month, stored in a table of the same layout. After a load or a delete only the months that were
touched are made anew. Months are noted in a journal before the table is written and struck off when their state is; so a
run that ends in between leaves them in the journal, and the next one sees to them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from skyledger.functions.columns import named
from skyledger.operators.levels import daily_cells
from skyledger.schemas import MONTH_COLUMN
from skyledger.sources.tables import create_like, drop_table, is_by_month, only_months, overwrite_mode, replace_months, sibling, stored_months

Months = Sequence[str | None]


class MonthlyState:
    """The state ``make(rows)`` per month of ``facts``, stored as ``table``. What ``make`` gives has a column date, or the layout column itself."""

    def __init__(self, spark: SparkSession, facts: str, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.facts, self.table, self.make = spark, facts, table, make
        *database, name = table.split(".")
        self.journal = ".".join([*database, f"journal_{name.strip('`')}"])

    def note(self, months: Months) -> None:
        """These months are about to change."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.journal} ({MONTH_COLUMN} STRING) USING parquet")
        rows = [(m,) for m in months]
        if rows:
            self.spark.createDataFrame(rows, f"{MONTH_COLUMN} STRING").coalesce(1).write.insertInto(self.journal)

    def open_months(self) -> list[str | None]:
        """Months whose state is not up to date: those in the journal, and all that the state does not have."""
        if not self.spark.catalog.tableExists(self.facts):
            return []
        stored = set(stored_months(self.spark, self.facts))
        known = set(stored_months(self.spark, self.table)) if self.spark.catalog.tableExists(self.table) else set()
        noted = {r[0] for r in self.spark.table(self.journal).distinct().collect()} if self.spark.catalog.tableExists(self.journal) else set()
        return sorted((stored - known) | (noted & (stored | known)), key=lambda m: m or "")

    def rows_of(self, months: Months) -> DataFrame:
        """The facts of the months, as a predicate on the partition column; their layout column stays."""
        facts = self.spark.table(self.facts)
        if not is_by_month(facts):
            raise ValueError(f"{self.facts} is not laid out by month")
        return only_months(facts, months)

    def refresh(self) -> list[str | None]:
        """Make the state of all open months anew, from their rows alone; gives these months."""
        months = self.open_months()
        if months:
            made = self.made(months)
            if not self.spark.catalog.tableExists(self.table):
                create_like(made, self.table, True) if "date" in made.columns else self._create(made)
            elif "date" in made.columns:
                self._replace_dated(made, months)
            else:
                self._replace(made, months)
        drop_table(self.spark, self.journal)
        return months

    def made(self, months: Months) -> DataFrame:
        return self.make(self.rows_of(months))

    def _create(self, made: DataFrame) -> None:
        made.write.partitionBy(MONTH_COLUMN).format("parquet").saveAsTable(self.table)

    def _replace_dated(self, made: DataFrame, months: Months) -> None:
        """The facts are read once: the state is written beside the table first, and its months are those it has there."""
        stage = sibling(self.table, "made")
        try:
            create_like(made, stage, True)
            replace_months(self.spark.table(stage), self.table, months, stored_months(self.spark, stage), arranged=True)
        finally:
            drop_table(self.spark, stage)

    def _replace(self, made: DataFrame, months: Months) -> None:
        target = self.spark.table(self.table)
        with overwrite_mode(self.spark, "dynamic"):
            made.select(*[named(c) for c in target.columns]).write.insertInto(self.table, overwrite=True)
        for month in set(months) - set(stored_months(self.spark, self.facts)):
            value = "NULL" if month is None else f"'{month}'"
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({MONTH_COLUMN} = {value})")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)


def cell_store(spark: SparkSession, facts: str, table: str) -> MonthlyState:
    """Cells of the aggregate table per day: its levels are sums of them."""
    return MonthlyState(spark, facts, table, lambda rows: daily_cells(rows.drop(MONTH_COLUMN)))
