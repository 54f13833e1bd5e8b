"""The batch load: raw files to published fact, dimension and aggregate tables."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from skyledger.operators.dedup import first_per_key
from skyledger.operators.levels import gold, gold_from_cells
from skyledger.operators.silver import to_silver
from skyledger.plans.publish import write_audit_publish
from skyledger.plans.states import cell_store
from skyledger.schemas import FLIGHT_KEY, MONTH_COLUMN
from skyledger.sources.calendar import Holidays, calendar
from skyledger.sources.files import read_raw
from skyledger.sources.tables import create_tables, full_name, read_table, stored_months, write_new


def run(
    spark: SparkSession,
    data_dir: str,
    database: str,
    keys: Sequence[str] = FLIGHT_KEY,
    holidays: Holidays | None = None,
    audit_scope: str = "months",
) -> dict[str, bool]:
    """Load a data folder; says per table whether something was written. Repeating a load writes nothing."""
    raw = read_raw(spark, data_dir)
    create_tables(spark, database)
    name = lambda table: full_name(database, table)
    flights = first_per_key(to_silver(raw["flights"]), keys)
    cells = cell_store(spark, name("fact_flights"), name("cells_fact_flights"))
    done = {
        "fact_flights": write_audit_publish(
            flights, name("fact_flights"), keys, audit_scope=audit_scope, before_write=cells.note
        )
    }
    done["dim_airlines"] = write_new(raw["airlines"], name("dim_airlines"))
    done["dim_airports"] = write_new(raw["airports"], name("dim_airports"))
    done["dim_cancellation_codes"] = write_new(raw["cancellation_codes"], name("dim_cancellation_codes"))
    years = [int(month[:4]) for month in stored_months(spark, name("fact_flights")) if month]
    if years:
        days = calendar(spark, dt.date(min(years), 1, 1), dt.date(max(years), 12, 31), holidays)
        done["dim_dates"] = write_new(days, name("dim_dates"), keys=["date"])
    cells.refresh()  # only the months that this load touched, or an interrupted one
    if spark.catalog.tableExists(cells.table):
        summary = gold_from_cells(cells.read().drop(MONTH_COLUMN), read_table(spark, name("dim_dates")))
    else:
        summary = gold(read_table(spark, name("fact_flights")))
    done["agg_fact_flights"] = write_audit_publish(summary, name("agg_fact_flights"), mode="sync")
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("data_dir", help="folder with the four raw CSV files")
    parser.add_argument("database", help="database of the published tables")
    parser.add_argument("--audit-scope", choices=("table", "months", "state"), default="months")
    options = parser.parse_args()
    spark = SparkSession.builder.appName("flight load").getOrCreate()
    for table, written in run(spark, options.data_dir, options.database, audit_scope=options.audit_scope).items():
        print(f"{table}: {'written' if written else 'nothing new'}")


if __name__ == "__main__":
    main()
