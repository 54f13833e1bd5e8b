"""File sources and sinks: CSV in, parquet for reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.functions.columns import quoted
from skyledger.schemas import RAW_FILES, ddl_fields


def literal_table(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """A small relation written out in the plan itself, so that no cluster task is needed to read it."""
    fields = ddl_fields(ddl)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    lines = ["(" + ", ".join(f":r{r}c{c}" for c in range(len(fields))) + ")" for r in range(len(rows))]
    columns = ", ".join(f"CAST(col{n} AS {kind}) AS {quoted(name)}" for n, (name, kind) in enumerate(fields, 1))
    values = {f"r{r}c{c}": value for r, row in enumerate(rows) for c, value in enumerate(row)}
    return spark.sql(f"SELECT {columns} FROM VALUES {', '.join(lines)}", args=values)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, mode: str = "PERMISSIVE", enforce_schema: bool = True
) -> DataFrame:
    """CSV with a header line and a declared schema; a cell that does not parse becomes NULL by default."""
    return spark.read.csv(path, schema=schema, header=True, mode=mode, enforceSchema=enforce_schema)


def read_csv_checked(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """CSV with a header line and a declared flat schema: the rows that read in full, and the others as (file, record, reasons).

    A record is rejected for a wrong number of cells, or for each cell that has a text but no value of its column's type; ``reasons`` says
    which. Nothing becomes NULL unnoticed. Both relations are one scan of the text each, without a shuffle.
    """
    fields = ddl_fields(ddl)
    texts = ", ".join(f"{quoted(name)} STRING" for name, _ in fields) + ", _record STRING"
    lines = spark.read.csv(path, schema=texts, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_record")
    bad = [
        F.when(F.col(quoted(n)).isNotNull() & F.col(quoted(n)).try_cast(kind).isNull(), F.lit(f"{n}: no {kind.lower()}")) for n, kind in fields
    ]
    reasons = F.when(F.col("_record").isNotNull(), F.array(F.lit("wrong number of cells"))).otherwise(F.array_compact(F.array(*bad)))
    marked = lines.select("*", F.col("_metadata.file_name").alias("_file"), reasons.alias("_reasons"))
    typed = [F.col(quoted(n)).try_cast(kind).alias(n) for n, kind in fields]
    cells = F.concat_ws(",", *[F.coalesce(F.col(quoted(n)), F.lit("")) for n, _ in fields])
    good = marked.where(F.size("_reasons") == 0).select(*typed)
    rejected = marked.where(F.size("_reasons") > 0)
    return good, rejected.select(F.col("_file").alias("file"), F.coalesce("_record", cells).alias("record"), F.col("_reasons").alias("reasons"))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.csv(path, header=True, mode=mode)


def read_raw(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The four raw relations of a data folder, lazily."""
    return {
        name: read_csv(spark, f"{data_dir.rstrip('/')}/{file}", ddl) for name, (file, ddl) in RAW_FILES.items()
    }


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The aggregate table exported as parquet, as reports read it."""
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Every call gives another name, so repeated and concurrent runs do not meet. A session without
    the setting uses its warehouse, which all executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, computed once and read from files in a new shared folder by everything that follows."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
