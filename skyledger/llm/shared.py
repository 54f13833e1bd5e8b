"""Small helpers of the operators: input columns, sizes, lineage cuts and packed arrays."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20  # text that one group of documents holds on average; a task works on one group at a time


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session that has none uses a folder below its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: computed once, and read again if an executor is lost. For narrow tables."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back. For tables with whole texts, and for loops.

    What is left there when a session ends may be deleted.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: inside they are numbered, and what comes out has the names of ``fields``."""
    numbered = df.toDF(*[f"c{n}" for n in range(len(df.columns))])
    out = T.StructType([T.StructField(f"c{n}", f.dataType, f.nullable) for n, f in enumerate(fields)])
    return numbered.mapInArrow(run, out).toDF(*[f.name for f in fields])


def n_chunks(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """Groups of about ``chunk_bytes`` of text: grows with the input, and is at least the number of shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(total / chunk_bytes))


def chunk_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash values, by their upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cells(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``order`` cut where the sorted ``keys`` change."""
    if not len(keys):
        return
    edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(keys[a]), order[a:b]


def binary(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and the length of each value."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
