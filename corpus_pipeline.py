"""A training-data pipeline over documents: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes the documents that the one before kept, and its decisions take effect: rejected rows go, mixed rows repeat. All stages but
the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm.decontaminate import without_contaminated
from skyledger.llm.mixing import mix
from skyledger.llm.neardup import one_per_class
from skyledger.llm.quality import keep_good
from skyledger.llm.sharding import shard_rows
from skyledger.llm.shared import stored

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order, with shard and slot."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", sharding),
]

ORACLE_SQL = None  # a trained classifier, registers of random arrivals and a shuffle aren't expressible; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
