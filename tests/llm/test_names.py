"""Operators that give back their rows: columns of any name, and many copies of a row."""

import pytest
from pyspark.sql import functions as F

from skyledger.llm import decontaminate, mixing, neardup, quality, sharding

N = 20_000
NAMES = "doc_id long, text string, lang string, source string, n_chars long, _shard int, _row int, _all int, _item int, `a.b` int, `mil` int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_shard", "_row", "_all", "_item", "a.b", "mil"]


@pytest.fixture(scope="module")
def docs(spark):
    copies = spark.range(N).select(F.lit(1).cast("long").alias("doc_id"))
    others = spark.range(2, 40).select(F.col("id").alias("doc_id"))
    texts = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("doc_id").cast("string")) for k in range(12)])
    rows = copies.union(others).select("doc_id", texts.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    return rows.select("*", *[F.lit(k).alias(name) for k, name in enumerate(COLUMNS[5:])])


def labels(spark):
    return spark.range(2, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixture", "shards"])
def test_rows_come_back_with_their_columns(spark, docs, name):
    item = spark.createDataFrame([(1, " ".join(f"w{k}x5" for k in range(12)))], "item_id long, text string")
    run = {
        "quality": lambda: quality.keep_good(docs, labels(spark), threshold=-1.0),
        "near_duplicates": lambda: neardup.one_per_class(docs),
        "decontamination": lambda: decontaminate.without_contaminated(docs, item),
        "mixture": lambda: mixing.mix(docs),
        "shards": lambda: sharding.shard_rows(docs, 3),
    }[name]
    found = run()
    assert found.columns == COLUMNS + (["shard", "slot"] if name == "shards" else [])
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    if name in ("quality", "shards"):
        assert counts == {1: N} | {k: 1 for k in range(2, 40)}
    elif name == "near_duplicates":
        assert counts == {k: 1 for k in range(1, 40)}
    elif name == "decontamination":
        assert counts == {1: N} | {k: 1 for k in range(2, 40) if k != 5}
    else:
        assert 1.4 * (N + 38) < sum(counts.values()) < 1.6 * (N + 38)
    assert found.agg(F.min("`a.b`"), F.max("`a.b`")).collect()[0] == (4, 4)


def test_the_sample_is_bounded_in_bytes(spark, docs):
    sizes = [(5, 100), (1, 100), (9, 100), (3, 1000)]
    assert quality.within(sizes, 100) == 1
    assert quality.within(sizes, 1199) == 2
    assert quality.within(sizes, 10_000) == 4
    assert quality.within(sizes, 1) == 1
    model = quality.train(docs.where("doc_id > 1"), labels(spark), max_bytes=4000)
    assert quality.score(docs.where("doc_id > 30"), model).count() == 9
