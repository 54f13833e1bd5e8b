import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from skyledger.llm.catalogue import QUERIES, STATEMENTS
from tests.llm.test_neardup import classes_by_all_pairs

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TABLES).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= kept, name
        if k < 3:
            assert docs.columns == columns and len(ids) == len(set(ids)) < len(kept), name
        kept = set(ids)
    assert docs.columns == [*columns, "shard", "slot"]
    rows = docs.select("shard", "slot").collect()
    for shard in range(corpus_pipeline.SHARDS):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def by_quality(spark, docs, path):
    return Counter(r.doc_id for r in QUERIES["op1_quality"](spark, TABLES).collect() if r.score >= 0.3)


def by_all_pairs(spark, docs, path):
    return Counter(set(classes_by_all_pairs(docs).values()))


def by_windows(spark, docs, path):
    windows = set()
    for (text,) in duckdb.execute(f"SELECT text FROM '{TABLES}/benchmark.parquet'").fetchall():
        words = lowered(text)
        size = min(10, len(words))
        windows |= {tuple(words[k : k + size]) for k in range(len(words) - size + 1) if size}
    sizes = {len(w) for w in windows}
    held = lambda words: any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))
    return Counter(doc_id for doc_id, text in docs if not held(lowered(text)))


def by_copies(spark, docs, path):
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        cursor = duck.execute(STATEMENTS["op5_mixing"])
        names = [d[0] for d in cursor.description]
        rows = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert all(r["size"] for r in rows)
    return +Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows})


def by_all(spark, docs, path):
    return Counter(doc_id for doc_id, _ in docs)


def test_each_stage_keeps_what_a_plain_version_keeps(spark, tmp_path):
    path = f"{TABLES}/documents.parquet"
    for k, ((name, stage), plain) in enumerate(zip(corpus_pipeline.STAGES, (by_quality, by_all_pairs, by_windows, by_copies, by_all), strict=True)):
        docs = spark.read.parquet(path)
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = str(tmp_path / str(k))
        stage(spark, docs, TABLES).write.parquet(out)
        kept = Counter(r.doc_id for r in spark.read.parquet(out).select("doc_id").collect())
        assert kept == plain(spark, rows, path if path.endswith(".parquet") else f"{path}/*.parquet"), name
        path = out


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, TABLES).count() == 0, name
