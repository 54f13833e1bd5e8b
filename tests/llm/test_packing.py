"""Packing: the level rule against a plain count of squares, pieces against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import packing
from skyledger.llm.catalogue import QUERIES

TABLES = "/root/testdata/sf0.01"


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    found.encode_special_tokens = True
    return found


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    draw = random.Random(1)
    letters = "a b  \n\t'sé漢\x1c\x85 　<|endoftext|>1.,😀 "
    encode = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    for stretch in (1, 5, 1 << 15):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        for _ in range(500):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
            assert [int(i) for ids in encode(text) for i in ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_run_by_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = [int(i) for x in packing.Encoder(path)("Some words, more words") for i in x]
    assert ids == Tokenizer.from_file(path).encode("Some words, more words", add_special_tokens=False).ids


def squares(levels, window):
    counts = {}
    for level in levels:
        if 0 < level < window:
            counts[level] = counts.get(level, 0) + 1
    return sum(n * n for n in counts.values())


def test_level_has_the_least_sum_of_squares():
    window, draw = 32, random.Random(3)
    packer = packing.Packer(lambda pieces: None, window, max_open=1 << 30)
    levels = []
    for n in range(2000):
        size = draw.choice([4, 8, 12, 20])
        found = packer.level(size)
        choices = {}
        for low in sorted(set(levels) | {0}):
            if low + size <= window:
                rest = list(levels)
                if low:
                    rest.remove(low)
                choices[low] = squares([*rest, low + size], window)
        assert choices[found] == min(choices.values())
        assert found == max(low for low, cost in choices.items() if cost == choices[found])
        packer.place(packing.Piece(n, 0, np.zeros(size, "<u4"), size))
        if found:
            levels.remove(found)
        if found + size < window:
            levels.append(found + size)
    assert len(levels) < 60  # of about 900 sequences


def check_pieces(rows, texts, tokenizer, window=packing.WINDOW):
    ids = {n: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for n, t in enumerate(texts)}
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_document) == set(ids)
    for doc_id, pieces in by_document.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]]))
        assert {p.doc_tokens for p in pieces} == {len(ids[doc_id])} == {sum(p.length for p in pieces)}
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[doc_id][p.start : p.start + p.length], "<u4").tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]]))
        size = sum(p.length for p in pieces)
        assert size == window or (size < window and size & (size - 1) == 0)


def test_query_packs_every_id_once(spark, tokenizer):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    assert sorted(texts) == list(range(len(texts)))
    check_pieces(QUERIES["op11_packing"](spark, TABLES).collect(), [texts[n] for n in range(len(texts))], tokenizer)


@pytest.mark.parametrize("max_open", [2, packing.MAX_OPEN])
def test_edges(spark, tokenizer, max_open):
    texts = [None, "", " ", "word", "word " * 5000, "x" * 3000, "<|endoftext|>", *["same text, again"] * 50]
    docs = documents(spark, texts).withColumns({"sequence_id": F.lit("clash"), "a.b": F.lit(1)})
    pieces = packing.pack(docs, max_open=max_open)
    check_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, tokenizer)


def test_copies_of_an_id_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "one"), (None, "two")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in packing.pack(docs).where("start = 0").collect()) == [0, 1, 1]
    assert packing.pack(docs.limit(0)).collect() == []


def test_sequences_put_pieces_together(spark, tokenizer):
    texts = ["some words " * n for n in range(200)]
    pieces = packing.pack(documents(spark, texts))
    found = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in found) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert all(len(r.ids) == 4 * r.n_tokens and r.n_padding == 0 and r.starts[0] == 0 for r in found)
