"""The registered queries against their SQL, or against what the tables say by a plain loop."""

import datetime
import hashlib
import ipaddress
import os

import duckdb
import numpy as np
import pytest

from skyledger.llm.catalogue import QUERIES, STATEMENTS
from tests.test_catalogue import TYPES, comparable

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TABLES):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_with_sql(spark, duck, name):
    found = QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    cursor = duck.execute(STATEMENTS[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == described
    places = [list(described).index(c) for c in columns]
    theirs = sorted(tuple(comparable(row[i]) for i in places) for row in cursor.fetchall())
    assert sorted(tuple(comparable(r[c]) for c in columns) for r in found.collect()) == theirs


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_quality_scores_are_right_on_held_out_rows(spark):
    larger = TABLES.replace("0.001", "0.01")
    found = QUERIES["op1_quality"](spark, larger).toPandas()
    labels = spark.read.parquet(f"{larger}/labels.parquet").toPandas()
    assert len(found) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95


def test_hosts_paths_and_rules(spark, duck):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = {r.page_id: r for r in QUERIES["op2_url_filter"](spark, TABLES).collect()}
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url in pages:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        row = got[page_id]
        assert (row.host, row.path, row.rule) == (host, path, max(fit)[1] if fit else None)
        assert row.verdict in ("allow", "block") and (not fit or row.verdict == max(fit)[2])


def test_shards_are_even_and_complete(spark, duck):
    found = QUERIES["op4_sharding"](spark, TABLES).toPandas()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(found.doc_id) == sorted(texts) and set(found.law) == {"rows"}
    counts = found.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["nunique"] == counts["count"]).all() and (counts["max"] == counts["count"] - 1).all()
    import zlib

    for row in found.itertuples():
        data = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(data) + 1, zlib.crc32(data))
    # The order is a shuffle: neighbours in the input are not neighbours in the output.
    ordered = found.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert (np.abs(np.diff(ordered)) == 1).mean() < 0.1


def test_conversations_read_back(spark, duck):
    found = {r.conv_id: r for r in QUERIES["op8_chat"](spark, TABLES).collect()}
    said = "\\### Assistant: </turn> ok"
    turns = duck.execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall()
    turns += [(-7, "user", said), (-7, "assistant", said)]
    for conv_id in {t[0] for t in turns}:
        own = [t[1:] for t in turns if t[0] == conv_id]
        loss = "".join(text for role, text in own if role == "assistant")
        row = found.pop(conv_id)
        assert row.n_turns == len(own) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars >= sum(len(t) for _, t in own)
    assert not found


def test_near_duplicate_classes(spark, duck):
    from tests.llm.test_neardup import classes_by_all_pairs

    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {r.doc_id: r.class_id for r in QUERIES["op10_near_duplicates"](spark, TABLES).collect()} == classes_by_all_pairs(docs)


def test_pseudonyms_leave_clean_texts_alone(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for row in QUERIES["op3_pseudonyms"](spark, TABLES).collect():
        assert (row.text == texts[row.doc_id]) == (row.n_found == 0)
        assert len(row.text) >= len(texts[row.doc_id]) - 12 * row.n_found


def is_date(word):
    try:
        return len(word) == 10 and 1900 <= datetime.date.fromisoformat(word).year <= 2099
    except ValueError:
        return False


def is_address(word):
    try:
        return bool(ipaddress.IPv4Address(word))
    except ValueError:
        return False


def is_card(word):
    if not (word.isascii() and word.isdigit() and 13 <= len(word) <= 19 and len(set(word)) > 1):
        return False
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(word))) % 10 == 0


def personal(text):
    """(format, value) of each valid card, date, address and phone, word by word."""
    words = [w.strip("$%&#*.,;:!?\"'") for w in text.split()]
    for k, word in enumerate(words):
        for name, valid in (("card", is_card), ("date", is_date), ("ipv4", is_address), ("email", lambda w: "@" in w[1:-1])):
            if valid(word):
                yield name, word
        if word == "+1" and k + 2 < len(words) and len(words[k + 1]) == 5 and len(words[k + 2]) == 8:
            yield "phone", " ".join(words[k : k + 3])


def test_pseudonyms_miss_no_value(spark, duck):
    larger, listed = TABLES.replace("0.001", "0.01"), {}
    for doc_id, text in duck.execute(f"SELECT doc_id, text FROM '{larger}/documents.parquet'").fetchall():
        listed[doc_id] = (text, list(personal(text)))
    seen = {name for _, values in listed.values() for name, _ in values}
    assert seen >= {"card", "ipv4", "email", "phone"}
    for row in QUERIES["op3_pseudonyms"](spark, larger).collect():
        text, values = listed.pop(row.doc_id)
        others = set(row.formats.split(",")) - {"", "card", "date", "ipv4", "email", "phone"}
        assert {name for name, _ in values} == set(row.formats.split(",")) - others - {""}, (row.doc_id, row.formats, values)
        assert row.n_found == len(values) or (others and row.n_found > len(values)), (row.doc_id, row.formats, row.n_found, values)
        assert not [value for _, value in values if value in row.text], row.doc_id
    assert not listed
