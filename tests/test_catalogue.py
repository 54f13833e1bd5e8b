"""Every registered query against its SQL in DuckDB, over the whole tables of the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
STATEMENTS = entry_points.oracle_sql()
# Queries of the removable subpackage are tested beside it.
TRAINING_DATA = {name for name in QUERIES if name == "pipeline" or name.startswith("op")}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
         "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TABLES):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    return connection


def comparable(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value) if isinstance(value, float) else str(value)


def test_flagship(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["airline", "delayed_rate", "avg_delay_time"]
    assert found.count() == 5


def test_sql_has_its_query():
    assert set(STATEMENTS) <= set(QUERIES)
    unchecked = set(QUERIES) - set(STATEMENTS) - TRAINING_DATA
    assert unchecked == {"sample_keys", "sample_rows", "profile_approx", "suggestions"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING_DATA))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    ours = sorted(tuple(comparable(r[c]) for c in columns) for r in found.collect())
    if name not in STATEMENTS:
        assert ours
        return
    cursor = duck.execute(STATEMENTS[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(described) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == described
    places = [list(described).index(c) for c in columns]
    theirs = sorted(tuple(comparable(row[i]) for i in places) for row in cursor.fetchall())
    assert ours == theirs
