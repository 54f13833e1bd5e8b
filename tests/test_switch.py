"""Publishing by the catalog's pointers, quarantined CSV records, samples of exact size, sketches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.operators import explore
from skyledger.plans import publish
from skyledger.quality import profile, sketches, suggest
from skyledger.sources import files, tables
from tests.helpers import plan, rows, silver_frame, silver_row

RULES = {"fact_flights": {"uniqueness": ["date", "flight_number"], "completeness": ["date"]}}
KEY = ["date", "flight_number"]


def month(spark, m, numbers, delay=5):
    return silver_frame(spark, [silver_row(date=dt.date(2015, m, 3), flight_number=n, departure_delay=delay) for n in numbers])


def load(batch, table, mode="insert_only"):
    return publish.write_audit_publish(batch, table, KEY, mode=mode, rules=RULES, switch=True)


def test_months_are_switched_and_old_files_stay(spark, database):
    table = f"{database}.fact_flights"
    assert load(month(spark, 1, range(5)).union(month(spark, 2, range(5))), table)
    before = spark.table(table).inputFiles()
    assert load(month(spark, 1, range(8)), table)
    after = spark.table(table).inputFiles()
    assert set(f for f in before if "2015-02" in f) <= set(after)
    assert not set(f for f in before if "2015-01" in f) & set(after)
    assert spark.read.parquet(*[f for f in before if "2015-01" in f]).count() == 5  # a reader that has begun
    assert load(month(spark, 1, range(3), delay=9), table, "replace")
    assert sorted((r.flight_number, r.departure_delay) for r in spark.table(table).where("date_month = '2015-01'").collect()) == [
        (n, 9 if n < 3 else 5) for n in range(8)
    ]
    assert not load(month(spark, 1, range(8)), table)


def test_a_failure_between_two_months(spark, database, monkeypatch):
    """One month is new, the other as it was, neither half of one; the load run again completes it."""
    table = f"{database}.fact_flights"
    load(month(spark, 1, range(4)).union(month(spark, 2, range(4))), table)
    batch = month(spark, 1, range(9)).union(month(spark, 2, range(9)))
    real, seen = tables._location, []

    def failing(session, name, part=None):
        if part is not None:
            seen.append(part)
            if len(seen) == 2:
                raise OSError("lost")
        return real(session, name, part)

    monkeypatch.setattr(tables, "_location", failing)
    with pytest.raises(OSError):
        load(batch, table)
    counts = {r.date_month: r["count"] for r in spark.table(table).groupBy("date_month").count().collect()}
    assert counts == {"2015-01": 9, "2015-02": 4}
    monkeypatch.setattr(tables, "_location", real)
    assert load(batch, table)
    assert spark.table(table).count() == 18
    tables.delete_where(spark, table, "flight_number > 6")
    assert spark.table(table).count() == 14


def test_csv_records_that_do_not_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,day,word\n1,2015-01-01,x\nx,2015-01-02,y\n3,soon,\n4\n5,2015-02-30,z\n,,\n")
    good, rejected = files.read_csv_checked(spark, str(tmp_path), "n INT, day DATE, word STRING")
    assert rows(good) == [(None, None, None), (1, dt.date(2015, 1, 1), "x")]
    assert rows(rejected) == sorted(
        [
            ("a.csv", "x,2015-01-02,y", ["n: no int"]),
            ("a.csv", "3,soon,", ["day: no date"]),
            ("a.csv", "4", ["wrong number of cells"]),
            ("a.csv", "5,2015-02-30,z", ["day: no date"]),
        ],
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


def test_sample_has_its_size_and_limits_ahead_of_the_shuffle(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id").union(spark.createDataFrame([(9, 1), (9, 2)], "g long, id long"))
    sample = explore.sample_per_group(df, ["g"], 7, ["id"], seed=3)
    assert {r.g: r["count"] for r in sample.groupBy("g").count().collect()} == {0: 7, 1: 7, 2: 7, 9: 2}
    assert rows(sample) == rows(explore.sample_per_group(df.repartition(5), ["g"], 7, ["id"], seed=3))
    assert rows(sample) != rows(explore.sample_per_group(df, ["g"], 7, ["id"], seed=4))
    assert "WindowGroupLimit" in plan(sample)


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("n"), F.lit("x").alias("w"))
    found = {r.column_name: r for r in sketches.merged_profile(sketches.column_sketches(df, ["n", "w"], ["part"]), [0.25, 0.5]).collect()}
    n = found["n"]
    assert (n.row_count, n.completeness, n.minimum, n.maximum) == (20_000, 0.9, 1.0, 19_999.0)
    for p, value in zip((0.25, 0.5), n.percentiles):
        assert abs(value / 20_000 - p) < 4 * sketches.rank_error()
    assert abs(n.approx_distinct / 18_000 - 1) < 4 * sketches.distinct_error()
    assert (found["w"].approx_distinct, found["w"].percentiles, found["w"].minimum) == (1, None, None)


def test_histograms_tell_null_from_its_name(spark):
    df = spark.createDataFrame([("NullValue", 1)] * 3 + [(None, 2)] * 2 + [("a", 3)], "w string, n int")
    found = {r.column_name: r for r in profile.profile_with_histograms(df, percentiles=(0.5,)).collect()}
    assert [tuple(x) for x in found["w"].histogram] == [("NullValue", False, 3, 0.5), ("NullValue", True, 2, 2 / 6), ("a", False, 1, 1 / 6)]
    assert len(found["n"].histogram) == 3
    wide = profile.profile_with_histograms(spark.range(1000), most=20).collect()[0]
    assert wide.histogram is None
    facts = {f.name: f for f in suggest.column_facts(df)}
    assert facts["w"].facts["null_values"] == 1 and facts["w"].facts["distinct_values"] == 3


def test_suggestions_meet_other_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "ok").otherwise("new").alias("w"), (F.col("id") - 900).alias("n"))
    held_out = F.col("id") >= 800
    found = {(r.column_name, r.rule): (r.share, r.passed) for r in suggest.evaluated(df.withColumn("n", -F.col("n")), held_out).collect()}
    assert found[("id", "complete_if_complete")] == (1.0, True)
    assert found[("w", "categorical_range")] == (0.5, False)
    assert found[("n", "non_negative_numbers")] == (101 / 200, False)
