import datetime as dt

import pytest

from skyledger.operators import existing, levels
from skyledger.operators.silver import to_silver
from skyledger.plans import pipeline
from skyledger.plans.publish import AuditFailed, write_audit_publish
from skyledger.schemas import TABLES
from skyledger.sources import tables
from tests.helpers import plan, raw_frame, rows, silver_frame, silver_row

JANUARY = [silver_row(), silver_row(flight_number=2)]
FEBRUARY = [silver_row(date=dt.date(2015, 2, 3)), silver_row(date=dt.date(2015, 2, 4))]


@pytest.fixture
def fact(spark, database):
    tables.create_tables(spark, database)
    return tables.full_name(database, "fact_flights")


def names(spark, database):
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def test_create_tables(spark, database):
    for _ in range(2):
        tables.create_tables(spark, database)
    assert names(spark, database) == sorted(TABLES)
    for name, spec in TABLES.items():
        assert tables.read_table(spark, tables.full_name(database, name)).columns == spec.columns
    spark.sql(f"SHOW CREATE TABLE {database}.fact_flights")
    spark.sql(f"DESCRIBE EXTENDED {database}.fact_flights")


def test_append_goes_by_name_and_is_not_idempotent(spark, fact):
    flights = silver_frame(spark, JANUARY)
    for _ in range(2):
        tables.append(flights.select(*reversed(flights.columns)), fact)
    assert rows(tables.read_table(spark, fact)) == rows(flights.union(flights))


def test_append_fills_columns_the_rows_lack(spark, fact):
    tables.append(silver_frame(spark, JANUARY).drop("weather_delay"), fact)
    assert spark.table(fact).where("weather_delay IS NULL").count() == 2


def test_layout_by_month_prunes(spark, fact):
    tables.append(silver_frame(spark, JANUARY + FEBRUARY), fact)
    assert tables.stored_months(spark, fact) == ["2015-01", "2015-02"]
    one = tables.only_months(spark.table(fact), ["2015-02"])
    assert one.count() == 2
    assert len(one.inputFiles()) == 4 or "PartitionFilters: [isnotnull" in plan(one)


def test_new_rows(spark, fact):
    flights = silver_frame(spark, JANUARY)
    fresh, some = tables.new_rows(flights, fact)
    assert some and fresh.count() == 2
    tables.append(flights, fact)
    fresh, some = tables.new_rows(flights, fact)
    assert not some and fresh.count() == 0
    fresh, some = tables.new_rows(flights, "no_such_table")
    assert some and fresh.count() == 2


def test_write_new(spark, database):
    tables.create_tables(spark, database)
    table = tables.full_name(database, "dim_airlines")
    batch = spark.createDataFrame([("AA", "American"), ("DL", None)], TABLES["dim_airlines"].ddl)
    assert tables.write_new(batch, table)
    assert not tables.write_new(batch, table)
    renamed = spark.createDataFrame([("AA", "American Airlines"), ("UA", "United")], TABLES["dim_airlines"].ddl)
    assert tables.write_new(renamed, table, keys=["iata_code"])
    assert rows(spark.table(table)) == [("AA", "American"), ("DL", None), ("UA", "United")]
    assert tables.write_new(renamed, table)
    assert rows(spark.table(table).where("iata_code = 'AA'")) == [("AA", "American"), ("AA", "American Airlines")]
    assert not tables.write_new(renamed, table, keys=["iata_code"])
    assert tables.write_new(batch, table, mode="overwrite")
    assert rows(spark.table(table)) == rows(batch)
    with pytest.raises(ValueError, match="upsert"):
        tables.write_new(batch, table, mode="upsert")


def test_write_new_creates_a_missing_table(spark, database):
    table = tables.full_name(database, "other")
    assert tables.write_new(spark.range(3).toDF("n"), table)
    assert not tables.write_new(spark.range(3).toDF("n"), table)
    assert spark.table(table).count() == 3


def test_overwrite_may_read_its_target(spark, database):
    table = tables.full_name(database, "numbers")
    tables.write_new(spark.range(10).toDF("n"), table)
    tables.replace_content(spark.table(table).where("n > 6"), table)
    assert [r[0] for r in rows(spark.table(table))] == [7, 8, 9]
    assert names(spark, database) == ["numbers"]


def test_delete_rewrites_only_months_with_matches(spark, fact):
    tables.append(silver_frame(spark, JANUARY + FEBRUARY), fact)
    before = set(tables.only_months(spark.table(fact), ["2015-01"]).inputFiles())
    tables.delete_where(spark, fact, "date = DATE '2015-02-03'")
    assert spark.table(fact).count() == 3
    assert before == set(tables.only_months(spark.table(fact), ["2015-01"]).inputFiles())
    tables.delete_where(spark, fact, "date = DATE '2015-02-04'")
    assert tables.stored_months(spark, fact) == ["2015-01"]
    tables.delete_where(spark, fact, "date = DATE '1999-01-01'")
    assert spark.table(fact).count() == 2


def test_delete_keeps_rows_where_the_predicate_is_unknown(spark, fact):
    tables.append(silver_frame(spark, [silver_row(departure_delay=None), silver_row(departure_delay=30)]), fact)
    tables.delete_where(spark, fact, "departure_delay > 20")
    assert [r.departure_delay for r in spark.table(fact).collect()] == [None]


def test_delete_without_layout(spark, database):
    table = tables.full_name(database, "numbers")
    tables.write_new(spark.createDataFrame([(1,), (2,), (None,)], "n INT"), table)
    tables.delete_where(spark, table, "n > 1")
    assert rows(spark.table(table)) == [(None,), (1,)]


def test_drop_table(spark, fact, database):
    tables.drop_table(spark, fact)
    tables.drop_table(spark, fact)
    assert "fact_flights" not in names(spark, database)


def test_view_of_a_relation(spark):
    tables.register_view(spark.range(3), "three")
    assert spark.table("three").count() == 3


@pytest.mark.parametrize("scope", ["table", "months"])
def test_publish_and_repeat(spark, fact, database, scope):
    assert write_audit_publish(silver_frame(spark, JANUARY), fact, audit_scope=scope)
    assert not write_audit_publish(silver_frame(spark, JANUARY), fact, audit_scope=scope)
    assert write_audit_publish(silver_frame(spark, JANUARY + FEBRUARY), fact, audit_scope=scope)
    assert rows(tables.read_table(spark, fact)) == rows(silver_frame(spark, JANUARY + FEBRUARY))
    assert tables.stored_months(spark, fact) == ["2015-01", "2015-02"]
    assert names(spark, database) == sorted(TABLES)


@pytest.mark.parametrize(
    ("bad", "scope"),
    [
        (dict(distance=-1), "table"), (dict(airline="ZZ"), "months"), (dict(cancelled=2), "table"),
        (dict(date=None), "months"), (dict(distance=None), "table"),
    ],
)
def test_failed_audit_changes_nothing(spark, fact, database, bad, scope):
    write_audit_publish(silver_frame(spark, JANUARY), fact)
    with pytest.raises(AuditFailed, match="aborted") as failure:
        write_audit_publish(silver_frame(spark, FEBRUARY + [silver_row(flight_number=9) | bad]), fact, audit_scope=scope)
    assert failure.value.outcome.status == "Error"
    assert rows(tables.read_table(spark, fact)) == rows(silver_frame(spark, JANUARY))
    assert names(spark, database) == sorted(TABLES)


def test_duplicates_within_the_batch_fail_the_audit(spark, fact):
    with pytest.raises(ValueError, match="uniqueness"):
        write_audit_publish(silver_frame(spark, [silver_row(), silver_row(origin_airport="PHL")]), fact)
    assert spark.table(fact).count() == 0


def test_changed_row_of_a_known_key_is_ignored(spark, fact):
    write_audit_publish(silver_frame(spark, JANUARY), fact)
    assert not write_audit_publish(silver_frame(spark, [silver_row(distance=7)]), fact)
    assert rows(tables.read_table(spark, fact)) == rows(silver_frame(spark, JANUARY))


def test_empty_batch(spark, fact):
    assert not write_audit_publish(silver_frame(spark, JANUARY).where("false"), fact)


def test_stage_of_a_crashed_run_is_replaced(spark, fact, database):
    tables.create_like(silver_frame(spark, FEBRUARY), tables.sibling(fact, "audit"), True)
    assert write_audit_publish(silver_frame(spark, JANUARY), fact)
    assert rows(tables.read_table(spark, fact)) == rows(silver_frame(spark, JANUARY))


def test_missing_table_is_created(spark, database):
    table = tables.full_name(database, "fact_flights")
    assert write_audit_publish(silver_frame(spark, JANUARY), table)
    assert tables.stored_months(spark, table) == ["2015-01"]


def test_unknown_options(spark, fact):
    flights = silver_frame(spark, JANUARY)
    with pytest.raises(ValueError, match="mode"):
        write_audit_publish(flights, fact, mode="upsert")
    with pytest.raises(ValueError, match="audit_scope"):
        write_audit_publish(flights, fact, audit_scope="rows")
    with pytest.raises(ValueError, match="no rules"):
        write_audit_publish(flights, "somewhere.else")


def test_aggregate_is_replaced_per_group(spark, database):
    tables.create_tables(spark, database)
    table = tables.full_name(database, "agg_fact_flights")
    first = levels.gold(silver_frame(spark, JANUARY))
    both = levels.gold(silver_frame(spark, JANUARY + FEBRUARY))
    assert write_audit_publish(first, table, mode="replace")
    assert not write_audit_publish(first, table, mode="replace")
    assert write_audit_publish(both, table, mode="replace")
    assert rows(spark.table(table)) == rows(both)


def test_aggregate_insert_only_keeps_stored_groups(spark, database):
    tables.create_tables(spark, database)
    table = tables.full_name(database, "agg_fact_flights")
    first = levels.gold(silver_frame(spark, JANUARY))
    both = levels.gold(silver_frame(spark, JANUARY + FEBRUARY))
    write_audit_publish(first, table)
    assert write_audit_publish(both, table)
    assert rows(spark.table(table)) == rows(existing.merge_insert_only(first, both, TABLES["agg_fact_flights"].key))


@pytest.fixture
def data_dir(spark, tmp_path):
    raw_frame(spark).write.csv(str(tmp_path / "flights.csv"), header=True)
    (tmp_path / "airlines.csv").write_text("IATA_CODE,AIRLINE\nAA,American\nDL,Delta\nUA,United\n")
    (tmp_path / "airports.csv").write_text("IATA_CODE,AIRPORT,CITY,STATE,COUNTRY,LATITUDE,LONGITUDE\n"
                                           "BOS,Logan,Boston,MA,USA,42.36,-71.0\n")
    (tmp_path / "cancellation_codes.csv").write_text("CANCELLATION_REASON,CANCELLATION_DESCRIPTION\nB,Weather\n")
    return str(tmp_path)


def test_pipeline(spark, database, data_dir):
    done = pipeline.run(spark, data_dir, database)
    assert done == {name: True for name in TABLES}
    read = lambda name: tables.read_table(spark, tables.full_name(database, name))
    assert read("fact_flights").count() == 9
    assert read("dim_dates").count() == 365
    assert read("dim_airlines").count() == 3
    expected = levels.gold(read("fact_flights"))
    assert rows(read("agg_fact_flights")) == rows(expected)
    assert pipeline.run(spark, data_dir, database, audit_scope="months") == {name: False for name in TABLES}
    assert rows(read("agg_fact_flights")) == rows(expected)


def test_pipeline_with_more_years(spark, database, data_dir, tmp_path_factory):
    pipeline.run(spark, data_dir, database)
    from tests.helpers import RAW, raw_row

    more = tmp_path_factory.mktemp("more")
    raw_frame(spark, RAW + [raw_row(year=2016, month=2, day=29)]).write.csv(str(more / "flights.csv"), header=True)
    for file in ("airlines.csv", "airports.csv", "cancellation_codes.csv"):
        (more / file).write_text(open(f"{data_dir}/{file}").read())
    done = pipeline.run(spark, str(more), database)
    assert [name for name, written in done.items() if written] == ["fact_flights", "dim_dates", "agg_fact_flights"]
    read = lambda name: tables.read_table(spark, tables.full_name(database, name))
    assert read("dim_dates").count() == 365 + 366
    assert rows(read("agg_fact_flights")) == rows(levels.gold(read("fact_flights")))


def test_silver_of_raw_publishes(spark, fact):
    flights = to_silver(raw_frame(spark)).dropDuplicates(["flight_number"])
    assert write_audit_publish(flights, fact)


def test_replace_rewrites_only_the_months_of_the_batch(spark, fact):
    write_audit_publish(silver_frame(spark, JANUARY + FEBRUARY), fact)
    january = set(tables.only_months(spark.table(fact), ["2015-01"]).inputFiles())
    changed = [silver_row(date=dt.date(2015, 2, 3), distance=7), silver_row(date=dt.date(2015, 3, 1))]
    for scope in ("table", "months"):
        assert write_audit_publish(silver_frame(spark, changed), fact, mode="replace", audit_scope=scope) == (
            scope == "table"
        )
    expected = silver_frame(spark, JANUARY + FEBRUARY[1:] + changed)
    assert rows(tables.read_table(spark, fact)) == rows(expected)
    assert january == set(tables.only_months(spark.table(fact), ["2015-01"]).inputFiles())


def test_key_without_date_is_compared_across_months(spark, fact):
    config = {"fact_flights": {"uniqueness": ["flight_number"]}}
    key = ["flight_number"]
    write_audit_publish(silver_frame(spark, JANUARY), fact, key, rules=config)
    moved = [silver_row(date=dt.date(2015, 2, 3)), silver_row(date=dt.date(2015, 2, 3), flight_number=3)]
    assert write_audit_publish(silver_frame(spark, moved), fact, key, rules=config, audit_scope="months")
    assert [r[2] for r in rows(tables.read_table(spark, fact))] == [100, 2, 3]
    assert write_audit_publish(silver_frame(spark, moved), fact, key, mode="replace", rules=config)
    assert [(str(r[0]), r[2]) for r in rows(tables.read_table(spark, fact))] == [
        ("2015-01-01", 2), ("2015-02-03", 100), ("2015-02-03", 3)
    ]


def test_overwrite_is_whole_whatever_the_session_says(spark, fact):
    tables.append(silver_frame(spark, JANUARY + FEBRUARY), fact)
    with tables.overwrite_mode(spark, "dynamic"):
        tables.replace_content(silver_frame(spark, FEBRUARY), fact)
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic"
    assert rows(tables.read_table(spark, fact)) == rows(silver_frame(spark, FEBRUARY))


def test_readers_see_the_published_rows_during_the_audit(spark, fact, monkeypatch):
    from skyledger.plans import publish

    write_audit_publish(silver_frame(spark, JANUARY), fact)
    seen = []
    real = publish.verify_parts

    def watching(parts, session):
        seen.append((spark.table(fact).count(), *[df.count() for df, _ in parts]))
        return real(parts, session)

    monkeypatch.setattr(publish, "verify_parts", watching)
    more = [silver_row(flight_number=3)]
    assert write_audit_publish(silver_frame(spark, JANUARY + more), fact)
    assert seen == [(2, 3, 3)]


KEY_RULE = {"fact_flights": {"uniqueness": ["flight_number"]}}


@pytest.mark.parametrize("scope", ["table", "months"])
@pytest.mark.parametrize(
    "rules, passes",
    [
        (KEY_RULE, False),
        ({"fact_flights": {"aggregate": [(["cancelled"], "count(*) <= 2")]}}, False),
        ({"fact_flights": {"mostly": [{"at_least": 0.9, "completeness": ["tail_number"]}]}}, False),
        ({"fact_flights": {"mostly": [{"at_least": 0.6, "completeness": ["tail_number"]}]}}, True),
    ],
)
def test_rules_beyond_a_month_see_the_whole_table(spark, fact, scope, rules, passes):
    stored = [silver_row(tail_number="N1"), silver_row(flight_number=2, tail_number="N2")]
    assert write_audit_publish(silver_frame(spark, stored), fact, rules={"fact_flights": {}})
    late = silver_frame(spark, [silver_row(date=dt.date(2015, 2, 3), tail_number=None)])
    if passes:
        assert write_audit_publish(late, fact, rules=rules, audit_scope=scope)
        assert spark.table(fact).count() == 3
    else:
        with pytest.raises(AuditFailed):
            write_audit_publish(late, fact, rules=rules, audit_scope=scope)
        assert spark.table(fact).count() == 2


def test_a_first_load_that_fails_leaves_no_table(spark, database):
    table = tables.full_name(database, "fact_flights")
    with pytest.raises(AuditFailed):
        write_audit_publish(silver_frame(spark, [silver_row(distance=-1)]), table)
    assert names(spark, database) == []


def test_synchronizing_removes_what_is_gone(spark, database):
    table = tables.full_name(database, "agg_fact_flights")
    facts = silver_frame(spark, JANUARY + [silver_row(airline="DL")])
    assert write_audit_publish(levels.gold(facts), table, mode="sync")
    assert not write_audit_publish(levels.gold(facts), table, mode="sync")
    left = levels.gold(facts.where("airline = 'AA'"))
    assert write_audit_publish(left, table, mode="sync")
    assert rows(tables.read_table(spark, table)) == rows(left)


def test_new_rows_of_one_new_key_are_one(spark, database):
    table = tables.full_name(database, "dim_airlines")
    airlines = spark.createDataFrame([("AA", "American"), ("AA", "Americana"), ("DL", "Delta")], "iata_code STRING, airline STRING")
    assert tables.write_new(airlines, table, keys=["iata_code"])
    assert rows(spark.table(table).select("iata_code")) == [("AA",), ("DL",)]
    assert not tables.write_new(airlines, table, keys=["iata_code"])
    assert not tables.write_new(airlines.limit(0), tables.full_name(database, "dim_airports"))


def test_a_missing_fact_table_is_created_by_month(spark, database):
    table = tables.full_name(database, "fact_flights")
    assert tables.write_new(silver_frame(spark, JANUARY), table)
    assert tables.stored_months(spark, table) == ["2015-01"]
