"""Stored cells and metric states: equal to the whole table after every change, made from the touched months alone."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators.levels import gold, gold_from_cells
from skyledger.plans import metrics, publish, states
from skyledger.quality import constraints as c
from skyledger.quality.verify import verify
from skyledger.schemas import MONTH_COLUMN
from skyledger.sources import tables
from tests.helpers import plan, rows, silver_frame, silver_row


def flights(spark, *parts):
    """(year, month, airline, number of flights) each, one a day."""
    import datetime as dt

    data = [
        silver_row(date=dt.date(y, m, 1 + n % 28), airline=a, flight_number=n, departure_delay=n - 3, is_delayed=int(n > 3))
        for y, m, a, count in parts
        for n in range(count)
    ]
    return silver_frame(spark, data)


RULES = {"fact_flights": {"uniqueness": ["date", "airline", "flight_number"], "mostly": [{"at_least": 0.5, "non_negative": ["departure_delay"]}],
                          "completeness": ["date"]}}


@pytest.fixture
def loaded(spark, database):
    fact = f"{database}.fact_flights"
    store = states.cell_store(spark, fact, f"{database}.cells")
    publish.write_audit_publish(
        flights(spark, (2015, 1, "AA", 9), (2015, 2, "DL", 8), (2016, 1, "AA", 9)), fact, before_write=store.note, rules=RULES
    )
    return fact, store


def same(spark, fact, store):
    assert rows(gold_from_cells(store.read().drop(MONTH_COLUMN))) == rows(gold(tables.read_table(spark, fact)))


def test_cells_follow_loads_and_deletes(spark, loaded):
    fact, store = loaded
    assert store.refresh() == ["2015-01", "2015-02", "2016-01"]
    same(spark, fact, store)
    publish.write_audit_publish(flights(spark, (2015, 2, "UA", 10)), fact, before_write=store.note, rules=RULES)
    assert store.refresh() == ["2015-02"]
    same(spark, fact, store)
    tables.delete_where(spark, fact, "date < DATE '2015-02-01'", before_write=store.note)
    assert store.refresh() == ["2015-01"]
    assert "2015-01" not in tables.stored_months(spark, store.table)
    same(spark, fact, store)
    assert store.refresh() == []


def test_an_interrupted_run_is_made_up_for(spark, loaded):
    fact, store = loaded
    store.refresh()
    store.note(["2015-02"])
    tables.append(flights(spark, (2015, 2, "HA", 5)), fact)
    # The run ends here; another one, with a load of its own, finds the month in the journal.
    later = states.cell_store(spark, fact, store.table)
    publish.write_audit_publish(flights(spark, (2016, 3, "AA", 9)), fact, before_write=later.note, rules=RULES)
    assert later.refresh() == ["2015-02", "2016-03"]
    same(spark, fact, later)


def test_only_touched_months_are_read(spark, loaded):
    fact, store = loaded
    made = plan(store.made(["2015-02"]))
    assert f"{MONTH_COLUMN}" in made and "2015-02" in made.split("PartitionFilters")[1].split("]")[0]


CHECK = c.Check(
    "all kinds",
    (
        c.uniqueness(["date", "airline", "flight_number"]),
        c.uniqueness(["airline", "flight_number"], c.at_least(0.1)),
        c.uniqueness(["flight_number"]),
        c.completeness("tail_number", c.at_least(0.2)),
        c.non_negative("departure_delay", c.at_least(0.5)),
        c.holds_overall(["cancelled"], "count(*) = count_if(cancelled = 1) + count_if(cancelled = 0)"),
        c.holds_overall(["departure_delay"], "sum(departure_delay) / count(departure_delay) > 2"),
    ),
)
SHOWN = ["rule", "columns", "metric", "passed"]


def test_states_equal_the_verification_of_the_table(spark, loaded):
    fact, _ = loaded
    state = metrics.MetricStates(spark, fact, fact.replace("fact_flights", "metrics"), [CHECK])
    state.refresh()
    more = flights(spark, (2015, 2, "DL", 12), (2017, 5, "AA", 2))
    for batch in (None, more):
        if batch is not None:
            months = ["2015-02", "2017-05"]
            after = tables.only_months(spark.table(fact), months).drop(MONTH_COLUMN).unionByName(batch)
            expected = verify(tables.read_table(spark, fact).unionByName(batch), [CHECK]).rows
            assert rows(state.metrics_after(after, months).select(SHOWN)) == sorted([tuple(r[x] for x in SHOWN) for r in expected], key=lambda r: [(v is not None, str(v)) for v in r])
            state.note(months)
            tables.append(batch, fact)
            assert state.refresh() == months
        expected = verify(tables.read_table(spark, fact), [CHECK]).results
        found = state.metrics()
        assert rows(found.select("passed", "constraint")) == sorted(((r["constraint_status"] == "Success", r["constraint"]) for r in expected.collect()), key=lambda r: [(v is not None, str(v)) for v in r])


def test_audit_by_state(spark, database):
    fact = f"{database}.fact_flights"
    load = lambda batch: publish.write_audit_publish(batch, fact, ["date", "airline", "flight_number"], rules=RULES, audit_scope="state")
    assert load(flights(spark, (2015, 1, "AA", 9), (2015, 2, "DL", 9)))
    assert load(flights(spark, (2015, 2, "AA", 9)))
    assert not load(flights(spark, (2015, 2, "AA", 9)))
    early = flights(spark, (2015, 3, "AA", 9)).withColumn("departure_delay", F.lit(-5)).withColumn("is_delayed", F.lit(0))
    assert load(early.where("flight_number < 4"))
    before = rows(spark.table(fact))
    # Half of all rows would have negative delays; the other months count by their state.
    with pytest.raises(publish.AuditFailed):
        load(flights(spark, (2015, 4, "AA", 28)).withColumn("departure_delay", F.lit(-5)))
    assert rows(spark.table(fact)) == before


def test_additive_parts():
    condition, parts = metrics.additive_parts("count(*) = count_if(a = (1)) + sum(coalesce(b, 0))")
    assert condition == "p0 = p1 + p2"
    assert parts == ["count(*)", "count_if(a = (1))", "sum(coalesce(b, 0))"]
    for unfit in ("avg(a) > 1", "count(*) > max(a)", "a > 1"):
        with pytest.raises(ValueError):
            metrics.additive_parts(unfit)
