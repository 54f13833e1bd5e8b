import datetime as dt

import pytest

from skyledger.operators import levels
from skyledger.operators.silver import to_silver
from skyledger.quality import constraints as c
from skyledger.quality import profile, rules, suggest
from skyledger.quality.verify import check_table, verify
from skyledger.schemas import TABLES
from skyledger.sources.calendar import calendar
from tests.helpers import plan, raw_frame, rows, silver_frame, silver_row


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([("val1", "val2", 1), ("val3", "val4", 2)], "col1 STRING, col2 STRING, col3 BIGINT")


CONFIG = {
    "uniqueness": ["col1"],
    "completeness": ["col2"],
    "non_negative": ["col3"],
    "containment": {"col1": ["val1", "val3"]},
}


def metric(df, *constraints):
    return [r.metric for r in c.constraint_metrics(df, [c.Check("t", constraints)]).orderBy("number").collect()]


def test_rules_are_compiled_in_order():
    shuffled = dict(reversed(CONFIG.items()))
    assert [k.rule for k in rules.compile_rules(shuffled)] == list(CONFIG)
    assert [k.columns for k in rules.compile_rules({"completeness": ["a", "b"]})] == [("a",), ("b",)]
    assert rules.compile_rules({"uniqueness": ["a", "b"]})[0].columns == ("a", "b")
    assert rules.compile_rules({}) == []
    with pytest.raises(ValueError, match="freshness"):
        rules.compile_rules({"freshness": ["date"]})


def test_sample_passes(sample):
    outcome = check_table(sample, "sample", {"sample": CONFIG})
    assert outcome.status == "Success" and outcome.passed and outcome.failures == []
    assert outcome.results.columns == [
        "check", "check_level", "check_status", "constraint", "constraint_status", "constraint_message"
    ]
    assert outcome.results.count() == 4


def test_predicates_let_null_pass(spark):
    frame = spark.createDataFrame([(None, None), (1, "a"), (-1, "b")], "n INT, s STRING")
    assert metric(frame, c.non_negative("n"), c.contained_in("s", ["a"]), c.in_range("n", 0, 5), c.matches("s", "[a]"))
    assert metric(frame, c.non_negative("n")) == [2 / 3]
    assert metric(frame, c.contained_in("s", ["a"])) == [2 / 3]
    assert metric(frame, c.in_range("n", 0, 5)) == [2 / 3]
    assert metric(frame, c.matches("s", "a")) == [2 / 3]
    assert metric(frame, c.satisfies(["n"], "n > 0")) == [2 / 3]
    assert metric(frame, c.completeness("n")) == [2 / 3]


def test_flags_may_be_listed_as_text(spark):
    assert metric(spark.createDataFrame([(0,), (1,), (2,)], "flag INT"), c.contained_in("flag", ["0", "1"])) == [2 / 3]


def test_numbers_that_fit_no_decimal(spark):
    numbers = spark.createDataFrame([(-1e30,), (float("-inf"),), (float("inf"),), (1e300,), (None,)], "x DOUBLE")
    assert metric(numbers, c.non_negative("x")) == [3 / 5]
    texts = spark.createDataFrame([("-5e40",), ("-abc",), ("abc",), ("7",), ("5e40",), (None,)], "t STRING")
    assert metric(texts, c.non_negative("t")) == [3 / 6]


def test_fractional_flags(spark):
    flags = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,)], "flag DOUBLE")
    assert metric(flags, c.contained_in("flag", ["0", "1"])) == [3 / 4]
    assert metric(flags.selectExpr("CAST(flag AS DECIMAL(5,2)) AS flag"), c.contained_in("flag", [0, 1])) == [3 / 4]


def test_a_line_break_at_the_end_is_no_match(spark):
    assert metric(spark.createDataFrame([("AA",), ("AA\n",)], "code STRING"), c.matches("code", "[A-Z]{2}")) == [0.5]


def test_containment_in_a_relation(spark):
    words = spark.range(1000).selectExpr("if(id < 900, concat('w', id), NULL) AS word")
    known = spark.range(450).selectExpr("concat('w', id) AS value")
    assert metric(words, c.contained_in_relation("word", known, 450)) == [0.55]


def test_values_with_quotes(spark):
    frame = spark.createDataFrame([("O'Hare",), ("back\\slash",)], "name STRING")
    assert metric(frame, c.contained_in("name", ["O'Hare", "back\\slash"])) == [1.0]


def test_counts_beyond_the_width_of_a_short_decimal(spark):
    assert metric(spark.createDataFrame([(10**15,), (-(10**15),)], "n BIGINT"), c.non_negative("n")) == [0.5]


def test_patterns_match_whole_values(spark):
    codes = spark.createDataFrame([("AA",), ("AAA",), ("A1",)], "code STRING")
    assert metric(codes, c.matches("code", "[A-Z]{2}")) == [1 / 3]


def test_uniqueness_counts_rows_with_a_key_of_their_own(spark):
    keys = spark.createDataFrame([(1, None), (1, None), (1, 2), (3, 4)], "a INT, b INT")
    assert metric(keys, c.uniqueness(["a", "b"])) == [0.5]
    assert metric(keys, c.uniqueness(["a"]), c.uniqueness(["b"])) == [0.25, 0.5]


def test_aggregate_condition(spark):
    frame = spark.createDataFrame([(1, "A"), (0, None), (1, None)], "cancelled INT, reason STRING")
    holds = c.holds_overall(["cancelled", "reason"], "count(*) = count_if(cancelled = 1) + count_if(reason IS NULL)")
    assert metric(frame, holds) == [0.0]
    assert metric(frame.where("NOT (cancelled = 1 AND reason IS NULL)"), holds) == [1.0]


def test_tolerance_and_levels(spark):
    frame = spark.createDataFrame([("",)] * 98 + [("A",)] * 2, "reason STRING")
    mostly = c.contained_in("reason", [""], c.at_least(0.98))
    strictly = c.contained_in("reason", [""])
    assert verify(frame, [c.Check("mostly", (mostly,))]).status == "Success"
    assert verify(frame, [c.Check("strict", (strictly,), "Warning")]).status == "Warning"
    both = verify(frame, [c.Check("mostly", (mostly,)), c.Check("strict", (strictly,))])
    assert both.status == "Error"
    assert [(r.check, r.check_status, r.constraint_status) for r in both.results.collect()] == [
        ("mostly", "Success", "Success"), ("strict", "Error", "Failure")
    ]
    assert verify(frame, [c.Check("none").and_also(mostly)]).passed


def test_own_assertion(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "n INT")
    assert verify(frame, [c.Check("t", (c.uniqueness(["n"], lambda share: share < 0.5),))]).passed


def test_no_rows_is_a_failure(sample):
    outcome = check_table(sample.where("false"), "sample", {"sample": CONFIG})
    assert outcome.status == "Error" and len(outcome.failures) == 4


def test_no_rules_is_a_success(sample):
    assert check_table(sample, "dim_dates").passed


def test_unknown_table_and_missing_columns(sample):
    with pytest.raises(ValueError, match="elsewhere"):
        check_table(sample, "elsewhere")
    with pytest.raises(ValueError, match="airline"):
        check_table(sample, "fact_flights")


def test_one_pass_for_all_row_constraints(sample):
    many = tuple(k for k in rules.compile_rules(CONFIG) if not k.is_uniqueness) * 3
    assert plan(c.constraint_metrics(sample, [c.Check("t", many)])).count("Scan ") == 1


def test_configuration_covers_every_table():
    assert set(rules.TABLE_RULES) == set(rules.DESIGN_RULES) == set(TABLES)
    fact, agg = rules.TABLE_RULES["fact_flights"], rules.TABLE_RULES["agg_fact_flights"]
    assert [len(fact[r]) for r in ("uniqueness", "completeness", "containment")] == [4, 11, 5]
    assert {"weather_delay", "scheduled_arrival"} <= set(fact["non_negative"]) and len(fact["non_negative"]) == 18
    assert [len(agg[r]) for r in ("completeness", "non_negative", "containment")] == [9, 13, 2]
    assert agg["containment"]["time_agg_level"] == ["all", "year", "year_month", "day_of_week"]
    assert agg["containment"]["agg_level"] == ["all", "airline", "origin_airport"]


def test_fact_rules(spark):
    good = silver_frame(spark, [silver_row(), silver_row(flight_number=2)])
    assert check_table(good, "fact_flights").passed
    bad = silver_frame(spark, [silver_row(), silver_row(), silver_row(flight_number=3, distance=-1, airline="ZZ")])
    failures = check_table(bad, "fact_flights").failures
    assert [f.split(":")[0] for f in failures] == [
        "uniqueness(date, airline, flight_number, scheduled_departure)", "non_negative(distance)", "containment(airline)"
    ]


def test_gold_rules(spark):
    gold = levels.gold(to_silver(raw_frame(spark)))
    assert check_table(gold, "agg_fact_flights").passed
    assert check_table(gold, "agg_fact_flights", rules.DESIGN_RULES).passed
    doubled = gold.union(gold.limit(1))
    assert len(check_table(doubled, "agg_fact_flights", rules.DESIGN_RULES).failures) == 1


def test_dimension_rules(spark):
    assert check_table(calendar(spark), "dim_dates", rules.DESIGN_RULES).passed
    airports = spark.createDataFrame(
        [("BOS", "Logan", "Boston", "MA", "USA", 42.4, -71.0), ("B1", "X", "Y", "Z", "USA", 91.0, None)],
        TABLES["dim_airports"].ddl,
    )
    found = [f.split(":")[0] for f in check_table(airports, "dim_airports", rules.DESIGN_RULES).failures]
    assert found == ["completeness(longitude)", "range(latitude)", "pattern(iata_code)"]
    airlines = spark.createDataFrame([("AA", "American"), ("AA", "Again")], TABLES["dim_airlines"].ddl)
    assert len(check_table(airlines, "dim_airlines", rules.DESIGN_RULES).failures) == 1
    codes = spark.createDataFrame([("E", "Else")], TABLES["dim_cancellation_codes"].ddl)
    assert len(check_table(codes, "dim_cancellation_codes", rules.DESIGN_RULES).failures) == 1


def test_flight_design_rules(spark):
    parts = dict(air_system_delay=1, security_delay=1, airline_delay=1, late_aircraft_delay=1, weather_delay=1)
    good = silver_frame(spark, [silver_row(departure_delay=5, **parts), silver_row(departure_delay=None)])
    assert check_table(good, "fact_flights", rules.DESIGN_RULES).passed
    bad = silver_frame(spark, [silver_row(departure_delay=6, **parts), silver_row(cancelled=1)])
    assert len(check_table(bad, "fact_flights", rules.DESIGN_RULES).failures) == 2


def test_only_columns():
    check = rules.only_columns(rules.table_check("fact_flights"), ["airline", "cancelled"])
    assert {k.columns for k in check.constraints} == {("airline",), ("cancelled",)}


MIXED = [
    ("1", "a", 1.5, 1, True, dt.date(2015, 1, 1)),
    ("2", "a", None, 2, False, None),
    ("3", "a", 2.5, -3, True, dt.date(2015, 1, 2)),
    (None, "b", 0.0, 4, True, dt.date(2015, 1, 3)),
]
MIXED_SCHEMA = "code STRING, word STRING, share DOUBLE, number INT, flag BOOLEAN, day DATE"


def test_profile(spark):
    found = {r.column_name: r for r in profile.profile(spark.createDataFrame(MIXED, MIXED_SCHEMA)).collect()}
    assert {name: r.data_type for name, r in found.items()} == {
        "code": "Integral", "word": "String", "share": "Fractional", "number": "Integral", "flag": "Boolean",
        "day": "Unknown",
    }
    assert found["code"].type_inferred and not found["number"].type_inferred
    assert (found["code"].completeness, found["code"].minimum, found["code"].maximum) == (0.75, 1.0, 3.0)
    assert (found["word"].minimum, found["word"].mean, found["word"].percentiles) == (None, None, None)
    assert found["word"].approx_distinct == 2
    number = found["number"]
    assert (number.minimum, number.maximum, number.mean, number.total) == (-3.0, 4.0, 1.0, 4.0)
    assert number.percentiles[1] == 1.0
    assert round(number.std_dev**2, 9) == 6.5


def test_profile_of_chosen_columns(spark):
    frame = spark.createDataFrame(MIXED, MIXED_SCHEMA)
    assert [r.column_name for r in profile.profile(frame, ["word", "flag"]).collect()] == ["word", "flag"]


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["1", " -2 "], "Integral"), (["1", "2.5"], "Fractional"), (["true", "False"], "Boolean"),
        (["1", "x"], "String"), ([None], "Unknown"), (["1", "true"], "String"), (["1-URGENT", "."], "String"),
    ],
)
def test_type_of_text(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], "v STRING")
    assert profile.profile(frame).first().data_type == kind


def test_histogram(spark):
    found = profile.histogram(spark.createDataFrame(MIXED, MIXED_SCHEMA), ["word", "code", "flag"])
    assert ("word", "a", 3, 0.75) in rows(found) and ("code", "NullValue", 1, 0.25) in rows(found)
    assert found.count() == 2 + 4 + 2


def test_suggestions(spark):
    words = ["a"] * 60 + ["b"] * 35 + ["c", "c", "c", "d", "d"]
    frame = spark.createDataFrame(
        [(str(n), w, n if n % 10 else None, f"id{n}") for n, w in enumerate(words)],
        "code STRING, word STRING, number INT, label STRING",
    )
    found = {(s.column, s.rule): s for s in suggest.suggest(frame)}
    assert set(found) == {
        ("code", "complete_if_complete"), ("code", "retain_type"), ("code", "non_negative_numbers"),
        ("word", "complete_if_complete"), ("word", "categorical_range"), ("word", "fractional_categorical_range"),
        ("number", "retain_completeness"), ("number", "non_negative_numbers"), ("label", "complete_if_complete"),
    }
    assert found["word", "categorical_range"].code == "contained_in_relation('word', values, 4)"
    assert rows(found["word", "categorical_range"].constraint.values) == [("a",), ("b",), ("c",), ("d",)]
    assert found["word", "fractional_categorical_range"].code == "contained_in_relation('word', values, 2, at_least(0.9))"
    assert rows(found["word", "fractional_categorical_range"].constraint.values) == [("a",), ("b",)]
    assert found["number", "retain_completeness"].code == "completeness('number', at_least(0.84))"
    assert verify(frame, [c.Check("suggested", tuple(s.constraint for s in found.values()))]).passed


def test_single_rule_and_restricted_columns(spark):
    frame = spark.createDataFrame(MIXED, MIXED_SCHEMA)
    table = suggest.suggestions_table(frame, [suggest.complete_if_complete], ["code", "word"])
    assert rows(table.select("column_name", "rule")) == [("word", "complete_if_complete")]


@pytest.mark.parametrize("distinct", [125, 5000])
def test_ranges_of_many_values_are_suggested(spark, distinct):
    frame = spark.range(4 * distinct).selectExpr(f"concat('v', id % {distinct}) AS code")
    found = {s.rule: s for s in suggest.suggest(frame)}
    assert found["categorical_range"].description == f"code has a value range of {distinct} values"
    assert verify(frame, [c.Check("suggested", (found["categorical_range"].constraint,))]).passed
    strange = frame.union(spark.sql("SELECT 'other' AS code"))
    assert not verify(strange, [c.Check("suggested", (found["categorical_range"].constraint,))]).passed
