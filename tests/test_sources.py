import datetime as dt

import pytest
from pyspark.testing import assertDataFrameEqual

from skyledger import schemas
from skyledger.sources import calendar, files
from tests.helpers import raw_frame, rows

# The federal holidays of 2015 as published.
HOLIDAYS_2015 = [
    ("2015-01-01", "New Year's Day"),
    ("2015-01-19", "Martin Luther King Jr. Day"),
    ("2015-02-16", "Presidents' Day"),
    ("2015-05-25", "Memorial Day"),
    ("2015-07-04", "Independence Day"),
    ("2015-09-07", "Labor Day"),
    ("2015-10-12", "Columbus Day"),
    ("2015-11-11", "Veterans Day"),
    ("2015-11-26", "Thanksgiving Day"),
    ("2015-12-25", "Christmas Day"),
]


def test_csv_round_trip(spark, tmp_path):
    people = spark.createDataFrame([("Mara", 41), ("Ivo", None), ("Ümit", 7)], "name STRING, age INT")
    files.write_csv(people, str(tmp_path / "people"))
    assertDataFrameEqual(files.read_csv(spark, str(tmp_path / "people"), people.schema), people)


def test_cell_that_does_not_parse_becomes_null(spark, tmp_path):
    (tmp_path / "people.csv").write_text("name,age\nMara,many\nIvo,19\n")
    people = files.read_csv(spark, str(tmp_path / "people.csv"), "name STRING, age INT")
    assert rows(people) == [("Ivo", 19), ("Mara", None)]


def test_names_come_from_the_schema_and_not_from_the_header(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("IATA_CODE,AIRLINE\nAA,American\n")
    assert files.read_csv(spark, str(tmp_path / "codes.csv"), schemas.AIRLINES).columns == ["iata_code", "airline"]


def test_raw_folder(spark, tmp_path):
    raw_frame(spark).coalesce(1).write.csv(str(tmp_path / "flights.csv"), header=True)
    (tmp_path / "airlines.csv").write_text("IATA_CODE,AIRLINE\nAA,American\nDL,Delta\n")
    (tmp_path / "airports.csv").write_text("IATA_CODE,AIRPORT,CITY,STATE,COUNTRY,LATITUDE,LONGITUDE\n"
                                           "BOS,Logan,Boston,MA,USA,42.36,-71.0\n")
    (tmp_path / "cancellation_codes.csv").write_text("CANCELLATION_REASON,CANCELLATION_DESCRIPTION\nB,Weather\n")
    raw = files.read_raw(spark, str(tmp_path))
    assert {name: df.count() for name, df in raw.items()} == {
        "flights": 10, "airlines": 2, "airports": 1, "cancellation_codes": 1
    }
    assert len(raw["flights"].columns) == 31
    assertDataFrameEqual(raw["flights"], raw_frame(spark))


def test_calendar_of_2015(spark):
    days = calendar.calendar(spark)
    assert days.count() == 365
    assert days.columns == [
        "date", "year", "month", "day", "day_of_week", "quarter", "holiday_name", "is_holiday"
    ]
    assert dict(days.dtypes)["is_holiday"] == "boolean"
    assert days.where("NOT is_holiday AND holiday_name IS NOT NULL").count() == 0
    bounds = days.selectExpr("min(date)", "max(date)").first()
    assert tuple(bounds) == (dt.date(2015, 1, 1), dt.date(2015, 12, 31))
    named = [(str(r.date), r.holiday_name) for r in days.where("is_holiday").orderBy("date").collect()]
    assert named == HOLIDAYS_2015
    assert tuple(days.first()) == (dt.date(2015, 1, 1), 2015, 1, 1, 5, 1, "New Year's Day", True)


def test_calendar_of_any_years(spark):
    days = calendar.calendar(spark, dt.date(1999, 12, 31), dt.date(2000, 3, 1))
    assert days.count() == 62
    assert days.where("date = '2000-02-29'").first().quarter == 1
    assert calendar.calendar(spark, dt.date(2000, 1, 2), dt.date(2000, 1, 1)).count() == 0


@pytest.mark.parametrize(
    "day, name",
    [
        ("2021-05-31", "Memorial Day"),
        ("2021-06-19", "Juneteenth"),
        ("2020-06-19", None),
        ("1985-01-21", None),
        ("1986-01-20", "Martin Luther King Jr. Day"),
        ("1970-05-30", "Memorial Day"),
        ("1970-02-22", "Presidents' Day"),
        ("1970-10-12", None),
        ("1975-10-27", "Veterans Day"),
        ("1975-11-11", None),
        ("1978-11-11", "Veterans Day"),
        ("1939-11-23", "Thanksgiving Day"),
        ("1939-11-30", None),
        ("1940-11-21", "Thanksgiving Day"),
        ("1938-11-24", "Thanksgiving Day"),
        ("0100-12-25", None),
    ],
)
def test_holidays_follow_the_rules_of_their_year(spark, day, name):
    found = spark.sql(f"SELECT DATE'{day}' AS date").select(calendar.federal_holiday().alias("name"))
    assert found.first().name == name


def test_calendar_before_the_year_1000(spark):
    days = calendar.calendar(spark, dt.date(100, 2, 27), dt.date(100, 3, 2))
    assert [(r.year, r.month, r.day) for r in days.collect()] == [(100, 2, 27), (100, 2, 28), (100, 3, 1), (100, 3, 2)]


def test_own_holidays(spark):
    days = calendar.calendar(spark, dt.date(2015, 3, 1), dt.date(2015, 3, 31), [("2015-03-17", "St. Patrick's Day")])
    assert [r.day for r in days.where("is_holiday").collect()] == [17]


def test_calendar_covers_the_dates_of_a_relation(spark):
    dated = spark.createDataFrame([(dt.date(2016, 2, 28),), (dt.date(2016, 3, 1),), (None,)], "date DATE")
    days = calendar.calendar_covering(dated)
    assert [str(r.date) for r in days.orderBy("date").collect()] == ["2016-02-28", "2016-02-29", "2016-03-01"]
    assert calendar.calendar_covering(dated.where("false")).count() == 0


def test_shared_folder_is_below_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = files.shared_folder(spark, "x"), files.shared_folder(spark, "x")
    assert first.startswith(root) and first != second


def test_gold_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "gold"))
    assert files.read_gold(spark, str(tmp_path / "gold")).count() == 3


def test_schemas_fit_together(spark):
    assert schemas.ddl_columns(schemas.FLIGHTS)[0] == "date"
    assert schemas.ddl_columns(schemas.FLIGHTS)[-1] == "is_delayed"
    assert len(schemas.ddl_columns(schemas.FLIGHTS)) == 29
    assert len(schemas.ddl_columns(schemas.GOLD)) == 21
    with pytest.raises(KeyError):
        schemas.TABLES["dim_cancellation_reasons"]


def test_literal_table(spark):
    data = [(f"it's {n}", n, None if n % 2 else n / 2) for n in range(40)]
    found = files.literal_table(spark, data, "s STRING, n INT, x DOUBLE")
    assert sorted(rows(found), key=str) == sorted(data, key=str)
    assert found.dtypes == [("s", "string"), ("n", "int"), ("x", "double")]
    assert files.literal_table(spark, [], "s STRING").count() == 0
