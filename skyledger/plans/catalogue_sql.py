"""The catalogue's queries once more, as plain SQL for an independent engine.

Written from the definitions and not from the Spark code: levels are UNION-free GROUPING SETS
over the flights themselves, duplicates use window functions, anti joins NOT EXISTS.
"""

from __future__ import annotations

from skyledger.plans.proxy import CARRIER_NAMES, REASONS
from skyledger.schemas import FLIGHTS as FACT_COLUMNS
from skyledger.schemas import ddl_fields

SQL_TYPES = {"INT": "INTEGER", "STRING": "VARCHAR", "DATE": "DATE"}

CANCELLED = "(l_returnflag = 'R' AND l_discount >= 0.09)"
FLIGHTS = f"""
flights AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS airline, CAST(l_partkey AS INTEGER) AS flight_number,
         origin.n_name AS origin_airport, destination.n_name AS destination_airport,
         l_linenumber AS scheduled_departure,
         CASE WHEN {CANCELLED} THEN NULL ELSE CAST(l_quantity AS INTEGER) - 25 END AS departure_delay,
         CASE WHEN {CANCELLED} THEN 1 ELSE 0 END AS cancelled,
         CASE WHEN {CANCELLED} THEN CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END
         END AS cancellation_reason,
         CASE WHEN NOT {CANCELLED} AND CAST(l_quantity AS INTEGER) > 25 THEN 1 ELSE 0 END AS is_delayed
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation origin ON s_nationkey = origin.n_nationkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation destination ON c_nationkey = destination.n_nationkey
)"""
COLUMNS = (
    "date, airline, flight_number, origin_airport, destination_airport, scheduled_departure, departure_delay,"
    " cancelled, cancellation_reason, is_delayed"
)
NO_DESTINATION = COLUMNS.replace(" destination_airport,", "")
KEY = "date, airline, flight_number, scheduled_departure"
SURVIVORS = f"""
survivors AS (
  SELECT {COLUMNS} FROM (
    SELECT *, row_number() OVER (
      PARTITION BY {KEY}
      ORDER BY origin_airport NULLS FIRST, destination_airport NULLS FIRST, departure_delay NULLS FIRST,
               cancelled NULLS FIRST, cancellation_reason NULLS FIRST, is_delayed NULLS FIRST
    ) AS place FROM flights
  ) WHERE place = 1
)"""
CALENDAR = """
calendar AS (
  SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(day(date) AS INTEGER) AS day, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
         CAST(quarter(date) AS INTEGER) AS quarter, holiday_name, holiday_name IS NOT NULL AS is_holiday
  FROM (
    SELECT date, CASE
      WHEN month(date) = 1 AND day(date) = 1 THEN 'New Year''s Day'
      WHEN month(date) = 1 AND dayofweek(date) = 1 AND day(date) BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
      WHEN month(date) = 2 AND dayofweek(date) = 1 AND day(date) BETWEEN 15 AND 21 THEN 'Presidents'' Day'
      WHEN month(date) = 5 AND dayofweek(date) = 1 AND day(date) > 24 THEN 'Memorial Day'
      WHEN month(date) = 7 AND day(date) = 4 THEN 'Independence Day'
      WHEN month(date) = 9 AND dayofweek(date) = 1 AND day(date) < 8 THEN 'Labor Day'
      WHEN month(date) = 10 AND dayofweek(date) = 1 AND day(date) BETWEEN 8 AND 14 THEN 'Columbus Day'
      WHEN month(date) = 11 AND day(date) = 11 THEN 'Veterans Day'
      WHEN month(date) = 11 AND dayofweek(date) = 4 AND day(date) BETWEEN 22 AND 28 THEN 'Thanksgiving Day'
      WHEN month(date) = 12 AND day(date) = 25 THEN 'Christmas Day'
    END AS holiday_name
    FROM (
      SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date
      FROM orders
    )
  )
)"""
DATED = """
dated AS (
  SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week
  FROM flights
)"""
SETS = """(), (year), (year, month), (day_of_week),
          (airline), (airline, year), (airline, year, month), (airline, day_of_week),
          (origin_airport), (origin_airport, year), (origin_airport, year, month), (origin_airport, day_of_week)"""
REASON_COUNTS = ", ".join(f"count(*) FILTER (cancellation_reason = '{r}') AS cancellations_{r}" for r in "ABCD")
REASON_SHARES = ", ".join(
    f"count(*) FILTER (cancellation_reason = '{r}') / nullif(count(*) FILTER (cancelled = 1), 0)"
    f" AS percent_cancellations_{r}"
    for r in "ABCD"
)
DELAYS = """count(*) AS total_flights, count(*) FILTER (is_delayed = 1) AS delayed_flights,
            count(*) FILTER (is_delayed = 1) / count(*) AS delayed_rate, avg(departure_delay) AS avg_delay_time"""
MEASURES = f"""{DELAYS}, count(*) FILTER (cancelled = 1) AS cancelled_flights,
            count(*) FILTER (cancelled = 1) / count(*) AS cancelled_rate, {REASON_COUNTS}, {REASON_SHARES}"""
EXTRA = """count(*) FILTER (departure_delay <= 0) AS on_time_flights,
           count(*) FILTER (departure_delay <= 0) / count(*) AS on_time_rate,
           avg(departure_delay) FILTER (is_delayed = 1) AS avg_delay_time_delayed"""
GOLD_COLUMNS = (
    ["year", "month", "day_of_week", "airline", "origin_airport", "total_flights", "delayed_flights", "delayed_rate",
     "avg_delay_time", "cancelled_flights", "cancelled_rate"]
    + [f"cancellations_{r}" for r in "ABCD"]
    + [f"percent_cancellations_{r}" for r in "ABCD"]
    + ["time_agg_level", "agg_level"]
)


def label(columns: str, used: str | None = None) -> str:
    """Level label over grouping columns; ``used`` are those in some grouping set."""
    names = [c for c in columns.split(", ") if used is None or c in used.split(", ")]
    parts = ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in names)
    return f"coalesce(nullif(concat_ws('_', {parts}), ''), 'all')"


def gold(name: str = "gold", source: str = "dated", extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT year, month, day_of_week, airline, origin_airport, {MEASURES}{', ' + extra if extra else ''},
         {label('year, month, day_of_week')} AS time_agg_level, {label('airline, origin_airport')} AS agg_level
  FROM {source} GROUP BY GROUPING SETS ({SETS})
)"""


def over_flights(select: str, *more: str) -> str:
    return f"WITH {', '.join([FLIGHTS, *more])}\n{select}"


def over_gold(select: str, *more: str) -> str:
    return over_flights(select, DATED, gold(), *more)


def delay_levels(columns: str, grouping: str, time: str, other: str, select: str = "*") -> str:
    inner = f"""SELECT {columns}, {DELAYS}, {label(time)} AS time_agg_level, {label(other)} AS agg_level
                FROM dated GROUP BY {grouping}"""
    return over_flights(f"SELECT {select} FROM ({inner})", DATED)


def reason_columns(prefix: str = "") -> str:
    names = {"A": "airline_carrier", "B": "weather", "C": "national_air_system", "D": "security"}
    return ", ".join(f"CAST(sum(cancellations_{r}) AS BIGINT) AS {n}" for r, n in names.items())


def volumes() -> str:
    return ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total_flights", "delayed_flights", "cancelled_flights")
    )


def at(time: str, dimension: str = "airline", airline: str = "%") -> str:
    return f"time_agg_level = '{time}' AND agg_level = '{dimension}'" + (
        f" AND airline LIKE '{airline}'" if dimension == "airline" else ""
    )


def means(*columns: str) -> str:
    return ", ".join(f"round(avg({c}), 9) AS {c}" for c in columns)


def values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


STATEMENTS: dict[str, str] = {
    "silver_flights": over_flights(f"SELECT {COLUMNS} FROM flights"),
    "dedup_first": over_flights(f"SELECT {COLUMNS} FROM survivors", SURVIVORS),
    "dedup_any_keys": over_flights(f"SELECT DISTINCT {KEY} FROM flights"),
    "dup_keys_having": over_flights(
        f"SELECT {KEY}, count(*) AS row_count FROM flights GROUP BY {KEY} HAVING count(*) > 1"
    ),
    "dup_rows_window": over_flights(
        f"SELECT * FROM (SELECT {COLUMNS}, count(*) OVER (PARTITION BY {KEY}) AS row_count FROM flights)"
        " WHERE row_count > 1"
    ),
    "rank_in_airline_day": over_flights(
        f"SELECT {NO_DESTINATION}, rank() OVER (PARTITION BY date, airline ORDER BY departure_delay DESC NULLS LAST)"
        " AS rank FROM flights"
    ),
    "rank_hot_key": "SELECT 'all' AS fleet, l_orderkey, l_linenumber, l_extendedprice,"
    " rank() OVER (ORDER BY l_extendedprice DESC NULLS LAST) AS rank FROM lineitem",
    "numbered_events": "SELECT event_type, event_id, user_id, CAST(ts AS DATE) AS day,"
    " row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), event_id) AS place FROM events",
    "dim_dates": f"WITH {CALENDAR} SELECT * FROM calendar",
    "flights_enriched": over_flights(
        f"SELECT {COLUMNS}, year, month, day, day_of_week, quarter, holiday_name, is_holiday"
        " FROM flights JOIN calendar USING (date)",
        CALENDAR,
    ),
    "flights_on_holidays": over_flights(
        "SELECT holiday_name, count(*) AS flights FROM flights JOIN calendar USING (date) WHERE is_holiday"
        " GROUP BY holiday_name",
        CALENDAR,
    ),
    "lookup_descriptions": over_flights(
        f"""SELECT {COLUMNS.replace('cancellation_reason', 'f.cancellation_reason').replace(' airline', ' f.airline')},
                   a.name AS airline_name, o.n_name AS origin_city, o.r_name AS origin_state,
                   r.name AS cancellation_description
            FROM flights f
            LEFT JOIN (VALUES {values(CARRIER_NAMES)}) a(code, name) ON f.airline = a.code
            LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) o
              ON f.origin_airport = o.n_name
            LEFT JOIN (VALUES {values(REASONS)}) r(code, name) ON f.cancellation_reason = r.code"""
    ),
    "gold_grouping_sets": over_gold("SELECT * FROM gold"),
    "gold_with_calendar": over_flights(
        "SELECT * FROM gold",
        CALENDAR,
        "open_days AS (SELECT * FROM flights JOIN (SELECT date, year, month, day_of_week FROM calendar"
        " WHERE NOT is_holiday) USING (date))",
        gold(source="open_days"),
    ),
    "gold_extended": over_flights(
        f"SELECT {', '.join(GOLD_COLUMNS)}, on_time_flights, on_time_rate, avg_delay_time_delayed FROM gold",
        DATED,
        gold(extra=EXTRA),
    ),
    "gold_levels": over_gold(
        "SELECT time_agg_level, agg_level, count(*) AS groups, CAST(sum(total_flights) AS BIGINT) AS flights"
        " FROM gold GROUP BY time_agg_level, agg_level"
    ),
    "gold_labels_from_nulls": over_gold(
        "SELECT year, month, day_of_week, airline, origin_airport, time_agg_level, agg_level FROM gold"
    ),
    "gold_distinct_levels": over_gold("SELECT DISTINCT agg_level FROM gold"),
    "rollup_airline_month": delay_levels(
        "year, month, airline", "ROLLUP (airline, year, month)", "year, month", "airline"
    ),
    "rollup_reason": delay_levels(
        "year, month, day_of_week, cancellation_reason, airline",
        "ROLLUP (cancellation_reason, year, month, day_of_week, airline)",
        "year, month, day_of_week",
        "cancellation_reason, airline",
    ),
    "cube_month_airline": delay_levels(
        "month, airline", "CUBE (month, airline)", "month", "airline", "month, airline, total_flights"
    ),
    "nested_cube": delay_levels(
        "year, month, day_of_week, airline",
        "GROUPING SETS (CUBE (airline, (year, month), day_of_week))",
        "year, month, day_of_week",
        "airline",
    ),
    "powerset_sets": delay_levels(
        "year, airline, origin_airport, cancelled, cancellation_reason",
        "CUBE (year, airline, origin_airport, cancelled, cancellation_reason)",
        "year",
        "airline, origin_airport, cancelled, cancellation_reason",
    )
    + " WHERE NOT (time_agg_level = 'all' AND agg_level = 'all')",
    "q01_airlines": over_gold(f"SELECT airline FROM gold WHERE {at('year')}"),
    "q02_headline": over_gold(
        f"SELECT year, {volumes()}, {means('delayed_rate', 'avg_delay_time', 'cancelled_rate')}"
        f" FROM gold WHERE {at('year')} GROUP BY year"
    ),
    "q02_headline_one_airline_year": over_gold(
        f"SELECT year, {volumes()}, {means('delayed_rate', 'avg_delay_time', 'cancelled_rate')}"
        f" FROM gold WHERE {at('year', airline='1-URGENT')} AND year = 1997 GROUP BY year"
    ),
    "q02_headline_weighted": over_flights(
        "SELECT year, count(*) AS total_flights, count(*) FILTER (is_delayed = 1) AS delayed_flights,"
        " count(*) FILTER (cancelled = 1) AS cancelled_flights,"
        " count(*) FILTER (is_delayed = 1) / count(*) AS delayed_rate,"
        " count(*) FILTER (cancelled = 1) / count(*) AS cancelled_rate FROM dated GROUP BY year",
        DATED,
    ),
    "q08_delay_by_origin": over_gold(
        "SELECT year, month, origin_airport, delayed_rate, avg_delay_time FROM gold"
        f" WHERE {at('year_month', 'origin_airport')}"
    ),
    "q08_delay_by_one_origin": over_gold(
        "SELECT year, month, origin_airport, delayed_rate, avg_delay_time FROM gold"
        f" WHERE {at('year_month', 'origin_airport')} AND origin_airport = 'NATION_7'"
    ),
    "q09_airline_reliability": over_gold(
        f"SELECT airline, delayed_rate, avg_delay_time FROM gold WHERE {at('all')} ORDER BY airline"
    ),
    "q14_full_listing": over_gold("SELECT * FROM gold"),
    "q15_totals": over_gold(f"SELECT * FROM gold WHERE {at('year', 'all')}"),
    "q15_monthly_volume": over_gold(f"SELECT year, month, total_flights FROM gold WHERE {at('year_month', 'all')}"),
    "q15_weekday_volume": over_gold(f"SELECT day_of_week, total_flights FROM gold WHERE {at('day_of_week', 'all')}"),
    "q15_delays": over_gold(f"SELECT year, delayed_rate, avg_delay_time FROM gold WHERE {at('year', 'all')}"),
    "q15_monthly_delays": over_gold(
        f"SELECT year, month, delayed_rate, avg_delay_time FROM gold WHERE {at('year_month', 'all')}"
    ),
    "q15_cancellations": over_gold(
        "SELECT year, cancelled_flights, percent_cancellations_A, percent_cancellations_B, percent_cancellations_C,"
        f" percent_cancellations_D FROM gold WHERE {at('year', 'all')}"
    ),
    "q16_on_time_rates": over_flights(
        "SELECT airline, count(*) AS total_flights, count(*) FILTER (departure_delay <= 0) AS on_time_flights,"
        " count(*) FILTER (departure_delay <= 0) / count(*) AS on_time_rate FROM flights GROUP BY airline"
    ),
    "most_reliable_topk": over_gold(
        f"SELECT airline, delayed_rate FROM gold WHERE {at('all')} ORDER BY delayed_rate, airline LIMIT 3"
    ),
    "least_reliable_topk": over_gold(
        f"SELECT airline, delayed_rate FROM gold WHERE {at('all')} ORDER BY delayed_rate DESC, airline LIMIT 3"
    ),
    "merge_insert_only_flights": over_flights(
        f"""SELECT * FROM survivors WHERE date < DATE '1999-01-01'
            UNION ALL
            SELECT * FROM survivors s WHERE NOT EXISTS (
              SELECT 1 FROM survivors t WHERE t.date < DATE '1999-01-01' AND t.date = s.date AND t.airline = s.airline
              AND t.flight_number = s.flight_number AND t.scheduled_departure = s.scheduled_departure)""",
        SURVIVORS,
    ),
    # All columns of the fact table's contract; those the batch lacks are NULL.
    "wap_two_loads": over_flights(
        "SELECT "
        + ", ".join(
            name if name in COLUMNS.split(", ") else f"CAST(NULL AS {SQL_TYPES[kind]}) AS {name}"
            for name, kind in ddl_fields(FACT_COLUMNS)
        )
        + " FROM survivors",
        SURVIVORS,
    ),
    "delete_by_predicate": over_flights(
        f"SELECT {COLUMNS} FROM flights WHERE departure_delay IS NULL OR departure_delay <= 20"
    ),
    "null_profile": over_flights(
        "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in COLUMNS.split(", ")) + " FROM flights"
    ),
    "null_by_cancelled": over_flights(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows,"
            f" count(*) FILTER ({c} IS NULL AND cancelled = 1) AS null_rows_matching FROM flights"
            for c in COLUMNS.split(", ")
        )
        + ") WHERE null_rows > 0"
    ),
    "key_counts_sorted": over_flights(
        "SELECT date, airline, flight_number, count(*) AS row_count FROM flights"
        " GROUP BY date, airline, flight_number ORDER BY date, airline, flight_number"
    ),
    "airline_delay_counts": over_flights(
        "SELECT airline, count(*) AS total_flights, count(*) FILTER (is_delayed = 1) AS delayed_flights,"
        " count(*) FILTER (is_delayed = 1) / count(*) AS delayed_rate FROM flights GROUP BY airline"
    ),
    "late_departures_by_airline": over_flights(
        "SELECT airline, count(*) AS delayed_flights FROM flights WHERE departure_delay > 0 GROUP BY airline"
    ),
    "flight_counts": over_flights(
        "SELECT count(*) AS flights, count(*) FILTER (cancelled = 1) AS cancelled_flights FROM flights"
    ),
    "date_bounds": over_flights("SELECT min(date) AS min_date, max(date) AS max_date FROM flights"),
    "flights_in_month": over_flights(f"SELECT {COLUMNS} FROM flights WHERE year(date) = 1996 AND month(date) = 3"),
    "cancelled_urgent_1996": over_flights(
        f"SELECT {COLUMNS} FROM flights WHERE airline = '1-URGENT' AND year(date) = 1996 AND cancelled = 1"
    ),
    "partition_stats": over_flights(
        "SELECT strftime(date, '%Y-%m') AS partition, count(*) AS row_count,"
        " count(*) - count(departure_delay) AS null_count, min(departure_delay) AS min_value,"
        " max(departure_delay) AS max_value FROM flights GROUP BY 1"
    ),
    "csv_round_trip": over_flights(f"SELECT {COLUMNS} FROM flights"),
    "dq_violations": over_flights(
        "SELECT 'reason_without_cancellation' AS probe, count(*) AS row_count FROM flights"
        " WHERE cancelled = 0 AND cancellation_reason IS NOT NULL"
        " UNION ALL SELECT 'cancelled_after_pushback', count(*) FROM flights"
        " WHERE cancelled = 1 AND departure_delay IS NOT NULL"
        " UNION ALL SELECT 'delay_unknown', count(*) FROM flights WHERE departure_delay IS NULL"
    ),
}

# Reports with an airline parameter, over all airlines and for one of them.
for suffix, pattern in (("", "%"), ("_one_airline", "1-URGENT")):
    monthly, weekday = at("year_month", airline=pattern), at("day_of_week", airline=pattern)
    by_month = f"SELECT year, month, {volumes()} FROM gold WHERE {monthly} GROUP BY year, month"
    by_weekday = f"SELECT year, day_of_week, {volumes()} FROM gold WHERE {weekday} GROUP BY year, day_of_week"
    unpivot = "ON total_flights, delayed_flights, cancelled_flights INTO NAME metric VALUE volume"
    yearly = f"SELECT year, {reason_columns()} FROM gold WHERE {at('year', airline=pattern)} GROUP BY year"
    by_label = " UNION ALL ".join(
        f"SELECT '{text}' AS name, {column} AS count FROM yearly"
        for text, column in (
            ("Security", "security"),
            ("National Air System", "national_air_system"),
            ("Airline/Carrier", "airline_carrier"),
            ("Weather", "weather"),
        )
    )
    STATEMENTS |= {
        f"q03_monthly_volume_long{suffix}": over_gold(
            f"SELECT * FROM (UNPIVOT volume {unpivot})", f"volume AS ({by_month})"
        ),
        f"q04_weekday_volume_long{suffix}": over_gold(
            f"SELECT * FROM (UNPIVOT volume {unpivot})", f"volume AS ({by_weekday})"
        ),
        f"q05_monthly_volume{suffix}": over_gold(by_month),
        f"q06_weekday_volume{suffix}": over_gold(by_weekday),
        f"q07_monthly_delays{suffix}": over_gold(
            f"SELECT year, month, {means('delayed_rate', 'avg_delay_time')} FROM gold WHERE {monthly}"
            " GROUP BY year, month"
        ),
        f"q10_monthly_cancellation_rates{suffix}": over_gold(
            f"SELECT year, month, {means('cancelled_rate', *[f'percent_cancellations_{r}' for r in 'ABCD'])}"
            f" FROM gold WHERE {monthly} GROUP BY year, month"
        ),
        f"q11_monthly_cancellations{suffix}": over_gold(
            "SELECT * FROM (UNPIVOT reasons ON airline_carrier, weather, national_air_system, security"
            " INTO NAME reason VALUE volume)",
            f"reasons AS (SELECT year, month, {reason_columns()} FROM gold WHERE {monthly} GROUP BY year, month)",
        ),
        f"q12_yearly_cancellations{suffix}": over_gold(by_label, f"yearly AS ({yearly})"),
    }
    if not suffix:
        STATEMENTS["q13_cancellation_shares"] = over_gold(
            f"SELECT name, count AS value FROM ({by_label})", f"yearly AS ({yearly})"
        )

STATEMENTS |= {
    "sql_nested_cube": over_flights(
        f"SELECT airline, year, month, day_of_week, {DELAYS} FROM dated"
        " GROUP BY GROUPING SETS (CUBE (airline, (year, month), day_of_week))",
        DATED,
    ),
    "sql_volume_group_by_all": STATEMENTS["q05_monthly_volume"],
    "sql_unpivot_reasons": STATEMENTS["q11_monthly_cancellations"],
    "sql_union_reasons": STATEMENTS["q12_yearly_cancellations"],
    "gold_other_levels": over_gold("SELECT * FROM gold WHERE agg_level NOT IN ('all', 'airline')"),
}

# Anti joins and merges over flights and over the aggregate of the first load against that of all flights.
SAME = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in COLUMNS.split(", "))
COMPARED = COLUMNS.replace(" cancellation_reason,", "")
EQUAL = " AND ".join(f"s.{c} = t.{c}" for c in COMPARED.split(", "))
STORED = "stored AS (SELECT * FROM flights WHERE date < DATE '1999-01-01')"
for name, shown, condition in (("anti_null_safe", COLUMNS, SAME), ("anti_plain", COMPARED, EQUAL)):
    STATEMENTS[name] = over_flights(
        f"SELECT {shown} FROM flights s WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE {condition})", STORED
    )

TWO_GOLDS = (
    DATED,
    "dated_before AS (SELECT * FROM dated WHERE date < DATE '1999-01-01')",
    gold("stored", "dated_before"),
    gold("batch", "dated"),
)
DIMENSIONS = ["year", "month", "day_of_week", "airline", "origin_airport"]


def matched(columns: list[str], left: str, right: str, operator: str = "IS NOT DISTINCT FROM") -> str:
    return " AND ".join(f"{left}.{c} {operator} {right}.{c}" for c in columns)


NULL_SAFE_KEY = [*DIMENSIONS, "time_agg_level", "agg_level"]
INSERTED = "SELECT * FROM batch s WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE {condition})"
STATEMENTS |= {
    "merge_insert_only": over_flights(
        "SELECT * FROM stored UNION ALL " + INSERTED.format(condition=matched(NULL_SAFE_KEY, "s", "t")), *TWO_GOLDS
    ),
    "merge_plain_keys": over_flights(
        "SELECT * FROM stored UNION ALL " + INSERTED.format(condition=matched(DIMENSIONS, "s", "t", "=")), *TWO_GOLDS
    ),
    "merge_replace": over_flights(
        "SELECT * FROM batch UNION ALL SELECT * FROM stored t WHERE NOT EXISTS"
        f" (SELECT 1 FROM batch s WHERE {matched(NULL_SAFE_KEY, 's', 't')})",
        *TWO_GOLDS,
    ),
    # Keys that both have, whose rows are not the same: window counts over both relations together.
    "changed_existing": over_flights(
        f"SELECT {', '.join(GOLD_COLUMNS)} FROM (SELECT *,"
        f" count(*) FILTER (NOT is_batch) OVER (PARTITION BY {', '.join(NULL_SAFE_KEY)}) AS known,"
        f" count(*) OVER (PARTITION BY {', '.join(GOLD_COLUMNS)}) AS same"
        " FROM (SELECT *, true AS is_batch FROM batch UNION ALL SELECT *, false FROM stored))"
        " WHERE is_batch AND known > 0 AND same = 1",
        *TWO_GOLDS,
    ),
}

# Quality metrics: one SELECT per constraint.
CHECK_FLIGHTS = "Data quality of fact_flights"
CHECK_GOLD = "Data quality of agg_fact_flights"
CHECK_DATES = "Data quality of dim_dates"


def metric(check: str, level: str, rule: str, columns: str, expression: str, source: str, least: float = 1.0) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{level}' AS check_level, '{rule}' AS rule, '{columns}' AS \"columns\","
        f" round(m, 9) AS metric, coalesce(m >= {least}, false) AS passed FROM (SELECT {expression} AS m FROM {source})"
    )


def share(predicate: str) -> str:
    return f"count(*) FILTER ({predicate}) / count(*)"


def rows(check, rule, columns, predicate, source, least=1.0, level="Error"):
    return metric(check, level, rule, columns, share(predicate), source, least)


def unique(check, columns, source, least=1.0, level="Error"):
    counted = f"(SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    return metric(check, level, "uniqueness", columns, "coalesce(sum(n) FILTER (n = 1), 0) / sum(n)", counted, least)


def listed(texts) -> str:
    return "(" + ", ".join(f"'{t}'" for t in texts) + ")"


CARRIERS = ["WN", "DL", "AA", "OO", "EV", "UA", "MQ", "B6", "US", "AS", "NK", "F9", "HA", "VX"]
FLIGHT_METRICS = (
    [unique(CHECK_FLIGHTS, KEY, "flights")]
    + [
        rows(CHECK_FLIGHTS, "completeness", c, f"{c} IS NOT NULL", "flights")
        for c in ("date", "airline", "flight_number", "origin_airport", "destination_airport", "scheduled_departure",
                  "cancelled", "is_delayed")
    ]
    + [
        rows(CHECK_FLIGHTS, "non_negative", c, f"{c} >= 0", "flights") for c in ("flight_number", "scheduled_departure")
    ]
    + [
        rows(CHECK_FLIGHTS, "containment", "airline", f"airline IN {listed(c for c, _ in CARRIER_NAMES)}", "flights"),
        rows(CHECK_FLIGHTS, "containment", "cancelled", "cancelled IN (0, 1)", "flights"),
        rows(
            CHECK_FLIGHTS, "containment", "cancellation_reason",
            "cancellation_reason IS NULL OR cancellation_reason IN ('A', 'B', 'C', 'D', '')", "flights",
        ),
        rows(CHECK_FLIGHTS, "containment", "is_delayed", "is_delayed IN (0, 1)", "flights"),
    ]
    + [
        rows("probes", rule, columns, predicate, "flights", least, "Warning")
        for rule, columns, predicate, least in (
            ("completeness", "departure_delay", "departure_delay IS NOT NULL", 0.9),
            ("completeness", "cancellation_reason", "cancellation_reason IS NOT NULL", 1.0),
            ("non_negative", "departure_delay", "coalesce(departure_delay, 0) >= 0", 1.0),
            (
                "containment", "cancellation_reason",
                "cancellation_reason IS NULL OR cancellation_reason IN ('A', 'B')", 0.98,
            ),
            ("containment", "airline", f"airline IN {listed(CARRIERS)}", 1.0),
            ("range", "departure_delay", "departure_delay IS NULL OR departure_delay BETWEEN -20 AND 20", 1.0),
            ("pattern", "airline", "regexp_full_match(airline, '[0-9]-[A-Z]+')", 1.0),
            (
                "predicate", "departure_delay, is_delayed",
                "departure_delay IS NULL OR (departure_delay > 0) = (is_delayed = 1)", 1.0,
            ),
        )
    ]
    + [unique("probes", "date, airline, flight_number", "flights", 0.5, "Warning")]
)
BY_REASON = [f"cancellations_{r}" for r in "ABCD"]
BY_SHARE = [f"percent_cancellations_{r}" for r in "ABCD"]
GOLD_METRICS = (
    [
        rows(CHECK_GOLD, "completeness", c, f"{c} IS NOT NULL", "gold")
        for c in ["total_flights", "delayed_flights", "cancelled_flights", *BY_REASON, "time_agg_level", "agg_level"]
    ]
    + [
        rows(CHECK_GOLD, "non_negative", c, f"coalesce({c}, 0) >= 0", "gold")
        for c in ["total_flights", "delayed_flights", "delayed_rate", "cancelled_flights", "cancelled_rate",
                  *BY_REASON, *BY_SHARE]
    ]
    + [
        rows(CHECK_GOLD, "containment", "time_agg_level",
             "time_agg_level IN ('all', 'year', 'year_month', 'day_of_week')", "gold"),
        rows(CHECK_GOLD, "containment", "agg_level", "agg_level IN ('all', 'airline', 'origin_airport')", "gold"),
    ]
)
BOUNDS = {"month": (1, 12), "day_of_week": (1, 7), "delayed_rate": (0, 1), "cancelled_rate": (0, 1)}
BOUNDS |= {c: (0, 1) for c in BY_SHARE}
SPEC_METRICS = (
    [
        metric(
            CHECK_FLIGHTS, "Error", "aggregate", "cancelled, cancellation_reason",
            "CAST(count(*) = count(*) FILTER (cancelled = 1) + count(*) FILTER (cancellation_reason IS NULL)"
            " AS DOUBLE)",
            "flights",
        ),
        unique(CHECK_GOLD, ", ".join(NULL_SAFE_KEY), "gold"),
    ]
    + [
        rows(CHECK_GOLD, "range", c, f"{c} IS NULL OR {c} BETWEEN {low} AND {high}", "gold")
        for c, (low, high) in BOUNDS.items()
    ]
    + [
        rows(CHECK_GOLD, "predicate", columns, predicate, "gold")
        for columns, predicate in (
            (", ".join(["cancelled_flights", *BY_REASON]), f"cancelled_flights = {' + '.join(BY_REASON)}"),
            (", ".join(BY_SHARE), f"coalesce(abs({' + '.join(BY_SHARE)} - 1) < 1e-9, true)"),
            ("delayed_flights, total_flights", "delayed_flights <= total_flights"),
            ("cancelled_flights, total_flights", "cancelled_flights <= total_flights"),
        )
    ]
    + [unique(CHECK_DATES, "date", "calendar")]
    + [
        rows(CHECK_DATES, "completeness", c, f"{c} IS NOT NULL", "calendar")
        for c in ("date", "year", "month", "day", "day_of_week", "quarter", "is_holiday")
    ]
    + [
        rows(CHECK_DATES, "range", c, f"{c} BETWEEN {low} AND {high}", "calendar")
        for c, (low, high) in {"month": (1, 12), "day": (1, 31), "day_of_week": (1, 7), "quarter": (1, 4)}.items()
    ]
)
STATEMENTS |= {
    "dq_results": over_flights(" UNION ALL ".join(FLIGHT_METRICS)),
    "dq_gold_results": over_gold(" UNION ALL ".join(GOLD_METRICS)),
}


# Profiles and histograms.
def column_profile(column: str, kind: str, inferred: bool, numeric: bool) -> str:
    stats = (
        f"CAST(min({column}) AS DOUBLE), CAST(max({column}) AS DOUBLE), round(avg({column}), 9),"
        f" round(stddev_pop({column}), 9), CAST(sum({column}) AS DOUBLE)"
        if numeric
        else ", ".join(["CAST(NULL AS DOUBLE)"] * 5)
    )
    return (
        f"SELECT '{column}', '{kind}', {str(inferred).lower()}, count(*), round(count({column}) / count(*), 9), {stats}"
        " FROM flights"
    )


PROFILED = {
    "date": ("Unknown", False, False),
    "airline": ("String", True, False),
    "flight_number": ("Integral", False, True),
    "origin_airport": ("String", True, False),
    "destination_airport": ("String", True, False),
    "scheduled_departure": ("Integral", False, True),
    "departure_delay": ("Integral", False, True),
    "cancelled": ("Integral", False, True),
    "cancellation_reason": ("String", True, False),
    "is_delayed": ("Integral", False, True),
}
STATEMENTS["profile_exact"] = over_flights(
    "SELECT * FROM ("
    + " UNION ALL ".join(column_profile(c, *traits) for c, traits in PROFILED.items())
    + ") p(column_name, data_type, type_inferred, row_count, completeness, minimum, maximum, mean, std_dev, total)"
)
STATEMENTS["profile_histograms"] = over_flights(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'NullValue') AS value, count(*) AS absolute,"
        f" count(*) / (SELECT count(*) FROM flights) AS fraction FROM flights GROUP BY {c}"
        for c in ("airline", "origin_airport", "cancellation_reason", "cancelled")
    )
)

KEY_TEXT = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in KEY.split(", ")) + ")"
STATEMENTS["sample_per_airline"] = over_flights(
    f"SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY airline ORDER BY md5('7|' || {KEY_TEXT}), "
    + ", ".join(f"{c} NULLS FIRST" for c in COLUMNS.split(", ") if c not in KEY.split(", "))
    + ") AS place FROM flights) WHERE place <= 100"
)
STATEMENTS["profile_sketched"] = over_flights(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, {low} AS minimum, {high} AS maximum,"
        f" round(count({c}) / count(*), 9) AS completeness, true AS percentiles_close, true AS distinct_close FROM flights"
        for c, numeric in (
            ("flight_number", True), ("departure_delay", True), ("scheduled_departure", True), ("airline", False), ("cancellation_reason", False)
        )
        for low, high in [
            (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if numeric else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        ]
    )
)
STATEMENTS["profile_full"] = over_flights(
    "SELECT column_name, data_type, 2 AS n_percentiles, coalesce(value, 'NullValue') AS value, value IS NULL AS is_null, absolute,"
    " round(absolute / sum(absolute) OVER (PARTITION BY column_name), 9) AS fraction FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, CAST({c} AS VARCHAR) AS value, count(*) AS absolute FROM renamed GROUP BY {c}"
        for c, kind in (("airline", "String"), ("cancellation_reason", "String"), ("cancelled", "Integral"))
    )
    + ") UNION ALL SELECT 'flight_number', 'Integral', 2, NULL, NULL, NULL, NULL",
    "renamed AS (SELECT * REPLACE (CASE WHEN cancellation_reason = 'D' THEN 'NullValue' ELSE cancellation_reason END"
    " AS cancellation_reason) FROM flights)",
).replace("2 AS n_percentiles, coalesce", "CASE column_name WHEN 'cancelled' THEN 2 END AS n_percentiles, coalesce")


def suggested(column: str, is_text: bool) -> list[str]:
    """What the suggestion rules give for a column of the rows that are not held out, and its share of those that are."""
    inside = lambda condition: f"(SELECT round(count(*) FILTER ({condition}) / count(*), 9) FROM held_out)"
    row = lambda rule, condition, holds: (
        f"SELECT '{column}' AS column_name, '{rule}' AS rule, {inside(holds)} AS share FROM known HAVING {condition}"
    )
    whole = f"count({column}) = count(*)"
    found = [
        row("complete_if_complete", whole, f"{column} IS NOT NULL"),
        row("retain_completeness", f"count({column}) < count(*) AND count({column}) > 0.2 * count(*)", f"{column} IS NOT NULL"),
    ]
    if not is_text:
        return found + [row("non_negative_numbers", f"min({column}) >= 0", f"coalesce({column}, 0) >= 0")]
    counts = (
        f"(SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
        f" - sum(n) OVER (PARTITION BY n) AS ahead, sum(n) OVER () AS all_rows"
        f" FROM (SELECT {column} AS value, count(*) AS n FROM known GROUP BY {column}))"
    )
    top = f"(SELECT value FROM {counts} WHERE ahead < 0.9 * all_rows)"
    facts = f"{counts} HAVING count(*) FILTER (n = 1) / count(*)"
    every = f"(SELECT DISTINCT {column} FROM known WHERE {column} IS NOT NULL)"
    some = f"(SELECT value FROM {top} WHERE value IS NOT NULL)"
    name = f"SELECT '{column}' AS column_name, "
    return found + [
        name + f"'categorical_range' AS rule, {inside(f'{column} IS NULL OR {column} IN {every}')} AS share FROM {facts} <= 0.1",
        name + f"'fractional_categorical_range' AS rule, {inside(f'{column} IS NULL OR {column} IN {some}')} AS share FROM {facts} <= 0.4"
        " AND count(*) FILTER (ahead < 0.9 * all_rows) <> count(*)",
    ]


STATEMENTS["suggestions_evaluated"] = over_flights(
    " UNION ALL ".join(x for c, (_, is_text, _) in PROFILED.items() if c != "date" for x in suggested(c, is_text))
    + " UNION ALL SELECT 'date', 'complete_if_complete', 1.0::DOUBLE",
    f"marked AS (SELECT *, md5({KEY_TEXT}) < '5' AS is_held FROM flights)",
    "known AS (SELECT * FROM marked WHERE NOT is_held)",
    "held_out AS (SELECT * FROM marked WHERE is_held)",
)

# Table operations: what is stored in the end.
REJECTED_KEY = "airline, origin_airport, scheduled_departure"
REST = "date, flight_number, destination_airport, departure_delay, cancelled, cancellation_reason, is_delayed"
STATEMENTS["wap_rejects_cross_month_duplicate"] = over_flights(
    f"SELECT {KEY}, origin_airport FROM (SELECT *, row_number() OVER (PARTITION BY {REJECTED_KEY} ORDER BY "
    + ", ".join(f"{c} NULLS FIRST" for c in REST.split(", "))
    + ") AS place FROM flights) WHERE place = 1"
)
STATEMENTS["gold_after_delete"] = over_flights(
    "SELECT * FROM gold",
    SURVIVORS,
    "left_over AS (SELECT * FROM survivors WHERE airline <> '5-LOW' AND year(date) <> 1997)",
    DATED.replace("FROM flights", "FROM left_over"),
    gold(),
)
STATEMENTS["gold_from_cells"] = over_flights(
    "SELECT * FROM gold",
    SURVIVORS,
    "late AS (SELECT *, airline = '2-HIGH' AND year(date) = 1996 AND cancelled = 0 AS changed FROM survivors"
    " WHERE airline <> '5-LOW' AND year(date) <> 1997)",
    "changed AS (SELECT * REPLACE (CASE WHEN changed THEN departure_delay + 30 ELSE departure_delay END AS departure_delay,"
    " CASE WHEN changed THEN CAST(departure_delay + 30 > 0 AS INTEGER) ELSE is_delayed END AS is_delayed) FROM late)",
    DATED.replace("FROM flights", "FROM changed"),
    gold(),
)
STATEMENTS["delete_from_table"] = over_flights(
    f"SELECT {COLUMNS} FROM survivors WHERE departure_delay IS NULL OR departure_delay <= 20", SURVIVORS
)
STATEMENTS["append_twice"] = (
    "SELECT c_custkey, c_name, c_mktsegment, true AS first, true AS second, false AS third FROM customer"
)
STATEMENTS["new_rows_flag"] = (
    "SELECT p_partkey, p_size, true AS has_new, false AS again_has_new FROM part WHERE p_size > 40"
)
STATEMENTS["wap_switch"] = over_flights(
    f"SELECT {COLUMNS} FROM (SELECT * REPLACE (CASE WHEN late THEN departure_delay + 30 ELSE departure_delay END AS departure_delay,"
    " CASE WHEN late THEN CAST(departure_delay + 30 > 0 AS INTEGER) ELSE is_delayed END AS is_delayed)"
    " FROM (SELECT *, year(date) = 1996 AND cancelled = 0 AS late FROM survivors))",
    SURVIVORS,
)
STATEMENTS["merge_bucketed"] = over_flights(
    f"SELECT {COLUMNS} FROM (SELECT * REPLACE (CASE WHEN date < DATE '1999-01-01' THEN departure_delay ELSE departure_delay + 1 END AS departure_delay)"
    " FROM survivors)",
    SURVIVORS,
)
STATEMENTS["replace_bucketed"] = over_flights(
    f"SELECT {COLUMNS} FROM (SELECT * REPLACE (CASE WHEN later THEN departure_delay + 30 ELSE departure_delay END AS departure_delay) FROM ("
    "SELECT *, coalesce(year(date) = 1998 AND month(date) > 6 OR year(date) = 1996 AND cancelled = 0, false) AS later FROM survivors)"
    " WHERE later OR date < DATE '1999-01-01')",
    SURVIVORS,
)
STATEMENTS["csv_rejects"] = """
WITH faults AS (
  SELECT l_orderkey AS order_key, l_linenumber = 7 AS short, l_partkey % 11 = 0 AS bad_number, l_suppkey % 7 = 0 AS bad_date FROM lineitem
)
SELECT order_key, CASE WHEN short THEN 'wrong number of cells' ELSE concat_ws('; ', CASE WHEN bad_number THEN 'quantity: no int' END,
       CASE WHEN bad_date THEN 'ship_date: no date' END) END AS reasons FROM faults WHERE short OR bad_number OR bad_date
UNION ALL
SELECT order_key, count(*) || ' read' FROM faults WHERE NOT (short OR bad_number OR bad_date) GROUP BY order_key
"""
STATEMENTS["file_stats"] = "SELECT CAST(1 AS BIGINT) AS files, count(*) AS row_count FROM lineitem"

# The fact table's rules on all its columns.
WIDE = f"""
base AS (
  SELECT *, {CANCELLED} AS is_cancelled, CAST(l_quantity AS INTEGER) - 25 AS delay FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
flagged AS (SELECT *, NOT is_cancelled AND l_linestatus = 'O' AND l_tax >= 0.08 AS is_diverted FROM base),
wide AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS airline, CAST(l_partkey AS INTEGER) AS flight_number,
    'N' || CAST(l_suppkey AS VARCHAR) AS tail_number, n_name AS origin_airport, CASE WHEN l_linenumber < 7 THEN o_orderstatus END AS destination_airport,
    l_linenumber AS scheduled_departure, CASE WHEN NOT is_cancelled THEN l_linenumber + 1 END AS departure_time,
    CASE WHEN NOT is_cancelled OR l_linenumber = 1 THEN delay END AS departure_delay,
    CAST(round(l_tax * 100) AS INTEGER) AS taxi_out, CASE WHEN NOT is_cancelled THEN l_linenumber + 2 END AS wheels_off,
    CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) * 7 END AS scheduled_time,
    CASE WHEN NOT is_cancelled AND NOT is_diverted THEN l_quantity * 7 + 3 END AS elapsed_time,
    CASE WHEN NOT is_cancelled AND NOT is_diverted THEN l_quantity * 6 END AS air_time,
    CAST(trunc(l_extendedprice) AS INTEGER) - 1000 AS distance,
    CASE WHEN NOT is_cancelled AND NOT is_diverted THEN l_linenumber + 3 END AS wheels_on,
    CAST(round(l_discount * 100) AS INTEGER) AS taxi_in, l_linenumber + 4 AS scheduled_arrival,
    CASE WHEN NOT is_cancelled AND NOT is_diverted THEN l_linenumber + 5 END AS arrival_time,
    CASE WHEN (NOT is_cancelled AND NOT is_diverted) OR l_linenumber = 2 THEN delay + 1 END AS arrival_delay,
    CAST(is_diverted AS INTEGER) AS diverted, CAST(is_cancelled AS INTEGER) AS cancelled,
    CASE WHEN is_cancelled OR l_linenumber = 7 THEN substr('ABCD', l_linenumber % 4 + 1, 1) END AS cancellation_reason,
    CASE WHEN NOT is_cancelled AND delay > 0 THEN delay // 5 END AS air_system_delay,
    CASE WHEN NOT is_cancelled AND delay > 0 THEN 0 END AS security_delay,
    CASE WHEN NOT is_cancelled AND delay > 0 THEN delay // 3 END AS airline_delay,
    CASE WHEN NOT is_cancelled AND delay > 0 THEN delay - delay // 5 - delay // 3 END AS late_aircraft_delay,
    CASE WHEN NOT is_cancelled AND delay > 0 THEN CAST(l_tax = 0.02 AS INTEGER) END AS weather_delay,
    CASE WHEN (NOT is_cancelled OR l_linenumber = 1) AND delay > 0 THEN 1 ELSE 0 END AS is_delayed
  FROM flagged
)"""
COMPLETE = ("date", "airline", "flight_number", "origin_airport", "destination_airport", "scheduled_departure",
            "scheduled_arrival", "distance", "diverted", "cancelled", "is_delayed")
NON_NEGATIVE = ("flight_number", "scheduled_departure", "departure_time", "taxi_out", "wheels_off", "scheduled_time",
                "elapsed_time", "air_time", "distance", "wheels_on", "taxi_in", "scheduled_arrival", "arrival_time",
                "air_system_delay", "security_delay", "airline_delay", "late_aircraft_delay", "weather_delay")
REASON_PARTS = ("air_system_delay", "security_delay", "airline_delay", "late_aircraft_delay", "weather_delay")
FACT_METRICS = (
    [unique(CHECK_FLIGHTS, KEY, "wide")]
    + [rows(CHECK_FLIGHTS, "completeness", c, f"{c} IS NOT NULL", "wide") for c in COMPLETE]
    + [rows(CHECK_FLIGHTS, "non_negative", c, f"coalesce({c}, 0) >= 0", "wide") for c in NON_NEGATIVE]
    + [
        rows(CHECK_FLIGHTS, "containment", "airline", f"airline IN {listed(CARRIERS)}", "wide"),
        rows(CHECK_FLIGHTS, "containment", "diverted", "diverted IN (0, 1)", "wide"),
        rows(CHECK_FLIGHTS, "containment", "cancelled", "cancelled IN (0, 1)", "wide"),
        rows(CHECK_FLIGHTS, "containment", "cancellation_reason",
             "cancellation_reason IS NULL OR cancellation_reason IN ('A', 'B', 'C', 'D', '')", "wide"),
        rows(CHECK_FLIGHTS, "containment", "is_delayed", "is_delayed IN (0, 1)", "wide"),
        rows(CHECK_FLIGHTS, "predicate", ", ".join(["departure_delay", *REASON_PARTS]),
             f"coalesce(departure_delay = {' + '.join(REASON_PARTS)}, true)", "wide"),
        metric(CHECK_FLIGHTS, "Error", "aggregate", "cancelled, cancellation_reason",
               "CAST(count(*) = count(*) FILTER (cancelled = 1) + count(*) FILTER (cancellation_reason IS NULL)"
               " AS DOUBLE)", "wide"),
    ]
)
LEFT_METRICS = [x.replace("FROM flights", "FROM left_over") for x in FLIGHT_METRICS] + [
    metric("whole table", "Error", "aggregate", "cancelled, cancellation_reason",
           "CAST(count(*) = count(*) FILTER (cancelled = 1) + count(*) FILTER (cancellation_reason IS NULL) AS DOUBLE)", "left_over"),
    metric("whole table", "Error", "aggregate", "departure_delay",
           "CAST(sum(departure_delay) < 2 * count(departure_delay) AS DOUBLE)", "left_over"),
    unique("whole table", "airline, flight_number, origin_airport", "left_over", 0.4),
    unique("whole table", "airline, flight_number", "left_over", 0.4),
]
STATEMENTS["dq_incremental"] = over_flights(
    " UNION ALL ".join(LEFT_METRICS), "left_over AS (SELECT * FROM flights WHERE airline <> '5-LOW' AND year(date) <> 1997)"
)
SIX = "year, airline, origin_airport, tail_number, cancelled, cancellation_reason"
WIDE_DATED = """
dated AS (SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month FROM wide WHERE date IS NOT NULL)"""


def wide_levels(columns: str, grouping: str, time: str, other: str) -> str:
    inner = f"SELECT {columns}, {DELAYS}, {label(time)} AS time_agg_level, {label(other)} AS agg_level FROM dated GROUP BY {grouping}"
    return f"WITH {WIDE}, {WIDE_DATED} SELECT * FROM ({inner})"


STATEMENTS["powerset_63"] = (
    wide_levels(SIX, f"CUBE ({SIX})", "year", SIX.removeprefix("year, ")) + " WHERE NOT (time_agg_level = 'all' AND agg_level = 'all')"
)
STATEMENTS["rollup_tail_number"] = wide_levels(
    "year, month, airline, tail_number",
    "GROUPING SETS ((airline, tail_number, year, month), (airline, tail_number), (airline), ())",
    "year, month",
    "airline, tail_number",
)
STATEMENTS["dq_fact_rules"] = f"WITH {WIDE} " + " UNION ALL ".join(FACT_METRICS)
FACT_DESIGN = [x for x in FACT_METRICS if "'predicate'" in x or "'aggregate'" in x]
STATEMENTS["dq_spec_results"] = (
    f"WITH {CALENDAR}, {WIDE}, {DATED.replace('FROM flights', 'FROM wide')}, {gold()} "
    + " UNION ALL ".join([*FACT_DESIGN, *[x for x in SPEC_METRICS if "FROM flights" not in x]])
)
STATEMENTS["anomalies"] = f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT '{name}' AS probe, count(*) FILTER ({condition}) AS row_count FROM wide"
    for name, condition in (
        ("reason_without_cancellation", "cancelled = 0 AND cancellation_reason IS NOT NULL"),
        ("cancelled_after_pushback", "cancelled = 1 AND departure_delay IS NOT NULL"),
        ("diverted_with_arrival_delay", "diverted = 1 AND arrival_delay IS NOT NULL"),
        ("scheduled_time_missing", "scheduled_time IS NULL"),
    )
)
STATEMENTS["diverted_counts"] = (
    f"WITH {WIDE} SELECT count(*) AS flights, count(*) FILTER (cancelled = 1) AS cancelled_flights,"
    " count(*) FILTER (diverted = 1) AS diverted_flights FROM wide"
)

# Rules at the edges of types, and the dimensions' design rules.
EDGES = """
edges AS (
  SELECT (l_quantity - 25) * 1e30 AS overflow,
         CASE WHEN l_quantity < 5 THEN CAST('-Infinity' AS DOUBLE) ELSE l_quantity END AS infinite,
         CAST(l_quantity AS INTEGER) - 25 AS number, l_linenumber % 3 AS flag, l_linenumber = 1 AS broken
  FROM lineitem
)"""
STATEMENTS["dq_edge_values"] = f"WITH {EDGES} " + " UNION ALL ".join(
    rows("edges", rule, column, predicate, "edges")
    for rule, column, predicate in (
        ("non_negative", "overflow", "overflow >= 0"),
        ("non_negative", "infinite", "infinite >= 0"),
        ("non_negative", "number_text", "number >= 0"),
        ("non_negative", "word", "false"),
        ("containment", "fractional_flag", "flag IN (0, 1)"),
        ("pattern", "code", "NOT broken"),
    )
)
CHECK_AIRPORTS, CHECK_AIRLINES = "Data quality of dim_airports", "Data quality of dim_airlines"
CHECK_CODES = "Data quality of dim_cancellation_codes"
DIMENSION_TABLES = """
airports AS (
  SELECT upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 3)) AS iata_code,
         s_name AS airport, CASE WHEN s_nationkey > 2 THEN s_name END AS city, 'XX' AS state, 'US' AS country,
         s_nationkey * 8 - 100 AS latitude, s_nationkey * 15 - 100 AS longitude FROM supplier
),
airlines AS (SELECT substr(c_mktsegment, 1, 2) AS iata_code, CASE WHEN c_custkey % 10 > 0 THEN c_name END AS airline FROM customer),
codes AS (SELECT substr('ABCDE', p_size % 5 + 1, 1) AS cancellation_reason, p_name AS cancellation_description FROM part)"""
DIMENSION_METRICS = (
    [unique(CHECK_AIRPORTS, "iata_code", "airports")]
    + [rows(CHECK_AIRPORTS, "completeness", c, f"{c} IS NOT NULL", "airports")
       for c in ("iata_code", "airport", "city", "state", "country", "latitude", "longitude")]
    + [
        rows(CHECK_AIRPORTS, "pattern", "iata_code", "regexp_full_match(iata_code, '[A-Z]{3}')", "airports"),
        rows(CHECK_AIRPORTS, "range", "latitude", "latitude BETWEEN -90 AND 90", "airports"),
        rows(CHECK_AIRPORTS, "range", "longitude", "longitude BETWEEN -180 AND 180", "airports"),
        unique(CHECK_AIRLINES, "iata_code", "airlines"),
        rows(CHECK_AIRLINES, "completeness", "iata_code", "iata_code IS NOT NULL", "airlines"),
        rows(CHECK_AIRLINES, "completeness", "airline", "airline IS NOT NULL", "airlines"),
        rows(CHECK_AIRLINES, "pattern", "iata_code", "regexp_full_match(iata_code, '[A-Z]{2}')", "airlines"),
        unique(CHECK_CODES, "cancellation_reason", "codes"),
        rows(CHECK_CODES, "completeness", "cancellation_reason", "cancellation_reason IS NOT NULL", "codes"),
        rows(CHECK_CODES, "completeness", "cancellation_description", "cancellation_description IS NOT NULL", "codes"),
        rows(CHECK_CODES, "containment", "cancellation_reason", "cancellation_reason IN ('A', 'B', 'C', 'D')", "codes"),
    ]
)
STATEMENTS["dq_dim_results"] = f"WITH {DIMENSION_TABLES} " + " UNION ALL ".join(DIMENSION_METRICS)

# Reports over the whole aggregate.
for name, report in (
    ("headline", "q02_headline"),
    ("monthly_volume_long", "q03_monthly_volume_long"),
    ("weekday_volume", "q06_weekday_volume"),
    ("delay_by_origin", "q08_delay_by_origin"),
    ("yearly_cancellations", "q12_yearly_cancellations"),
    ("totals", "q15_totals"),
):
    STATEMENTS[f"all_levels_{name}"] = STATEMENTS[report]
