"""Configured rules per published table, as plain data, and their translation into constraints."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from skyledger.operators.levels import GOLD_LEVELS, OTHER_DIMENSIONS, TIME_DIMENSIONS
from skyledger.quality import constraints as c
from skyledger.schemas import CANCELLATION_REASONS, FLIGHT_KEY, GOLD_KEY

# The carriers, flags and columns that loaded rows are held against.
CARRIERS = ["WN", "DL", "AA", "OO", "EV", "UA", "MQ", "B6", "US", "AS", "NK", "F9", "HA", "VX"]
FLAG = ["0", "1"]

_SHARES = [f"percent_cancellations_{r}" for r in CANCELLATION_REASONS]
_BY_REASON = [f"cancellations_{r}" for r in CANCELLATION_REASONS]


def _labels(dimensions: Sequence[str]) -> list[str]:
    """Labels that the gold levels can have over these dimensions."""
    found = ["_".join(d for d in dimensions if d in level) or "all" for level in GOLD_LEVELS]
    return list(dict.fromkeys(found))


TABLE_RULES: dict[str, dict] = {
    "fact_flights": {
        "uniqueness": list(FLIGHT_KEY),
        "completeness": [
            "date", "airline", "flight_number", "origin_airport", "destination_airport", "scheduled_departure",
            "scheduled_arrival", "distance", "diverted", "cancelled", "is_delayed",
        ],
        "non_negative": [
            "flight_number", "scheduled_departure", "departure_time", "taxi_out", "wheels_off", "scheduled_time",
            "elapsed_time", "air_time", "distance", "wheels_on", "taxi_in", "scheduled_arrival", "arrival_time",
            "air_system_delay", "security_delay", "airline_delay", "late_aircraft_delay", "weather_delay",
        ],
        "containment": {
            "airline": CARRIERS,
            "diverted": FLAG,
            "cancelled": FLAG,
            "cancellation_reason": [*CANCELLATION_REASONS, ""],
            "is_delayed": FLAG,
        },
    },
    "dim_airlines": {},
    "dim_airports": {},
    "dim_cancellation_codes": {},
    "dim_dates": {},
    "agg_fact_flights": {
        "completeness": ["total_flights", "delayed_flights", "cancelled_flights", *_BY_REASON,
                         "time_agg_level", "agg_level"],
        "non_negative": ["total_flights", "delayed_flights", "delayed_rate", "cancelled_flights", "cancelled_rate",
                         *_BY_REASON, *_SHARES],
        "containment": {"time_agg_level": _labels(TIME_DIMENSIONS), "agg_level": _labels(OTHER_DIMENSIONS)},
    },
}

# Further checks that the table design asks for, beyond those a load is held to.
DESIGN_RULES: dict[str, dict] = {
    "fact_flights": {
        "predicate": [
            (
                ["departure_delay", "air_system_delay", "security_delay", "airline_delay", "late_aircraft_delay",
                 "weather_delay"],
                "departure_delay = air_system_delay + security_delay + airline_delay + late_aircraft_delay"
                " + weather_delay",
            ),
        ],
        "aggregate": [
            (
                ["cancelled", "cancellation_reason"],
                "count(*) = count_if(cancelled = 1) + count_if(cancellation_reason IS NULL)",
            ),
        ],
    },
    "dim_airlines": {
        "uniqueness": ["iata_code"],
        "completeness": ["iata_code", "airline"],
        "pattern": {"iata_code": "[A-Z]{2}"},
    },
    "dim_airports": {
        "uniqueness": ["iata_code"],
        "completeness": ["iata_code", "airport", "city", "state", "country", "latitude", "longitude"],
        "pattern": {"iata_code": "[A-Z]{3}"},
        "range": {"latitude": (-90, 90), "longitude": (-180, 180)},
    },
    "dim_cancellation_codes": {
        "uniqueness": ["cancellation_reason"],
        "completeness": ["cancellation_reason", "cancellation_description"],
        "containment": {"cancellation_reason": list(CANCELLATION_REASONS)},
    },
    "dim_dates": {
        "uniqueness": ["date"],
        "completeness": ["date", "year", "month", "day", "day_of_week", "quarter", "is_holiday"],
        "range": {"month": (1, 12), "day": (1, 31), "day_of_week": (1, 7), "quarter": (1, 4)},
    },
    "agg_fact_flights": {
        "uniqueness": list(GOLD_KEY),
        "range": {
            "month": (1, 12), "day_of_week": (1, 7), "delayed_rate": (0, 1), "cancelled_rate": (0, 1),
            **{share: (0, 1) for share in _SHARES},
        },
        "predicate": [
            (["cancelled_flights", *_BY_REASON], f"cancelled_flights = {' + '.join(_BY_REASON)}"),
            (_SHARES, f"abs({' + '.join(_SHARES)} - 1) < 1e-9"),
            (["delayed_flights", "total_flights"], "delayed_flights <= total_flights"),
            (["cancelled_flights", "total_flights"], "cancelled_flights <= total_flights"),
        ],
    },
}

def _parts(tolerances: list[dict]) -> list[c.Constraint]:
    """Constraints that need not hold for all rows: each entry is a configuration with ``at_least``, a share."""
    found = []
    for entry in tolerances:
        share, config = entry["at_least"], {k: v for k, v in entry.items() if k != "at_least"}
        found += [replace(constraint, assertion=c.at_least(share)) for constraint in compile_rules(config)]
    return found


# Which constraints a rule of the configuration stands for; rules are applied in this order.
COMPILERS: dict[str, Callable] = {
    "uniqueness": lambda columns: [c.uniqueness(columns)],
    "completeness": lambda columns: [c.completeness(x) for x in columns],
    "non_negative": lambda columns: [c.non_negative(x) for x in columns],
    "containment": lambda lists: [c.contained_in(x, values) for x, values in lists.items()],
    "range": lambda ranges: [c.in_range(x, low, high) for x, (low, high) in ranges.items()],
    "pattern": lambda patterns: [c.matches(x, pattern) for x, pattern in patterns.items()],
    "predicate": lambda pairs: [c.satisfies(columns, condition) for columns, condition in pairs],
    "aggregate": lambda pairs: [c.holds_overall(columns, condition) for columns, condition in pairs],
    "mostly": _parts,
}


def compile_rules(config: dict) -> list[c.Constraint]:
    """Constraints of a table's configuration; an unknown rule name is an error."""
    unknown = set(config) - set(COMPILERS)
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    return [constraint for rule, build in COMPILERS.items() if rule in config for constraint in build(config[rule])]


def table_check(table: str, rules: dict[str, dict] | None = None) -> c.Check:
    """The configured check of a table, by its name without database."""
    config = TABLE_RULES if rules is None else rules
    if table not in config:
        raise ValueError(f"no rules configured for table {table}")
    return c.Check(f"Data quality of {table}", tuple(compile_rules(config[table])))


def only_columns(check: c.Check, columns: Sequence[str]) -> c.Check:
    """The check without the constraints on columns a relation does not have."""
    have = set(columns)
    return c.Check(check.name, tuple(k for k in check.constraints if have.issuperset(k.columns)), check.level)
