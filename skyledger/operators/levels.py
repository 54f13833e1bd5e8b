"""Flight metrics over many grouping levels at once: grouping sets, rollups and cubes.

All measures are sums and counts, so levels are not computed from the flights: those are
first reduced to cells, one per combination of the dimensions in use, and the levels
are summed up from the cells. The first step combines on the map side, so what crosses the
network is bounded by the number of cells and not by the number of flights, also when one
airline or airport has most of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import label_from_grouping, named, ratio
from skyledger.operators.enrich import with_calendar, with_date_parts
from skyledger.schemas import CANCELLATION_REASONS, GOLD, GOLD_DIMENSIONS, ddl_columns, ddl_fields

Level = tuple[str, ...]

TIME_DIMENSIONS = ("year", "month", "day_of_week")
OTHER_DIMENSIONS = ("airline", "origin_airport")

_TIME_LEVELS: tuple[Level, ...] = ((), ("year",), ("year", "month"), ("day_of_week",))
GOLD_LEVELS: tuple[Level, ...] = tuple(
    (*owner, *time) for owner in ((), ("airline",), ("origin_airport",)) for time in _TIME_LEVELS
)


def rollup_levels(elements: Sequence[str | Level]) -> list[Level]:
    """Prefixes of the elements, longest first, down to the grand total."""
    return [_flat(elements[:n]) for n in range(len(elements), -1, -1)]


def cube_levels(elements: Sequence[str | Level], grand_total: bool = True) -> list[Level]:
    """All combinations of the elements; a tuple is one element whose columns stay together."""
    smallest = 0 if grand_total else 1
    return [
        _flat(chosen) for n in range(len(elements), smallest - 1, -1) for chosen in combinations(elements, n)
    ]


def _flat(elements: Sequence[str | Level]) -> Level:
    return tuple(c for e in elements for c in ([e] if isinstance(e, str) else e))


def _additive(reasons: Sequence[str]) -> dict[str, Column]:
    """Measures of one flight row set that add up over any split of it."""
    delay = F.col("departure_delay")
    return {
        "total_flights": F.count(F.lit(1)),
        "delayed_flights": F.count_if(F.col("is_delayed") == 1),
        "on_time_flights": F.count_if(delay <= 0),
        "_delay_sum": F.sum(delay),
        "_delay_known": F.count(delay),
        "_late_sum": F.sum(F.when(F.col("is_delayed") == 1, delay)),
        "cancelled_flights": F.count_if(F.col("cancelled") == 1),
        **{f"cancellations_{r}": F.count_if(F.col("cancellation_reason") == r) for r in reasons},
    }


def _metrics(reasons: Sequence[str], extended: bool) -> list[Column]:
    """Published metrics from summed measures, in contract order; ``extended`` ones come last."""
    counts_by_reason = [f"cancellations_{r}" for r in reasons]
    published = [
        F.col("total_flights"),
        F.col("delayed_flights"),
        ratio("delayed_flights", "total_flights").alias("delayed_rate"),
        ratio("_delay_sum", "_delay_known").alias("avg_delay_time"),
        F.col("cancelled_flights"),
        ratio("cancelled_flights", "total_flights").alias("cancelled_rate"),
        *[F.col(c) for c in counts_by_reason],
        *[ratio(c, "cancelled_flights").alias(f"percent_{c}") for c in counts_by_reason],
    ]
    extra = [
        F.col("on_time_flights"),
        ratio("on_time_flights", "total_flights").alias("on_time_rate"),
        ratio("_late_sum", "delayed_flights").alias("avg_delay_time_delayed"),
    ]
    return published + extra if extended else published


def flight_cells(
    flights: DataFrame, dimensions: Sequence[str], reasons: Sequence[str] = CANCELLATION_REASONS
) -> DataFrame:
    """Additive measures per combination of the dimensions."""
    measures = _additive(reasons)
    return flights.groupBy(*[named(d) for d in dimensions]).agg(*[m.alias(n) for n, m in measures.items()])


def aggregate_levels(
    flights: DataFrame,
    levels: Sequence[Level],
    time_dimensions: Sequence[str] = TIME_DIMENSIONS,
    other_dimensions: Sequence[str] = OTHER_DIMENSIONS,
    reasons: Sequence[str] = CANCELLATION_REASONS,
    extended: bool = False,
) -> DataFrame:
    """One row per group of every level, NULL in the dimensions a level leaves out.

    ``time_agg_level`` and ``agg_level`` name the level. They come from ``grouping()``, so a
    dimension value that is itself NULL is not mistaken for a rolled-up one.
    """
    used = _used([*time_dimensions, *other_dimensions], levels)
    cells = flight_cells(flights, used, reasons)
    if len(levels) == 1:
        # The cells are the level: no second grouping, and its labels are constants.
        labels = _constant_labels(used, time_dimensions, other_dimensions)
        return _published(cells.withColumns(labels), flights, used, time_dimensions, other_dimensions, reasons, extended)
    return sum_cells(cells, levels, time_dimensions, other_dimensions, reasons, extended, flights)


def sum_cells(
    cells: DataFrame,
    levels: Sequence[Level],
    time_dimensions: Sequence[str] = TIME_DIMENSIONS,
    other_dimensions: Sequence[str] = OTHER_DIMENSIONS,
    reasons: Sequence[str] = CANCELLATION_REASONS,
    extended: bool = False,
    typed: DataFrame | None = None,
) -> DataFrame:
    """The same from cells, which may be finer than the levels, as stored ones are; ``typed`` has the dimensions' types."""
    used = _used([*time_dimensions, *other_dimensions], levels)
    grouped = cells.groupingSets([[named(c) for c in level] for level in levels], *[named(d) for d in used])
    summed = grouped.agg(
        *[F.sum(name).alias(name) for name in measure_names(reasons)],
        label_from_grouping(list(time_dimensions), used).alias("time_agg_level"),
        label_from_grouping(list(other_dimensions), used).alias("agg_level"),
    )
    return _published(summed, cells if typed is None else typed, used, time_dimensions, other_dimensions, reasons, extended)


def measure_names(reasons: Sequence[str] = CANCELLATION_REASONS) -> list[str]:
    return list(_additive(reasons))


def _used(dimensions: Sequence[str], levels: Sequence[Level]) -> list[str]:
    return [d for d in dimensions if any(d in level for level in levels)]


def _constant_labels(used: Sequence[str], time: Sequence[str], other: Sequence[str]) -> dict[str, Column]:
    names = {"time_agg_level": time, "agg_level": other}
    return {label: F.lit("_".join(d for d in dims if d in used) or "all") for label, dims in names.items()}


def _published(
    summed: DataFrame, typed: DataFrame, used: Sequence[str], time: Sequence[str], other: Sequence[str], reasons: Sequence[str], extended: bool
) -> DataFrame:
    """Dimensions, metrics and labels in contract order; a dimension that no level uses is NULL."""
    dimensions = [*time, *other]
    types = {d: typed.schema[d].dataType for d in dimensions if d not in used and d in typed.columns}
    columns = [named(d) if d in used else F.lit(None).cast(types.get(d, "string")).alias(d) for d in dimensions]
    return summed.select(*columns, *_metrics(reasons, extended), "time_agg_level", "agg_level")


def aggregate_lattice(
    flights: DataFrame,
    levels: Sequence[Level],
    write: Callable[[DataFrame], DataFrame],
    time_dimensions: Sequence[str] = TIME_DIMENSIONS,
    other_dimensions: Sequence[str] = OTHER_DIMENSIONS,
    reasons: Sequence[str] = CANCELLATION_REASONS,
    extended: bool = False,
) -> DataFrame:
    """The rows of `aggregate_levels`, for so many levels that expanding the cells for each would multiply them.

    The cells, and the levels with one dimension less, are stored by ``write``, which gives back what it stored. Every
    level is then summed from the smallest of these that has its dimensions, all levels of one parent in one expand. So what an
    expand multiplies is a table that has lost its widest dimension, where the level allows.
    """
    dimensions = [*time_dimensions, *other_dimensions]
    wanted = list(dict.fromkeys(tuple(d for d in dimensions if d in level) for level in levels))
    top = tuple(_used(dimensions, levels))
    measures = measure_names(reasons)
    stored = {top: write(flight_cells(flights, list(top), reasons))}
    for parent in combinations(top, len(top) - 1) if len(top) > 1 else ():
        cells = stored[top].groupBy(*[named(d) for d in parent]).agg(*[F.sum(m).alias(m) for m in measures])
        stored[parent] = write(cells)
    sizes = {parent: table.count() for parent, table in stored.items()}  # from the files' own counts
    children: dict[Level, list[Level]] = {}
    for level in wanted:
        parent = min((p for p in stored if set(level) <= set(p)), key=lambda p: (sizes[p], p))
        children.setdefault(parent, []).append(level)
    parts = [
        sum_cells(stored[parent], chosen, time_dimensions, other_dimensions, reasons, extended, flights)
        for parent, chosen in children.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def gold(
    flights: DataFrame,
    calendar: DataFrame | None = None,
    levels: Sequence[Level] = GOLD_LEVELS,
    extended: bool = False,
) -> DataFrame:
    """The aggregate table from silver flights: every level of ``levels`` in one result.

    Without a ``calendar`` the date attributes are computed from the date; with one, flights on other dates drop out: they
    are reduced to cells per date first, and the cells are joined to it. A report that reads one
    level only can ask for just that one.
    """
    if calendar is None:
        return _contract(aggregate_levels(with_date_parts(flights, *TIME_DIMENSIONS), levels, extended=extended))
    return gold_from_cells(daily_cells(flights), calendar, levels, extended)


def daily_cells(flights: DataFrame, reasons: Sequence[str] = CANCELLATION_REASONS) -> DataFrame:
    """Cells per date, airline and origin: all that the aggregate table is made of. Rows without a date are in no level."""
    return flight_cells(flights.where("date IS NOT NULL"), ("date", *OTHER_DIMENSIONS), reasons)


def gold_from_cells(
    cells: DataFrame, calendar: DataFrame | None = None, levels: Sequence[Level] = GOLD_LEVELS, extended: bool = False
) -> DataFrame:
    """The aggregate table from `daily_cells`, stored or not."""
    if calendar is None:
        dated = with_date_parts(cells, *TIME_DIMENSIONS)
    else:
        dated = with_calendar(cells, calendar.select("date", *TIME_DIMENSIONS))
    return _contract(sum_cells(dated, levels, extended=extended))


def _contract(result: DataFrame) -> DataFrame:
    kinds = dict(ddl_fields(GOLD))
    return result.select(*[named(c).cast(kinds[c]) if c in GOLD_DIMENSIONS else named(c) for c in result.columns])


def gold_columns(extended: bool = False) -> list[str]:
    base = ddl_columns(GOLD)
    extra = ["on_time_flights", "on_time_rate", "avg_delay_time_delayed"] if extended else []
    return base[:-2] + extra + base[-2:]
