"""Wide metrics to long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import named


def to_long(
    df: DataFrame, metrics: Sequence[str] | dict[str, str], name: str, value: str, keep_nulls: bool = False
) -> DataFrame:
    """One row per metric column: its label in ``name``, its number in ``value``.

    ``metrics`` may map columns to labels. NULL numbers are dropped as SQL's UNPIVOT does.
    All metrics come out of one pass over ``df``.
    """
    labels = metrics if isinstance(metrics, dict) else {m: m for m in metrics}
    ids = [c for c in df.columns if c not in labels]
    renamed = df.select(*[named(c) for c in ids], *[named(c).alias(label) for c, label in labels.items()])
    long = renamed.unpivot([named(c) for c in ids], [named(x) for x in labels.values()], name, value)
    return long if keep_nulls else long.where(F.col(value).isNotNull())
