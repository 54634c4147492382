"""Long to wide."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    columns: Mapping[str | int, str],
    agg: Callable[[Column], Column],
    value: str = "value",
) -> DataFrame:
    """Turn the values of ``label`` named by ``columns`` into columns.

    Conditional aggregates need one shuffle by ``keys``; ``pivot`` would
    aggregate by key and label first and shuffle twice.
    """
    picked = [
        agg(F.when(F.col(label) == item, F.col(value))).alias(name)
        for item, name in columns.items()
    ]
    return df.groupBy(*keys).agg(*picked)
