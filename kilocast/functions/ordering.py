"""Orderings that need more than a column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: rank of scenarios that the configuration does not list.
UNLISTED_RANK = 999


def config_rank(column: Column, names: Sequence[str]) -> Column:
    """Position of the value in ``names``, for sorting scenarios in configuration order."""
    if not names:
        return column
    ranked = reduce(
        lambda chain, item: chain.when(column == item[1], item[0]),
        enumerate(names[1:], start=1),
        F.when(column == names[0], 0),
    )
    return ranked.otherwise(UNLISTED_RANK).cast("long")
