"""The part of the projection a query looks at, and the columns it groups by.

With a geography the result is that of one country. Without, every query keeps
geography as a further key and answers for all countries in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilocast.functions.ordering import config_rank

# Names of breakdowns and the columns they stand for.
BREAKDOWNS = {"End Use": "metric", "Sector": "sector"}


def breakdown_column(breakdown: str | None) -> list[str]:
    if breakdown is None:
        return []
    if breakdown not in BREAKDOWNS:
        raise ValueError(f"unknown breakdown {breakdown!r}; use one of {list(BREAKDOWNS)}")
    return [BREAKDOWNS[breakdown]]


@dataclass(frozen=True)
class Scope:
    """Filters on raw columns, so scenario and model year prune partitions."""

    geography: str | None = None
    scenarios: Sequence[str] | None = None
    years: Sequence[int] | None = None
    scenario_order: Sequence[str] = ()

    def rows(self, projection: DataFrame) -> DataFrame:
        chosen = projection
        if self.geography is not None:
            chosen = chosen.filter(F.col("geography") == self.geography)
        if self.scenarios is not None:
            chosen = chosen.filter(F.col("scenario").isin(*self.scenarios))
        if self.years is not None:
            chosen = chosen.filter(F.col("model_year").isin(*self.years))
        return chosen.withColumnRenamed("model_year", "year")

    @property
    def places(self) -> list[str]:
        return [] if self.geography is not None else ["geography"]

    @property
    def keys(self) -> list[str]:
        return [*self.places, "scenario", "year"]

    def order(self, *more: str) -> list[Column]:
        """Places, scenarios in configuration order, years, then ``more``."""
        return [
            *[F.col(c) for c in self.places],
            config_rank(F.col("scenario"), self.scenario_order),
            F.col("year"),
            *[F.col(c) for c in more],
        ]

    def sorted_rows(self, df: DataFrame, *columns: str) -> DataFrame:
        """Sort row-level results of one country; those of all countries are left unsorted,
        which spares a global sort of a large part of the projection."""
        return df if self.places else df.orderBy(*self.order(*columns))

    def hourly_totals(self, projection: DataFrame, name: str = "total") -> DataFrame:
        """Load per hour: at most 8784 rows per place, scenario and year."""
        return (
            self.rows(projection).groupBy(*self.keys, "timestamp").agg(F.sum("value").alias(name))
        )
