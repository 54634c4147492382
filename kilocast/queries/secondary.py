"""Economic drivers shown beside the load."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric names and the calculated tables they come from.
SECONDARY_TABLES = {
    "GDP": "gdp_country",
    "GDP Per Capita": "gdp_country",
    "Human Development Index": "hdi_country",
    "Population": "population_country",
}

# Fixed value: GDP is in billions.
USD_PER_GDP_UNIT = 1e9


def secondary_metric(
    table: Callable[[str], DataFrame],
    metric: str,
    years: Sequence[int] | None = None,
    geography: str | None = None,
) -> DataFrame:
    """Values by year; ``table`` gives a scenario's calculated table by name."""
    if metric not in SECONDARY_TABLES:
        raise NotImplementedError(f"no table holds the metric {metric!r}")
    places = [] if geography is not None else ["geography"]

    def values(name: str) -> DataFrame:
        rows = table(name)
        if geography is not None:
            rows = rows.filter(F.col("geography") == geography)
        if years is not None:
            rows = rows.filter(F.col("model_year").isin(*years))
        return rows.select(*places, F.col("model_year").alias("year"), "value")

    series = values(SECONDARY_TABLES[metric])
    if metric == "GDP Per Capita":
        people = values(SECONDARY_TABLES["Population"]).withColumnRenamed("value", "people")
        per_head = F.try_divide(F.col("value") * USD_PER_GDP_UNIT, F.col("people"))
        series = series.join(people, [*places, "year"]).select(
            *places, "year", per_head.alias("value")
        )
    return series.orderBy(*places, "year")


def secondary_of_scenarios(
    tables: dict[str, Callable[[str], DataFrame]],
    metric: str,
    years: Sequence[int] | None = None,
    geography: str | None = None,
) -> DataFrame:
    """The metric of several scenarios, tagged; scenarios without the table are left out."""
    parts = []
    for name, table in tables.items():
        try:
            part = secondary_metric(table, metric, years, geography)
        except ValueError:
            continue
        parts.append(part.withColumn("scenario", F.lit(name)))
    if not parts:
        raise ValueError(f"no scenario has data for {metric!r}")
    return reduce(DataFrame.unionByName, parts)
