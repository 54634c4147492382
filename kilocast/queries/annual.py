"""Annual consumption (MWh), annual peak (MW), and what they tell together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilocast.functions.calendar import minute_number
from kilocast.queries.scope import Scope, breakdown_column


def consumption(projection: DataFrame, scope: Scope, group_by: str | None = None) -> DataFrame:
    extra = breakdown_column(group_by)
    return (
        scope.rows(projection)
        .groupBy(*scope.keys, *extra)
        .agg(F.sum("value").alias("value"))
        .orderBy(*scope.order(*extra))
    )


def peak(projection: DataFrame, scope: Scope) -> DataFrame:
    return (
        scope.hourly_totals(projection)
        .groupBy(*scope.keys)
        .agg(F.max("total").alias("value"))
        .orderBy(*scope.order())
    )


def peak_breakdown(
    projection: DataFrame,
    scope: Scope,
    group_by: str,
    totals: DataFrame | None = None,
    few_peaks: bool = False,
) -> DataFrame:
    """The rows of the peak hour, one per sector and end use, not summed.

    The peak hour is picked by aggregation with partial maxima rather than by
    ranking all hours; of equal peaks the earliest counts. They are one row for
    each scenario, year and country, so Spark measures them and broadcasts few.

    ``totals`` are stored sums by hour to find the peaks in, so that the rows
    are read once. With ``few_peaks`` the caller has counted the scenarios,
    years and countries, and the rows stay where they are.
    """
    extra = breakdown_column(group_by)
    earlier = -minute_number(F.col("timestamp"))
    hours = (
        scope.hourly_totals(projection if totals is None else totals)
        .groupBy(*scope.keys)
        .agg(F.max_by("timestamp", F.struct("total", earlier)).alias("timestamp"))
    )
    found = (
        scope.rows(projection)
        .join(F.broadcast(hours) if few_peaks else hours, [*scope.keys, "timestamp"])
        .select(*scope.keys, *extra, "value")
    )
    return scope.sorted_rows(found, *extra)


def _totals_and_peaks(projection: DataFrame, scope: Scope) -> DataFrame:
    return (
        scope.hourly_totals(projection)
        .groupBy(*scope.keys)
        .agg(F.sum("total").alias("consumption"), F.max("total").alias("peak"))
    )


def _start_values(df: DataFrame, scope: Scope, start_year: int | None, names: Sequence[str]):
    """Values of the start year (the first by default) beside those of every year."""
    line = Window.partitionBy(*[k for k in scope.keys if k != "year"])
    start = F.min("year").over(line) if start_year is None else F.lit(start_year).cast("long")
    marked = df.withColumn("start_year", start)
    at_start = F.col("year") == F.col("start_year")
    return marked.withColumns(
        {f"start_{n}": F.max(F.when(at_start, F.col(n))).over(line) for n in names}
    )


def summary(projection: DataFrame, scope: Scope) -> DataFrame:
    """Consumption, its growth in percent since the first year, and peak."""
    known = _start_values(_totals_and_peaks(projection, scope), scope, None, ["consumption"])
    growth = F.try_divide(
        (F.col("consumption") - F.col("start_consumption")) * 100.0, F.col("start_consumption")
    )
    return known.select(
        *scope.keys,
        F.col("consumption").alias("total_consumption"),
        growth.alias("percent_growth"),
        F.col("peak").alias("peak_demand"),
    ).orderBy(*scope.order())


def _growth_rate(value: str) -> Column:
    """Compound annual growth in percent; NULL for the start year or without positive values."""
    start, end = F.col(f"start_{value}"), F.col(value)
    years = F.col("year") - F.col("start_year")
    usable = (years != 0) & (start > 0) & (end > 0)
    return F.when(usable, (F.pow(end / start, F.lit(1.0) / years) - 1.0) * 100.0)


def growth_indicators(
    projection: DataFrame, scope: Scope, start_year: int | None = None
) -> DataFrame:
    """Consumption and peak of every year with compound annual growth since the start year."""
    known = _start_values(
        _totals_and_peaks(projection, scope), scope, start_year, ["consumption", "peak"]
    )
    return known.select(
        *scope.keys,
        "consumption",
        _growth_rate("consumption").alias("consumption_cagr"),
        "peak",
        _growth_rate("peak").alias("peak_cagr"),
    ).orderBy(*scope.order())


def stacked_maximum(projection: DataFrame, scope: Scope, group_by: str) -> DataFrame:
    """Height of the tallest bar: the largest yearly sum over a group, per place."""
    extra = breakdown_column(group_by)
    bars = scope.rows(projection).groupBy(*scope.places, "year", *extra).agg(
        F.sum("value").alias("value")
    )
    return bars.groupBy(*scope.places).agg(F.max("value").alias("max_value"))


def difference(projection: DataFrame, scope: Scope, base: str, other: str) -> DataFrame:
    """Annual consumption of two scenarios side by side, where both have data.

    One pass with conditional sums instead of joining two aggregates.
    """
    rows = scope.rows(projection).filter(F.col("scenario").isin(base, other))

    both = rows.groupBy(*scope.places, "year").agg(
        F.sum(F.when(F.col("scenario") == base, F.col("value"))).alias("value_base"),
        F.sum(F.when(F.col("scenario") == other, F.col("value"))).alias("value_other"),
        F.count_if(F.col("scenario") == base).alias("n_base"),
        F.count_if(F.col("scenario") == other).alias("n_other"),
    )
    change = F.col("value_other") - F.col("value_base")
    return (
        both.filter((F.col("n_base") > 0) & (F.col("n_other") > 0))
        .select(
            *scope.places,
            "year",
            "value_base",
            "value_other",
            change.alias("difference"),
            F.try_divide(change * 100.0, F.col("value_base")).alias("pct_difference"),
        )
        .orderBy(*scope.places, "year")
    )
