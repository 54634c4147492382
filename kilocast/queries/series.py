"""Time series of one scenario: hourly, or means by day or week of the year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilocast.functions.calendar import day_of_year, week_index
from kilocast.queries.scope import Scope, breakdown_column

# Names of the resampling options.
HOURLY = "Hourly"
DAILY_MEAN = "Daily Mean"
WEEKLY_MEAN = "Weekly Mean"


def comparison(
    projection: DataFrame,
    scope: Scope,
    group_by: str | None = None,
    resample: str = DAILY_MEAN,
    hour_of_year: bool = False,
    totals_first: bool = False,
) -> DataFrame:
    """Series of each year with a common ``time_period``.

    Days are numbered from 2 and weeks from 1, and their means are over rows;
    ``totals_first`` takes means over hourly totals instead. Hourly rows with a
    breakdown are numbered one by one; ``hour_of_year`` numbers their hours
    instead.
    """
    extra = breakdown_column(group_by)
    if resample == HOURLY:
        if extra:
            return _numbered_rows(projection, scope, extra, hour_of_year)
        return _numbered_hours(projection, scope)
    ts = F.col("timestamp")
    if resample == DAILY_MEAN:
        period = day_of_year(ts) + 1
    elif resample == WEEKLY_MEAN:
        period = week_index(ts) + 1
    else:
        raise ValueError(f"{resample!r} names no way to resample a series")
    rows = scope.rows(projection)
    if totals_first:
        rows = rows.groupBy(*scope.keys, "timestamp", *extra).agg(F.sum("value").alias("value"))
    return (
        rows.groupBy(*scope.keys, period.alias("time_period"), *extra)
        .agg(F.avg("value").alias("value"))
        .orderBy(*scope.keys, "time_period", *extra)
    )


def _numbered_hours(projection: DataFrame, scope: Scope) -> DataFrame:
    by_time = Window.partitionBy(*scope.keys).orderBy("timestamp")
    numbered = scope.hourly_totals(projection, "value").select(
        *scope.keys, F.row_number().over(by_time).cast("long").alias("time_period"), "value"
    )
    return scope.sorted_rows(numbered, "time_period")


def _numbered_rows(
    projection: DataFrame, scope: Scope, extra: list[str], hour_of_year: bool
) -> DataFrame:
    """Row numbers over a whole series without sorting a series in one task.

    A running count over the hours (at most 8784 per series) gives each hour its
    first number; within the hour, rows are numbered by sector, end use and value.
    """
    rows = scope.rows(projection)
    hour_keys = [*scope.keys, "timestamp"]
    before = (
        Window.partitionBy(*scope.keys)
        .orderBy("timestamp")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    in_series = Window.partitionBy(*scope.keys).orderBy("timestamp")
    hours = rows.groupBy(*hour_keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = hours.select(
        *hour_keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.row_number().over(in_series).alias("_hour"),
    )
    in_hour = Window.partitionBy(*hour_keys).orderBy("sector", "metric", "value")
    # Rows without a timestamp are numbered, too.
    theirs = offsets.select(
        *[F.col(k).alias(f"_{k}") for k in hour_keys], "_before", "_hour"
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in hour_keys]
    placed = rows.join(theirs, reduce(Column.__and__, same))
    number: Column = (
        F.col("_hour") if hour_of_year else F.col("_before") + F.row_number().over(in_hour)
    )
    numbered = placed.select(
        *scope.keys, number.cast("long").alias("time_period"), *extra, "value"
    )
    return scope.sorted_rows(numbered, "time_period", *extra)
