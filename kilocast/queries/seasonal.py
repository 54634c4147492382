"""Typical days: load by hour of day, by season and kind of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.functions.calendar import QUERY_WEEKEND, day_kind, day_of_year, hour_of, season
from kilocast.queries.scope import Scope, breakdown_column

# Names of the groupings and aggregates.
TIME_GROUPS = {
    "Seasonal": ["season"],
    "Weekday/Weekend": ["day_type"],
    "Seasonal and Weekday/Weekend": ["season", "day_type"],
}
AGGREGATES = {
    "Average Day": F.avg,
    "Peak Day": F.max,
    "Minimum Day": F.min,
    "Median Day": F.median,
}


def profile(
    projection: DataFrame,
    scope: Scope,
    group_by: str = "Seasonal",
    agg: str = "Average Day",
    breakdown: str | None = None,
) -> DataFrame:
    """Aggregate over days of the hourly sums.

    The first step leaves one row per day and hour, so the second, the median
    included, sees at most 366 values per group.
    """
    if group_by not in TIME_GROUPS or agg not in AGGREGATES:
        raise ValueError(f"unknown grouping {group_by!r} or aggregate {agg!r}")
    groups, extra = TIME_GROUPS[group_by], breakdown_column(breakdown)
    ts = F.col("timestamp")
    kind = day_kind(ts, QUERY_WEEKEND, "Weekend", "Weekday").alias("day_type")
    daily = (
        scope.rows(projection)
        .groupBy(
            *scope.keys,
            day_of_year(ts).alias("day_of_year"),
            *([kind] if "day_type" in groups else []),
            hour_of(ts).alias("hour_of_day"),
            *extra,
        )
        .agg(F.sum("value").alias("total"))
        .withColumn("season", season(F.col("day_of_year")))
    )
    keys = [*scope.keys, *groups, "hour_of_day", *extra]
    return daily.groupBy(*keys).agg(AGGREGATES[agg]("total").alias("value")).orderBy(*keys)
