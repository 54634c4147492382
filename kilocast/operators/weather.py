"""Daily weather, degree days and the temperature multipliers built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilocast.config import ModelParameters
from kilocast.functions.calendar import (
    PIPELINE_WEEKEND,
    day_kind,
    day_of,
    in_year,
    month_of,
    year_of,
)
from kilocast.functions.reshape import widen
from kilocast.operators.drivers import in_countries

# Metric names in the weather table and the columns they become.
WEATHER_COLUMNS = {
    "Temperature": "temperature",
    "Solar_Radiation": "solar_radiation",
    "Wind_Speed": "wind_speed",
    "Dew_Point": "dew_point",
    "Humidity": "humidity",
    "BAIT": "bait",
}

# Kinds of temperature multipliers.
KINDS = ("heating", "cooling", "other")

# Days of one month that share a typical-day shape.
GROUP_KEYS = ["geography", "weather_year", "month", "day_type"]


def daily_weather(
    df: DataFrame,
    countries: Sequence[str] | None,
    weather_year: int,
    weekend_days: tuple[int, ...] = PIPELINE_WEEKEND,
) -> DataFrame:
    """Long to wide, one row per geography and timestamp of the weather year."""
    chosen = in_countries(df, countries).filter(in_year(F.col("timestamp"), weather_year))
    wide = widen(chosen, ["geography", "timestamp"], "metric", WEATHER_COLUMNS, F.max)
    ts = F.col("timestamp")
    return wide.select(
        "geography",
        "timestamp",
        *WEATHER_COLUMNS.values(),
        year_of(ts).alias("weather_year"),
        month_of(ts).alias("month"),
        day_of(ts).alias("day"),
        day_kind(ts, weekend_days).alias("day_type"),
    )


def degree_days(daily: DataFrame, parameters: ModelParameters) -> DataFrame:
    """Heating and cooling degree days; a missing temperature counts as none of either."""
    none, bait = F.lit(0.0), F.col("bait")
    return daily.withColumns(
        {
            "hdd": F.greatest(none, F.lit(float(parameters.heating_threshold)) - bait),
            "cdd": F.greatest(none, bait - F.lit(float(parameters.cooling_threshold))),
        }
    )


def grouped_degree_days(days: DataFrame) -> DataFrame:
    return days.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("num_days"),
        F.sum("hdd").alias("total_hdd"),
        F.sum("cdd").alias("total_cdd"),
    )


def max_degree_days(days: DataFrame) -> DataFrame:
    return days.groupBy(*GROUP_KEYS).agg(
        F.max("hdd").alias("max_hdd"), F.max("cdd").alias("max_cdd")
    )


def _raised(value: str, total: str, top: str, factor: float) -> Column:
    floor = F.col(top) / F.lit(factor)
    low = (F.col(total) > 0) & F.col(top).isNotNull() & (F.col(value) < floor)
    return F.when(low, floor).otherwise(F.col(value))


def smoothed_degree_days(
    days: DataFrame, parameters: ModelParameters, grouped: DataFrame | None = None
) -> DataFrame:
    """Raise low degree days of a group that has some to a share of its maximum.

    Group count, totals and maxima come from one window over the group, which
    holds the days of one month at one place. ``grouped`` replaces count and
    totals when a user supplies them.
    """
    group = Window.partitionBy(*GROUP_KEYS)
    if grouped is None:
        known = days.withColumns(
            {
                "num_days": F.count(F.lit(1)).over(group),
                "total_hdd": F.sum("hdd").over(group),
                "total_cdd": F.sum("cdd").over(group),
            }
        )
    else:
        known = days.join(
            grouped.select(*GROUP_KEYS, "num_days", "total_hdd", "total_cdd"), GROUP_KEYS
        )
    known = known.withColumns(
        {"max_hdd": F.max("hdd").over(group), "max_cdd": F.max("cdd").over(group)}
    )
    if not parameters.enable_shoulder_month_smoothing:
        return known.withColumns({"adjusted_hdd": F.col("hdd"), "adjusted_cdd": F.col("cdd")})
    factor = float(parameters.shoulder_month_smoothing_factor)
    return known.withColumns(
        {
            "adjusted_hdd": _raised("hdd", "total_hdd", "max_hdd", factor),
            "adjusted_cdd": _raised("cdd", "total_cdd", "max_cdd", factor),
        }
    )


def adjusted_totals(smoothed: DataFrame) -> DataFrame:
    return smoothed.groupBy(*GROUP_KEYS).agg(
        F.sum("adjusted_hdd").alias("adjusted_total_hdd"),
        F.sum("adjusted_cdd").alias("adjusted_total_cdd"),
    )


def _share_of_group(total: str, adjusted: str) -> Column:
    group = Window.partitionBy(*GROUP_KEYS)
    none = (F.col(total) == 0) | F.col(total).isNull()
    share = F.col(adjusted) / F.sum(adjusted).over(group)
    return F.when(none, F.lit(1.0)).otherwise(share * F.col("num_days"))


def temperature_multipliers(
    days: DataFrame, parameters: ModelParameters, grouped: DataFrame | None = None
) -> DataFrame:
    """Per-day heating and cooling multipliers; over a group each adds up to its days.

    All steps share the window of ``smoothed_degree_days``: one shuffle, one
    sort, no join of the days to their own aggregates.
    """
    smoothed = smoothed_degree_days(days, parameters, grouped)
    return smoothed.select(
        "geography",
        "timestamp",
        "weather_year",
        "month",
        "day",
        "day_type",
        "bait",
        "hdd",
        "cdd",
        "adjusted_hdd",
        "adjusted_cdd",
        "num_days",
        "total_hdd",
        "total_cdd",
        _share_of_group("total_hdd", "adjusted_hdd").alias("heating_multiplier"),
        _share_of_group("total_cdd", "adjusted_cdd").alias("cooling_multiplier"),
        F.lit(1.0).alias("other_multiplier"),
    )


def range_columns() -> list[Column]:
    """The smallest and largest multiplier of each kind, as aggregates."""
    return [
        pick(f"{kind}_multiplier").alias(f"{label}_{kind}")
        for kind in KINDS
        for label, pick in (("min", F.min), ("max", F.max))
    ]


def multiplier_range(multipliers: DataFrame) -> DataFrame:
    """One row with the smallest and largest multiplier of each kind."""
    return multipliers.agg(*range_columns())
