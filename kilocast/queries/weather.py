"""Weather series beside the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilocast.functions.calendar import day_start, week_index
from kilocast.queries.series import DAILY_MEAN, HOURLY, WEEKLY_MEAN

# Weather variables and their columns.
WEATHER_VARIABLES = {
    "BAIT": "bait",
    "HDD": "hdd",
    "CDD": "cdd",
    "Temperature": "temperature",
    "Solar_Radiation": "solar_radiation",
    "Wind_Speed": "wind_speed",
    "Dew_Point": "dew_point",
    "Humidity": "humidity",
}


def weather_series(
    days: DataFrame, variable: str, resample: str, geography: str | None = None
) -> DataFrame:
    """A variable of the degree-day table as stored ("Hourly"), or its mean by day or week."""
    if variable not in WEATHER_VARIABLES:
        raise ValueError(
            f"there is no series of {variable!r}; there are {list(WEATHER_VARIABLES)}"
        )
    column = F.col(WEATHER_VARIABLES[variable])
    ts = F.col("timestamp")
    places = [] if geography is not None else ["geography"]
    rows = days if geography is None else days.filter(F.col("geography") == geography)
    if resample == HOURLY:
        series = rows.select(*places, ts.alias("datetime"), column.alias("value"))
    elif resample == DAILY_MEAN:
        series = rows.groupBy(*places, day_start(ts).alias("datetime")).agg(
            F.avg(column).alias("value")
        )
    elif resample == WEEKLY_MEAN:
        series = (
            rows.groupBy(*places, week_index(ts).alias("week"))
            .agg(F.min(ts).alias("datetime"), F.avg(column).alias("value"))
            .drop("week")
        )
    else:
        raise ValueError(f"{resample!r} names no way to resample weather")
    return series.orderBy(*places, "datetime")


def weather_overlay(
    days: DataFrame, variable: str, resample: str, geography: str | None = None
) -> DataFrame:
    """The series numbered like the load; under an hourly load each day repeats 24 times."""
    hourly = resample == HOURLY
    series = weather_series(days, variable, DAILY_MEAN if hourly else resample, geography)
    places = [c for c in series.columns if c == "geography"]
    in_order = Window.partitionBy(*places).orderBy("datetime")
    numbered = series.withColumn("time_period", F.row_number().over(in_order).cast("long"))
    if hourly:
        hour = F.explode(F.sequence(F.lit(1), F.lit(24)))
        numbered = numbered.withColumn("hour", hour).withColumn(
            "time_period", (F.col("time_period") - 1) * 24 + F.col("hour")
        )
    return numbered.select(*places, "datetime", "time_period", "value").orderBy(
        *places, "time_period"
    )
