"""Wall-clock helpers. Every result keeps TIMESTAMP_NTZ and BIGINT, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First day of year of each season; days before spring or from
# the last bound on are winter.
SPRING_FROM = 79
SUMMER_FROM = 151
FALL_FROM = 234
WINTER_FROM = 324

# Spark numbers days 1 (Sunday) to 7 (Saturday). The pipeline treats Saturday
# alone as weekend, the queries Saturday and Sunday; results depend on both.
PIPELINE_WEEKEND = (7,)
QUERY_WEEKEND = (1, 7)


def day_start(ts: Column) -> Column:
    """Midnight of the day, still without a time zone (``date_trunc`` would add one)."""
    return F.to_date(ts).cast("timestamp_ntz")


def add_hours(ts: Column, hours: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, hours.cast("int"), zero, F.lit(0.0))


def hours_of(day: Column) -> Column:
    """The 24 hours that begin with ``day``, as an array."""
    return F.sequence(day, add_hours(day, F.lit(23)), F.expr("INTERVAL '1' HOUR"))


def hour_start(ts: Column) -> Column:
    return add_hours(day_start(ts), F.hour(ts))


def in_year(ts: Column, year: int) -> Column:
    """A range test on the raw column, which reaches the file scan; ``year(ts) = y`` does not."""
    first = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    after = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (ts >= first) & (ts < after)


def minute_number(ts: Column) -> Column:
    """Minutes on the wall clock since 1970, free of any time zone."""
    return (F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)) * 60 + F.minute(ts)


def microseconds(ts: Column) -> Column:
    """Microseconds on the wall clock since 1970, free of any time zone."""
    of_minute = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return minute_number(ts).cast("long") * 60_000_000 + of_minute


def year_of(ts: Column) -> Column:
    return F.year(ts).cast("long")


def month_of(ts: Column) -> Column:
    return F.month(ts).cast("long")


def day_of(ts: Column) -> Column:
    return F.dayofmonth(ts).cast("long")


def hour_of(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts).cast("long")


def week_index(ts: Column) -> Column:
    """0 for days 1-7 of the year, 1 for days 8-14, and so on."""
    return F.floor((day_of_year(ts) - 1) / 7).cast("long")


def season(doy: Column) -> Column:
    return (
        F.when((doy < SPRING_FROM) | (doy >= WINTER_FROM), "Winter")
        .when(doy < SUMMER_FROM, "Spring")
        .when(doy < FALL_FROM, "Summer")
        .otherwise("Fall")
    )


def day_kind(
    ts: Column, weekend_days: tuple[int, ...], weekend: str = "weekend", weekday: str = "weekday"
) -> Column:
    return F.when(F.dayofweek(ts).isin(*weekend_days), weekend).otherwise(weekday)
