"""Representative-day load shapes and their expansion to every hour of a year.

Expansion multiplies rows by about fifteen, so everything that can be settled
on representative rows (annual totals, scaling) is, and expanded rows are only
projected, never shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilocast.functions.calendar import add_hours, hours_of
from kilocast.operators.drivers import in_countries, in_years

# Sector names of the load shapes and of the energy intensities.
SECTOR_NAMES = {
    "Industry": "Industrial",
    "Transport": "Transportation",
    "Service": "Commercial",
}

# End uses that follow temperature. All others do not.
TEMPERATURE_END_USES = ("heating", "cooling")

DAY_KEYS = ["geography", "month", "day_type"]
SECTOR_KEYS = ["geography", "model_year", "sector"]
_KINDS = (*TEMPERATURE_END_USES, "other")
# Join keys per day group of a geography.
SPREAD = 8


def base_shapes(
    df: DataFrame, countries: Sequence[str] | None, years: Sequence[int]
) -> DataFrame:
    """Chosen shapes with model sector names; a shape of unknown day type counts as weekend."""
    sector = F.col("sector")
    recoded = F.coalesce(
        *[F.when(sector == theirs, ours) for theirs, ours in SECTOR_NAMES.items()], sector
    )
    return in_years(in_countries(df, countries), years).select(
        "geography",
        "model_year",
        "month",
        "hour",
        "is_weekday",
        recoded.alias("sector"),
        F.col("metric").alias("enduse"),
        F.col("value").alias("load_shape_value"),
        F.when(F.col("is_weekday"), "weekday").otherwise("weekend").alias("day_type"),
    )


def tag_multiplier(shapes: DataFrame) -> DataFrame:
    """Add ``multiplier_type``; rows without an end use take part in nothing and go."""
    enduse = F.col("enduse")
    kind = F.when(enduse.isin(*TEMPERATURE_END_USES), enduse).otherwise("other")
    return shapes.filter(enduse.isNotNull()).withColumn("multiplier_type", kind)


def enduse_kinds(shapes: DataFrame) -> DataFrame:
    """Each end use and the multiplier it takes."""
    return tag_multiplier(shapes).select("enduse", "multiplier_type").distinct()


def _by_kind(template: str) -> Column:
    kind = F.col("multiplier_type")
    chain = F.when(kind == _KINDS[0], F.col(template.format(_KINDS[0])))
    chain = chain.when(kind == _KINDS[1], F.col(template.format(_KINDS[1])))
    return chain.otherwise(F.col(template.format(_KINDS[2])))


def hour_slot(spread: int = SPREAD) -> Column:
    """The part of a day's hours that an hour belongs to."""
    return F.coalesce(F.pmod(F.col("hour"), F.lit(spread)).cast("int"), F.lit(0))


def _days(multipliers: DataFrame, spread: int) -> DataFrame:
    """The days with their hours and multipliers, once for every slot of hours."""
    days = multipliers.select(
        *DAY_KEYS,
        F.col("timestamp").alias("_day"),
        hours_of(F.col("timestamp")).alias("_hours"),
        "weather_year",
        *[f"{kind}_multiplier" for kind in _KINDS],
    )
    return days.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))


def _at_hour() -> Column:
    # Ready-made hours spare calendar arithmetic on every expanded row.
    return F.coalesce(
        F.get("_hours", F.col("hour").cast("int")), add_hours(F.col("_day"), F.col("hour"))
    ).alias("timestamp")


def expand(shapes: DataFrame, multipliers: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Repeat each representative hour on every matching day of the weather year.

    The shapes carry any further columns through. The join keys hold a slot of
    hours, ``spread`` of them for each (geography, month, day type), so that one
    large geography is not expanded by 24 tasks; the multipliers, at most a
    month of days per key, are repeated for every slot.
    """
    tagged = tag_multiplier(shapes).withColumn("_slot", hour_slot(spread))
    carried = [c for c in shapes.columns if c not in ("month", "hour", "is_weekday", "day_type")]
    return tagged.join(_days(multipliers, spread), [*DAY_KEYS, "_slot"]).select(
        *[c for c in carried if c != "load_shape_value"],
        _at_hour(),
        "weather_year",
        "load_shape_value",
        _by_kind("{}_multiplier").alias("multiplier"),
    )


def with_days(shapes: DataFrame, multipliers: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Each representative hour with the hours it stands for as an array, and their multipliers as another.

    The rows are still as many as the shapes, so they can be dealt and sorted
    before ``unfold`` makes the hours of them, which come out in the same order.
    """
    stamp = F.col("timestamp")
    days = F.sort_array(F.collect_list(F.struct(stamp, *[f"{kind}_multiplier" for kind in _KINDS])))
    months = multipliers.groupBy(*DAY_KEYS).agg(days.alias("_days"))  # at most a month of days

    def each(name: str) -> Column:
        return F.transform("_days", lambda d: d[name])

    stamps = each("timestamp")
    months = months.select(
        *DAY_KEYS,
        stamps.alias("_stamps"),
        F.transform(
            F.sequence(F.lit(0), F.lit(23)),
            lambda h: F.transform(stamps, lambda day: add_hours(day, h)),
        ).alias("_hours"),
        *[each(f"{kind}_multiplier").alias(f"_{kind}") for kind in _KINDS],
        F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_slot"),
    )
    tagged = tag_multiplier(shapes).withColumn("_slot", hour_slot(spread))
    odd = F.transform("_stamps", lambda day: add_hours(day, F.col("hour")))
    return tagged.join(months, [*DAY_KEYS, "_slot"]).select(
        *[c for c in shapes.columns if c not in ("month", "is_weekday", "day_type")],
        F.coalesce(F.get("_hours", F.col("hour").cast("int")), odd).alias("timestamp"),
        _by_kind("_{}").alias("multiplier"),
    )


def unfold(shapes: DataFrame) -> DataFrame:
    """A row for every hour of ``with_days``."""
    arrays = ("timestamp", "multiplier")
    return shapes.select(
        *[c for c in shapes.columns if c not in (*arrays, "hour")], F.inline(F.arrays_zip(*arrays))
    )


def hourly_sums(shapes: DataFrame, multipliers: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Sum of the adjusted values per hour and ``keys``, without a row for each shape and hour.

    An hour's multipliers depend on the day and the kind alone, so the values of
    all shapes of one kind are added up on the representative rows, and three
    sums for each hour of a representative day are expanded in place of a row
    for every sector and end use. ``keys`` include the geography; a sum without
    any value is NULL, as that of the hourly rows is.
    """
    kind = F.col("multiplier_type")
    sums = (
        tag_multiplier(shapes)
        .groupBy(*keys, "month", "day_type", "hour")
        .agg(*[F.sum(F.when(kind == k, value)).alias(f"{k}_sum") for k in _KINDS])
        .withColumn("_slot", hour_slot())
    )
    terms = [F.col(f"{k}_sum") * F.col(f"{k}_multiplier") for k in _KINDS]
    total = reduce(Column.__add__, [F.coalesce(t, F.lit(0.0)) for t in terms])
    hours = sums.join(_days(multipliers, SPREAD), [*DAY_KEYS, "_slot"]).select(
        *keys, _at_hour(), F.when(F.coalesce(*terms).isNotNull(), total).alias("value")
    )
    # Hours beyond a day fall on those of its neighbours.
    return hours.groupBy(*keys, "timestamp").agg(F.sum("value").alias("value"))


def adjust(expanded: DataFrame) -> DataFrame:
    return expanded.withColumn(
        "adjusted_value", F.col("load_shape_value") * F.col("multiplier")
    )


def annual_totals(shapes: DataFrame, multipliers: DataFrame, *more: str) -> DataFrame:
    """Sum of the adjusted shapes over the year by sector and ``more`` columns, without expanding them.

    Within (geography, month, day type, multiplier kind) every shape meets
    every day, so the sum of products is the product of sums. The shapes shrink
    to a few rows per sector in a map-side partial sum, whatever the size of
    one geography, before anything is joined.
    """
    per_month = (
        tag_multiplier(shapes)
        .groupBy(*SECTOR_KEYS, *more, "month", "day_type", "multiplier_type")
        .agg(F.sum("load_shape_value").alias("shape_sum"))
    )
    per_group = multipliers.groupBy(*DAY_KEYS).agg(
        *[F.sum(f"{kind}_multiplier").alias(f"{kind}_sum") for kind in _KINDS]
    )
    return (
        per_month.join(per_group, DAY_KEYS)
        .groupBy(*SECTOR_KEYS, *more)
        .agg(F.sum(F.col("shape_sum") * _by_kind("{}_sum")).alias("load_shape_annual_total"))
    )


def expanded_totals(adjusted: DataFrame) -> DataFrame:
    """The same totals from hourly rows, for a user-supplied expanded table."""
    return adjusted.groupBy(*SECTOR_KEYS).agg(
        F.sum("adjusted_value").alias("load_shape_annual_total")
    )
