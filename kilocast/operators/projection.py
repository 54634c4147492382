"""Scaling of load shapes to annual energy, giving the hourly projection (MWh per hour)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilocast.operators.shapes import (
    SECTOR_KEYS,
    adjust,
    annual_totals,
    expand,
    hour_slot,
    hourly_sums,
    unfold,
    with_days,
)
from kilocast.schemas import PROJECTION

# Fixed value: MWh in one TJ, to the digits that results are compared with.
MWH_PER_TJ = 277.777777778

RESULT_COLUMNS = PROJECTION.fieldNames()

# Order of the rows in the files of a written projection.
FILE_ORDER = ("scenario", "model_year", "geography")


def annual_mwh(energy: DataFrame) -> DataFrame:
    return energy.select(
        *SECTOR_KEYS, "subsector", (F.col("value") * MWH_PER_TJ).alias("annual_mwh")
    )


def is_road() -> Column:
    return (F.col("sector") == "Transportation") & (F.col("subsector") == "Road")


def replace_road_energy(energy: DataFrame, vehicle_energy: DataFrame) -> DataFrame:
    """Swap road transport (MWh) for the vehicle-based figure (TJ).

    The negated conjunction keeps three-valued logic: a transport row without a
    subsector goes too.
    """
    return energy.filter(~is_road()).unionByName(annual_mwh(vehicle_energy))


def scaling_factors(totals: DataFrame, energy: DataFrame) -> DataFrame:
    """Annual energy over annual shape total; 1 where the shapes add up to nothing.

    ``energy`` may carry a scenario column, which is then kept: scenarios that
    share their shapes need one table of factors.
    """
    keys = [c for c in ("scenario", *SECTOR_KEYS) if c in energy.columns]
    annual = energy.groupBy(*keys).agg(F.sum("annual_mwh").alias("annual_mwh"))
    total = F.col("load_shape_annual_total")
    factor = F.when(total > 0, F.col("annual_mwh") / total).otherwise(F.lit(1.0))
    return totals.join(annual, SECTOR_KEYS).select(*keys, factor.alias("scaling_factor"))


def _scaled_value() -> Column:
    return F.col("adjusted_value") * F.col("scaling_factor")


def project_shapes(
    shapes: DataFrame, multipliers: DataFrame, factors: DataFrame, files: int | None = None
) -> DataFrame:
    """Hourly projection from representative shapes.

    Factors join the representative rows; expansion comes last, so no expanded
    row is ever shuffled. Sectors without annual energy drop out of the join.

    With ``files`` the rows are laid out for writing: representative rows are
    dealt by scenario, model year and that many parts of (geography, hour slot),
    so that hours leave in as many files for each scenario and year, each with
    few geographies, and sorted as the files want them. The hours keep that
    order without being sorted.
    """
    scaled = shapes.join(factors, SECTOR_KEYS)
    if files is None:
        return _result(adjust(expand(scaled, multipliers)))
    part = F.pmod(F.xxhash64("geography", hour_slot()), F.lit(files))
    dealt = with_days(scaled, multipliers).repartition("scenario", "model_year", part)
    return _result(adjust(unfold(dealt.sortWithinPartitions(*FILE_ORDER))))


def project_hours(shapes: DataFrame, multipliers: DataFrame, factors: DataFrame) -> DataFrame:
    """The load of every hour, all sectors and end uses together, without the hourly rows of each."""
    scaled = shapes.join(factors, SECTOR_KEYS)
    value = F.col("load_shape_value") * F.col("scaling_factor")
    keys = ["scenario", "model_year", "geography"]
    return hourly_sums(scaled, multipliers, keys, value).select("timestamp", *keys, "value")


def project_years(shapes: DataFrame, multipliers: DataFrame, factors: DataFrame) -> DataFrame:
    """The energy of every year by sector and end use, without any hourly row."""
    totals = annual_totals(shapes, multipliers, "enduse").join(factors, SECTOR_KEYS)
    energy = F.col("load_shape_annual_total") * F.col("scaling_factor")
    return totals.select(
        "scenario", "model_year", "geography", "sector", F.col("enduse").alias("metric"), energy.alias("value")
    )


def project_expanded(adjusted: DataFrame, factors: DataFrame) -> DataFrame:
    """Hourly projection from a table that is hourly already."""
    return _result(adjusted.join(factors, SECTOR_KEYS))


def _result(hourly: DataFrame) -> DataFrame:
    tail = ["scenario"] if "scenario" in hourly.columns else []
    return hourly.select(
        "timestamp",
        "model_year",
        "geography",
        "sector",
        F.col("enduse").alias("metric"),
        _scaled_value().alias("value"),
        *tail,
    )


def tag_scenario(parts: Sequence[DataFrame], scenario: str) -> DataFrame:
    """Union of the sector projections of one scenario, in result column order."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.withColumn("scenario", F.lit(scenario)).select(*RESULT_COLUMNS)
