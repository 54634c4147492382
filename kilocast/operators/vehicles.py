"""Electric-vehicle chain: vehicle stock, electric share, distance and annual energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.functions.regression import evaluate, split_key
from kilocast.operators.drivers import in_countries

# Fixed value: Wh in one TJ.
WH_PER_TJ = 277777777.778

_BY_YEAR = ["geography", "model_year"]


def parse_vehicle_key(df: DataFrame, countries: Sequence[str] | None) -> DataFrame:
    return split_key(
        in_countries(df.select("geography", "metric", "value"), countries), first_part=1
    )


def vehicle_stock(df: DataFrame) -> DataFrame:
    return df.select(*_BY_YEAR, evaluate([F.col("population_value")]).alias("total_vehicles"))


def electric_stock(stock: DataFrame, share: DataFrame) -> DataFrame:
    total = F.col("total_vehicles") * F.col("ev_stock_share")
    return stock.join(share, _BY_YEAR).select(*_BY_YEAR, total.alias("ev_stock_total"))


def split_stock(stock: DataFrame, phev_share: DataFrame) -> DataFrame:
    total, share = F.col("ev_stock_total"), F.col("phev_share")
    return stock.join(phev_share, _BY_YEAR).select(
        *_BY_YEAR,
        (total * (1 - share)).alias("bev_stock"),
        (total * share).alias("phev_stock"),
    )


def distance_per_vehicle(coefficients: DataFrame, population: DataFrame) -> DataFrame:
    """Evaluate the distance regression in every year for which population is known."""
    return coefficients.join(population.select(*_BY_YEAR), "geography").select(
        *_BY_YEAR, evaluate().alias("km_per_vehicle_year")
    )


def energy_by_type(stock: DataFrame, distance: DataFrame, wh_per_km: DataFrame) -> DataFrame:
    """Wh per year and vehicle type.

    The stock is unpivoted to one row per type, so one pass of two joins serves
    both types.
    """
    by_type = stock.unpivot(
        _BY_YEAR, ["bev_stock", "phev_stock"], "ev_type", "stock"
    ).withColumn("ev_type", F.split_part("ev_type", F.lit("_"), F.lit(1)))
    use = wh_per_km.withColumnRenamed("subsector", "ev_type")
    energy = F.col("stock") * F.col("km_per_vehicle_year") * F.col("wh_per_km")
    return (
        by_type.join(distance, _BY_YEAR)
        .join(use, [*_BY_YEAR, "ev_type"])
        .select(*_BY_YEAR, "ev_type", energy.alias("wh_per_year"))
    )


def annual_vehicle_energy(energy: DataFrame) -> DataFrame:
    """Energy of all types in TJ, shaped like the intensity result it may replace."""
    return energy.groupBy(*_BY_YEAR).agg(F.sum("wh_per_year").alias("wh")).select(
        *_BY_YEAR,
        F.lit("Transportation").alias("sector"),
        F.lit("Road").alias("subsector"),
        (F.col("wh") / F.lit(WH_PER_TJ)).alias("value"),
    )
