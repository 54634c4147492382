"""Annual energy (TJ) from energy-intensity regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.functions.regression import evaluate, split_key
from kilocast.operators.drivers import in_countries

NON_RESIDENTIAL = ("Commercial", "Industrial", "Transportation")
RESIDENTIAL = ("Residential",)


def parse_intensity(df: DataFrame, countries: Sequence[str] | None) -> DataFrame:
    columns = df.select("geography", "sector", "subsector", "metric", "value")
    return split_key(in_countries(columns, countries), first_part=2)


def pick_sectors(df: DataFrame, sectors: Sequence[str]) -> DataFrame:
    return df.filter(F.col("sector").isin(*sectors))


def annual_energy(df: DataFrame, *drivers: str) -> DataFrame:
    """Regression times the named driver columns."""
    return df.select(
        "geography",
        "model_year",
        "sector",
        "subsector",
        evaluate([F.col(name) for name in drivers]).alias("value"),
    )
