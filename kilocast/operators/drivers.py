"""Annual drivers: rows of the chosen countries and model years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_countries(df: DataFrame, countries: Sequence[str] | None) -> DataFrame:
    return df if countries is None else df.filter(F.col("geography").isin(*countries))


def in_years(df: DataFrame, years: Sequence[int]) -> DataFrame:
    return df.filter(F.col("model_year").isin(*years))


def select_driver(
    df: DataFrame,
    countries: Sequence[str] | None,
    years: Sequence[int],
    value_name: str = "value",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Filter at the leaf, on raw columns, so that both tests reach the scan."""
    chosen = in_years(in_countries(df, countries), years)
    return chosen.select(
        "geography", *extra, "model_year", F.col("value").alias(value_name)
    )


def attach_driver(
    df: DataFrame, driver: DataFrame, value_name: str, on: Sequence[str] = ("geography",)
) -> DataFrame:
    """Inner join; on geography alone each row fans out to every model year of the driver.

    Both sides hold a few rows per geography, so the choice of join is left to
    the optimizer, which broadcasts only what it has measured to be small.
    """
    return df.join(driver.withColumnRenamed("value", value_name), list(on))
