"""Coefficient keys and the two regression forms shared by energy, vehicle and distance models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilocast.functions.reshape import widen

COEFFICIENTS = ["a0", "a1", "t0"]


def split_key(df: DataFrame, first_part: int) -> DataFrame:
    """Replace ``metric`` by ``parameter`` and ``regression_type``.

    Keys look like ``<class>_<parameter>_<regression>`` (``first_part=2``) or
    ``<parameter>_<regression>`` (``first_part=1``).
    """
    kept = [c for c in df.columns if c not in ("metric", "value")]
    key = F.col("metric").cast("string")
    return df.select(
        *kept,
        F.split_part(key, F.lit("_"), F.lit(first_part)).alias("parameter"),
        F.split_part(key, F.lit("_"), F.lit(first_part + 1)).alias("regression_type"),
        "value",
    )


def pivot_coefficients(df: DataFrame) -> DataFrame:
    """One row per series with columns a0, a1, t0, each NULL where the series lacks it."""
    keys = [c for c in df.columns if c not in ("parameter", "value")]
    return widen(df, keys, "parameter", {c: c for c in COEFFICIENTS}, F.sum)


def evaluate(factors: Sequence[Column] = ()) -> Column:
    """Regression value at ``model_year`` times ``factors``; an unknown form gives NULL."""
    trend = F.col("a0") + F.col("a1") * (F.col("model_year") - F.col("t0"))
    form = F.col("regression_type")
    return F.when(form == "exp", reduce(mul, factors, F.exp(trend))).when(
        form == "lin", reduce(mul, factors, trend)
    )
