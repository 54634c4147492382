"""Fingerprints of what the rows of a scenario and year are made from.

Sums of hashes over whole tables, whatever the order of the rows. Calculated
numbers count with ``DIGITS`` significant digits, because sums of another order
differ in the last ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 12


def _digest(*columns: Column) -> Column:
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")


def _cut(name: str) -> Column:
    return F.format_string(f"%.{DIGITS - 1}e", F.col(name))


def factor_prints(factors: DataFrame) -> dict[tuple[str, str], str]:
    """By scenario and year; as many rows as the result has partitions."""
    mark = _digest(F.col("geography"), F.col("sector"), _cut("scaling_factor"))
    rows = factors.groupBy("scenario", "model_year").agg(mark).collect()
    return {(r[0], str(r[1])): r[2] for r in rows}


def shape_prints(shapes: DataFrame) -> dict[str, str]:
    """By year."""
    columns = [F.col(c) for c in shapes.columns if c != "model_year"]
    return {str(r[0]): r[1] for r in shapes.groupBy("model_year").agg(_digest(*columns)).collect()}


def weather_print(multipliers: DataFrame) -> str:
    kinds = [_cut(c) for c in multipliers.columns if c.endswith("_multiplier")]
    return str(multipliers.agg(_digest(*[F.col(c) for c in ("geography", "month", "day_type", "timestamp")], *kinds)).first()[0])
