"""Load duration curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilocast.functions.reshape import widen
from kilocast.queries.scope import Scope


def load_duration(
    projection: DataFrame, scope: Scope, series: str, values: Sequence[str | int]
) -> DataFrame:
    """Hourly totals of each series, sorted by themselves from high to low.

    ``series`` is ``scenario`` or ``year`` and ``values`` the columns wanted. A
    place has one row per distinct hour over all series; shorter series end in
    NULL. Ranking works on hourly totals, at most 8784 per place and series.
    """
    places = scope.places
    columns = {value: f"s{i}" for i, value in enumerate(values)}
    slots = list(columns.values())
    wide = widen(scope.rows(projection), [*places, "timestamp"], series, columns, F.sum)
    tall = wide.unpivot(places, slots, "slot", "load")
    by_load = Window.partitionBy(*places, "slot").orderBy(F.col("load").desc_nulls_last())
    ranked = tall.withColumn("rank", (F.row_number().over(by_load) - 1).cast("long"))
    curves = widen(ranked, [*places, "rank"], "slot", {s: s for s in slots}, F.max, "load")
    return curves.select(
        *places, "rank", *[F.col(slot).alias(str(v)) for v, slot in columns.items()]
    ).orderBy(*places, "rank")
