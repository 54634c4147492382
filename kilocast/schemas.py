"""Column layouts of the input tables and of the hourly projection.

Fixed values: table names and column names are what users' files carry.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampNTZType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


_PER_YEAR = _struct(geography="string", model_year="long", value="double")
_REGRESSION = _struct(geography="string", metric="string", value="double")

DATA_TABLES: dict[str, T.StructType] = {
    "energy_intensity": _struct(
        geography="string", sector="string", subsector="string", metric="string", value="double"
    ),
    "gdp": _PER_YEAR,
    "hdi": _PER_YEAR,
    "load_shapes": _struct(
        geography="string",
        model_year="long",
        month="long",
        hour="long",
        is_weekday="boolean",
        sector="string",
        metric="string",
        value="double",
    ),
    "population": _PER_YEAR,
    "weather_bait": _struct(
        geography="string", timestamp="timestamp", metric="string", value="double"
    ),
    "electricity_per_vehicle_km_projections": _struct(
        geography="string", subsector="string", model_year="long", value="double"
    ),
    "ev_stock_share_projections": _PER_YEAR,
    "km_per_vehicle_year_regressions": _REGRESSION,
    "phev_share_projections": _PER_YEAR,
    "vehicle_per_capita_regressions": _REGRESSION,
}

PROJECTION = _struct(
    timestamp="timestamp",
    model_year="long",
    scenario="string",
    sector="string",
    geography="string",
    metric="string",
    value="double",
)

# Sums of the hourly projection that are stored beside it.
HOURS = _struct(timestamp="timestamp", scenario="string", model_year="long", geography="string", value="double")
YEARS = _struct(
    scenario="string",
    model_year="long",
    geography="string",
    sector="string",
    metric="string",
    value="double",
)
