import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kilocast import ModelParameters, Project, ProjectConfig, Scenario  # noqa: E402
from kilocast.functions.calendar import add_hours  # noqa: E402
from kilocast.schemas import DATA_TABLES, PROJECTION  # noqa: E402
from tools.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return session


def table(spark, name, rows):
    return spark.createDataFrame(rows, DATA_TABLES[name])


def hourly(spark, rows):
    """Projection rows given as (hour of 2018, year, scenario, sector, geography, metric, value)."""
    start = dt.datetime(2018, 1, 1)
    return spark.createDataFrame(
        [(start + dt.timedelta(hours=h), *rest) for h, *rest in rows], PROJECTION
    )


@pytest.fixture(scope="session")
def week_load(spark):
    """All hours of 2018 in two scenarios: 1 on weekdays, 8 on weekends, per sector and end use."""
    hours = spark.range(8760).select(
        add_hours(F.lit("2018-01-01").cast("timestamp_ntz"), F.col("id")).alias("timestamp")
    )
    cells = spark.createDataFrame(
        [
            (2030, s, sector, "here", metric)
            for s in ("baseline", "other")
            for sector in ("Commercial", "Residential")
            for metric in ("heating", "other")
        ],
        "model_year long, scenario string, sector string, geography string, metric string",
    )
    value = F.when(F.dayofweek("timestamp").isin(1, 7), 8.0).otherwise(1.0)
    return hours.crossJoin(cells).withColumn("value", value).select(*PROJECTION.fieldNames()).cache()


YEARS = [2025, 2030]
COUNTRIES = ["north", "south"]


def tiny_data(spark):
    """Two countries, two years, a full weather year; south has no commerce."""
    start = dt.datetime(2018, 1, 1)
    days = [start + dt.timedelta(days=d) for d in range(365)]
    by_year = [(c, y) for c in COUNTRIES for y in YEARS]
    intensity = []
    for c in COUNTRIES:
        for sector, kind, form in (
            ("Commercial", "nonres", "exp"),
            ("Industrial", "nonres", "lin"),
            ("Transportation", "nonres", "exp"),
            ("Residential", "res", "lin"),
        ):
            if (c, sector) == ("south", "Commercial"):
                continue
            parts = ["Road", "Rail"] if sector == "Transportation" else ["All"]
            for part in parts:
                for name, value in (("a0", 0.5), ("a1", 0.01), ("t0", 2020.0)):
                    intensity.append((c, sector, part, f"{kind}_{name}_{form}", value))
    shapes = [
        (c, y, month, hour, weekday, sector, metric, 1.0 + hour + month / 10)
        for c, y in by_year
        for month in range(1, 13)
        for hour in range(0, 24, 6)
        for weekday in (True, False)
        for sector in ("Industry", "Transport", "Service", "Residential", "Fishing")
        for metric in ("heating", "cooling", "lighting")
    ]
    weather = [
        (c, d, metric, float(value))
        for c in COUNTRIES
        for d in days
        for metric, value in (("BAIT", 18 + (d.timetuple().tm_yday % 37) - 18), ("Humidity", 50))
    ]
    regression = [
        (c, f"{name}_lin", value)
        for c in COUNTRIES
        for name, value in (("a0", 0.3), ("a1", 0.001), ("t0", 2020.0))
    ]
    return {
        "energy_intensity": table(spark, "energy_intensity", intensity),
        "gdp": table(spark, "gdp", [(c, y, 50.0 + y - 2020) for c, y in by_year]),
        "hdi": table(spark, "hdi", [(c, y, 0.9) for c, y in by_year]),
        "population": table(spark, "population", [(c, y, 1e6) for c, y in by_year]),
        "load_shapes": table(spark, "load_shapes", shapes),
        "weather_bait": table(spark, "weather_bait", weather),
        "electricity_per_vehicle_km_projections": table(
            spark,
            "electricity_per_vehicle_km_projections",
            [(c, t, y, v) for c, y in by_year for t, v in (("bev", 180.0), ("phev", 220.0))],
        ),
        "ev_stock_share_projections": table(
            spark, "ev_stock_share_projections", [(c, y, 0.4) for c, y in by_year]
        ),
        "phev_share_projections": table(
            spark, "phev_share_projections", [(c, y, 0.25) for c, y in by_year]
        ),
        "km_per_vehicle_year_regressions": table(
            spark, "km_per_vehicle_year_regressions", regression
        ),
        "vehicle_per_capita_regressions": table(
            spark, "vehicle_per_capita_regressions", regression
        ),
    }


CONFIG = ProjectConfig(
    project_id="tiny",
    start_year=2025,
    end_year=2030,
    step_year=5,
    weather_year=2018,
    model_parameters=ModelParameters(heating_threshold=15.0, cooling_threshold=25.0),
    scenarios=(
        Scenario("baseline"),
        Scenario("rich"),
        Scenario("electric", use_ev_projection=True),
    ),
)


@pytest.fixture(scope="session")
def tiny(spark):
    return tiny_data(spark)


@pytest.fixture
def project(spark, tiny):
    rich = tiny["gdp"].withColumn("value", F.col("value") * 2)
    return Project(spark, CONFIG, tiny, {("rich", "gdp"): rich})
