import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import table
from kilocast.functions.regression import evaluate, pivot_coefficients, split_key
from kilocast.operators import projection, shapes, vehicles

ANNUAL = "geography string, model_year long, sector string, subsector string, value double"


def test_keys_split_and_pivot(spark):
    df = spark.createDataFrame(
        [
            ("x", "Commercial", "All", "nonres_a0_exp", 1.0),
            ("x", "Commercial", "All", "nonres_a0_exp", 2.0),
            ("x", "Commercial", "All", "nonres_t0_exp", 2020.0),
            ("x", "Commercial", "All", "nonres_r2_exp", 9.0),
            ("x", "Commercial", "All", "bad", 7.0),
        ],
        "geography string, sector string, subsector string, metric string, value double",
    )
    rows = {r.regression_type: r for r in pivot_coefficients(split_key(df, 2)).collect()}
    assert (rows["exp"].a0, rows["exp"].a1, rows["exp"].t0) == (3.0, None, 2020.0)
    assert (rows[""].a0, rows[""].a1, rows[""].t0) == (None, None, None)


def test_regression_forms(spark):
    df = spark.createDataFrame(
        [("exp",), ("lin",), ("log",), (None,)], "regression_type string"
    ).selectExpr("*", "0.5D a0", "0.1D a1", "2020D t0", "2030L model_year", "3D f")
    values = {r[0]: r[1] for r in df.select("regression_type", evaluate([F.col("f")])).collect()}
    assert values["exp"] == pytest.approx(3 * 2.718281828459045**1.5)
    assert values["lin"] == pytest.approx(4.5)
    assert values["log"] is None and values[None] is None


def test_vehicle_energy_counts_both_types(spark):
    stock = spark.createDataFrame(
        [("x", 2030, 75.0, 25.0)], "geography string, model_year long, bev_stock double, phev_stock double"
    )
    km = spark.createDataFrame(
        [("x", 2030, 1e4)], "geography string, model_year long, km_per_vehicle_year double"
    )
    use = spark.createDataFrame(
        [("x", "bev", 2030, 180.0), ("x", "phev", 2030, 220.0), ("x", "truck", 2030, 900.0)],
        "geography string, subsector string, model_year long, wh_per_km double",
    )
    energy = vehicles.energy_by_type(stock, km, use)
    assert {r.ev_type: r.wh_per_year for r in energy.collect()} == {
        "bev": 75 * 1e4 * 180.0,
        "phev": 25 * 1e4 * 220.0,
    }
    (row,) = vehicles.annual_vehicle_energy(energy).collect()
    assert (row.sector, row.subsector) == ("Transportation", "Road")
    assert row.value == pytest.approx((75 * 180 + 25 * 220) * 1e4 / 277777777.778)


def test_road_replacement_drops_unknown_subsectors(spark):
    annual = spark.createDataFrame(
        [
            ("x", 2030, "Transportation", "Road", 1.0),
            ("x", 2030, "Transportation", "Rail", 2.0),
            ("x", 2030, "Transportation", None, 4.0),
            ("x", 2030, "Industrial", None, 8.0),
        ],
        ANNUAL,
    )
    ev = spark.createDataFrame([("x", 2030, "Transportation", "Road", 16.0)], ANNUAL)
    out = projection.replace_road_energy(projection.annual_mwh(annual), ev)
    total = out.agg(F.sum("annual_mwh")).first()[0]
    assert total == pytest.approx((2 + 8 + 16) * projection.MWH_PER_TJ)


def test_shapes_recode_and_day_types(spark):
    rows = [
        ("x", 2030, 1, 0, None, "Industry", "heating", 1.0),
        ("x", 2030, 1, 0, True, "Fishing", "Heating", 1.0),
        ("x", 2030, 1, 0, False, "Service", None, 1.0),
        ("x", 2031, 1, 0, False, "Service", "cooling", 1.0),
        ("y", 2030, 1, 0, False, "Transport", "cooling", 1.0),
    ]
    base = shapes.base_shapes(table(spark, "load_shapes", rows), ["x"], [2030])
    found = {(r.sector, r.enduse, r.day_type) for r in base.collect()}
    assert found == {
        ("Industrial", "heating", "weekend"),
        ("Fishing", "Heating", "weekday"),
        ("Commercial", None, "weekend"),
    }
    kinds = {(r.enduse, r.multiplier_type) for r in shapes.enduse_kinds(base).collect()}
    assert kinds == {("heating", "heating"), ("Heating", "other")}


def _parts(project):
    tables = project.catalog.scenario("baseline")
    return tables.base_shapes(), tables.weather("temperature_multipliers")


def test_totals_need_no_expansion(project):
    base, multipliers = _parts(project)
    key = ("geography", "model_year", "sector")
    quick = {r[:3]: r[3] for r in shapes.annual_totals(base, multipliers).collect()}
    hourly = shapes.adjust(shapes.expand(base, multipliers))
    slow = {
        r[:3]: r[3]
        for r in shapes.expanded_totals(hourly).select(*key, "load_shape_annual_total").collect()
    }
    assert quick.keys() == slow.keys() and len(quick) == 20
    for k, value in quick.items():
        assert value == pytest.approx(slow[k], rel=1e-12)


def test_spread_keys_give_the_same_hours(project):
    base, multipliers = _parts(project)
    plain = shapes.expand(base, multipliers, spread=1)
    spread = shapes.expand(base, multipliers, spread=7)
    assert plain.count() == spread.count() == plain.intersectAll(spread).count()


def test_hours_outside_a_day_fall_on_its_neighbours(project):
    base, multipliers = _parts(project)
    hours = [-1, 0, 23, 24, 30]
    shape = base.filter("geography = 'north' and month = 3 and day_type = 'weekday'").limit(1)
    odd = shape.withColumn("hour", F.explode(F.lit(hours).cast("array<bigint>")))
    found = sorted(r.timestamp for r in shapes.expand(odd, multipliers).collect())
    days = multipliers.filter("geography = 'north' and month = 3 and day_type = 'weekday'")
    expected = [
        r.timestamp + dt.timedelta(hours=h) for r in days.select("timestamp").collect() for h in hours
    ]
    assert found == sorted(expected) and len(found) == 5 * 26


def test_factor_is_one_without_shape_energy(spark):
    totals = spark.createDataFrame(
        [("x", 2030, "Industrial", 0.0), ("x", 2030, "Commercial", None), ("x", 2030, "Residential", 4.0)],
        "geography string, model_year long, sector string, load_shape_annual_total double",
    )
    annual = spark.createDataFrame(
        [("x", 2030, s, p, 6.0) for s in ("Industrial", "Commercial", "Residential") for p in "ab"],
        ANNUAL.replace("value", "annual_mwh"),
    )
    factors = {r.sector: r.scaling_factor for r in projection.scaling_factors(totals, annual).collect()}
    assert factors == {"Industrial": 1.0, "Commercial": 1.0, "Residential": 3.0}


def test_hours_add_up_to_annual_energy(project):
    p = project.energy_projection()
    hours = p.groupBy("scenario", "geography", "model_year", "sector").agg(F.sum("value").alias("v"))
    found = {tuple(r[:4]): r.v for r in hours.collect()}
    expected = {}
    for scenario in ("baseline", "rich", "electric"):
        for r in project.catalog.scenario(scenario).annual_all().collect():
            k = (scenario, r.geography, r.model_year, r.sector)
            expected[k] = expected.get(k, 0) + r.annual_mwh
    assert found.keys() == expected.keys()
    assert ("baseline", "south", 2025, "Commercial") not in found
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, rel=1e-10) and v > 0
