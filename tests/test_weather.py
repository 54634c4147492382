import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import table
from kilocast import ModelParameters
from kilocast.operators import weather

PLAIN = ModelParameters(enable_shoulder_month_smoothing=False)


def days(spark, temperatures, parameters=ModelParameters()):
    start = dt.datetime(2018, 1, 1)
    rows = [
        ("here", start + dt.timedelta(days=d), "BAIT", t) for d, t in enumerate(temperatures)
    ]
    daily = weather.daily_weather(table(spark, "weather_bait", rows), None, 2018)
    return weather.degree_days(daily, parameters)


def test_wide_rows_keep_other_metrics_and_the_year_only(spark):
    rows = [
        ("here", dt.datetime(2018, 12, 31), "BAIT", 1.0),
        ("here", dt.datetime(2018, 12, 31), "Wind_Speed", 2.0),
        ("here", dt.datetime(2019, 1, 1), "BAIT", 3.0),
        ("there", dt.datetime(2018, 12, 31), "BAIT", 4.0),
    ]
    df = weather.daily_weather(table(spark, "weather_bait", rows), ["here"], 2018)
    (row,) = df.collect()
    assert (row.bait, row.wind_speed, row.humidity) == (1.0, 2.0, None)
    assert (row.weather_year, row.month, row.day, row.day_type) == (2018, 12, 31, "weekday")


def test_only_saturday_is_weekend(spark):
    kinds = {r.day: r.day_type for r in days(spark, [10.0] * 14).collect()}
    assert [d for d, kind in kinds.items() if kind == "weekend"] == [6, 13]


def test_missing_temperature_has_no_degree_days(spark):
    (row,) = days(spark, [None]).collect()
    assert (row.hdd, row.cdd) == (0.0, 0.0)


@pytest.mark.parametrize("parameters", [ModelParameters(), PLAIN])
def test_multipliers_of_a_group_add_up_to_its_days(spark, parameters):
    temperatures = [18 + 14 * ((d * 7) % 11 - 5) / 5 for d in range(365)]
    m = weather.temperature_multipliers(days(spark, temperatures), parameters)
    sums = m.groupBy(*weather.GROUP_KEYS).agg(
        F.sum("heating_multiplier").alias("heat"),
        F.sum("cooling_multiplier").alias("cool"),
        F.first("num_days").alias("n"),
    )
    for row in sums.collect():
        assert row.heat == pytest.approx(row.n, rel=1e-9)
        assert row.cool == pytest.approx(row.n, rel=1e-9)


def test_smoothing_raises_days_below_a_tenth_of_the_maximum(spark):
    d = days(spark, [8.0, 18.0, 17.5, 13.0])
    rows = {r.day: r for r in weather.smoothed_degree_days(d, ModelParameters()).collect()}
    assert [rows[k].adjusted_hdd for k in (1, 2, 3, 4)] == [10.0, 1.0, 1.0, 5.0]
    plain = {r.day: r for r in weather.smoothed_degree_days(d, PLAIN).collect()}
    assert [plain[k].adjusted_hdd for k in (1, 2, 3, 4)] == [10.0, 0.0, 0.5, 5.0]


def test_smoothing_leaves_pure_winter_alone(spark):
    d = days(spark, [9.0 - k % 5 for k in range(31)])
    smooth = weather.temperature_multipliers(d, ModelParameters()).orderBy("day").collect()
    plain = weather.temperature_multipliers(d, PLAIN).orderBy("day").collect()
    assert smooth == plain
    assert {r.cooling_multiplier for r in smooth} == {1.0}


def test_supplied_group_totals_replace_the_computed_ones(spark):
    d = days(spark, [8.0, 13.0])
    grouped = weather.grouped_degree_days(d).withColumn("num_days", F.lit(20).cast("long"))
    m = weather.temperature_multipliers(d, PLAIN, grouped)
    assert m.agg(F.sum("heating_multiplier")).first()[0] == pytest.approx(20.0)


def test_multiplier_range(spark):
    m = weather.temperature_multipliers(days(spark, [8.0, 13.0]), PLAIN)
    row = weather.multiplier_range(m).first()
    assert row.max_heating == pytest.approx(2 * 10 / 15)
    assert (row.min_other, row.max_other, row.min_cooling) == (1.0, 1.0, 1.0)
