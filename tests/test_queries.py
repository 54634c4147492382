import pytest

from conftest import hourly
from kilocast import ProjectionClient
from kilocast.queries import annual, duration, listing, seasonal, secondary, series, weather
from kilocast.queries.scope import Scope

HERE = Scope("here", ["baseline"], [2030])


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    """Two sectors and end uses over few hours; hour 3 and hour 5 tie for the peak."""
    data = []
    for scenario, scale in (("later", 2.0), ("baseline", 1.0)):
        for year in (2030, 2025):
            for hour, load in ((0, 3.0), (3, 9.0), (5, 9.0), (30, 1.0)):
                for sector, metric, share in (("A", "x", 0.5), ("A", "y", 0.25), ("B", "x", 0.25)):
                    value = load * share * scale * (year - 2024)
                    data.append((hour, year, scenario, sector, "here", metric, value))
    data.append((0, 2025, "baseline", "A", "there", "x", 100.0))
    return hourly(spark, data)


ORDER = Scope("here", scenario_order=["later", "baseline"])


def test_consumption_in_configuration_order(small):
    found = rows(annual.consumption(small, ORDER))
    assert found == [
        ("later", 2025, 44.0),
        ("later", 2030, 264.0),
        ("baseline", 2025, 22.0),
        ("baseline", 2030, 132.0),
    ]
    by_use = annual.consumption(small, Scope("here", ["baseline"], [2025]), "End Use")
    assert by_use.columns == ["scenario", "year", "metric", "value"]
    assert rows(by_use) == [("baseline", 2025, "x", 16.5), ("baseline", 2025, "y", 5.5)]
    with pytest.raises(ValueError):
        annual.consumption(small, ORDER, "Colour")


def test_all_places_at_once(small):
    everywhere = Scope(None, ["baseline"], [2025])
    assert rows(annual.consumption(small, everywhere)) == [
        ("here", "baseline", 2025, 22.0),
        ("there", "baseline", 2025, 100.0),
    ]
    assert rows(annual.peak(small, everywhere)) == [
        ("here", "baseline", 2025, 9.0),
        ("there", "baseline", 2025, 100.0),
    ]


def test_peak_rows_are_those_of_the_earliest_peak(spark, small):
    found = rows(annual.peak_breakdown(small, Scope("here", ["baseline"], [2025]), "Sector"))
    assert found == [
        ("baseline", 2025, "A", 4.5),
        ("baseline", 2025, "A", 2.25),
        ("baseline", 2025, "B", 2.25),
    ] or sorted(found) == sorted(
        [("baseline", 2025, "A", 4.5), ("baseline", 2025, "A", 2.25), ("baseline", 2025, "B", 2.25)]
    )
    tied = hourly(
        spark,
        [
            (5, 2030, "baseline", "late", "here", "x", 4.0),
            (3, 2030, "baseline", "early", "here", "x", 4.0),
            (1, 2030, "baseline", "unknown", "here", "x", None),
        ],
    )
    assert rows(annual.peak_breakdown(tied, HERE, "Sector")) == [("baseline", 2030, "early", 4.0)]


def test_summary_and_growth(small):
    summary = {(r.scenario, r.year): r for r in annual.summary(small, ORDER).collect()}
    assert summary["baseline", 2030].percent_growth == pytest.approx(500.0)
    assert summary["baseline", 2025].percent_growth == 0
    assert summary["later", 2030].peak_demand == 108.0
    growth = {(r.scenario, r.year): r for r in annual.growth_indicators(small, ORDER).collect()}
    assert growth["baseline", 2025].consumption_cagr is None
    assert growth["baseline", 2030].consumption_cagr == pytest.approx((6 ** (1 / 5) - 1) * 100)
    assert growth["baseline", 2030].peak_cagr == pytest.approx((6 ** (1 / 5) - 1) * 100)
    back = annual.growth_indicators(small, ORDER, start_year=2030).collect()
    rates = {(r.scenario, r.year): r.peak_cagr for r in back}
    assert rates["later", 2030] is None and rates["later", 2025] == pytest.approx(
        ((1 / 6) ** (1 / -5) - 1) * 100
    )


def test_no_growth_from_nothing(spark):
    df = hourly(
        spark,
        [(0, 2025, "baseline", "A", "here", "x", 0.0), (0, 2030, "baseline", "A", "here", "x", 5.0)],
    )
    assert [r.percent_growth for r in annual.summary(df, ORDER).collect()] == [None, None]
    assert [r.peak_cagr for r in annual.growth_indicators(df, ORDER).collect()] == [None, None]


def test_difference_needs_both_scenarios(spark, small):
    only = hourly(spark, [(0, 2040, "later", "A", "here", "x", 1.0)])
    found = rows(annual.difference(small.unionByName(only), Scope("here"), "baseline", "later"))
    assert found == [(2025, 22.0, 44.0, 22.0, 100.0), (2030, 132.0, 264.0, 132.0, 100.0)]


def test_stacked_maximum(small):
    assert rows(annual.stacked_maximum(small, ORDER, "Sector")) == [(297.0,)]


def test_duration_pads_shorter_series(spark, small):
    extra = hourly(spark, [(99, 2025, "later", "A", "here", "x", 4.0)])
    df = duration.load_duration(
        small.unionByName(extra), Scope("here", None, [2025]), "scenario", ["later", "baseline"]
    )
    assert df.columns == ["rank", "later", "baseline"]
    assert rows(df) == [
        (0, 18.0, 9.0),
        (1, 18.0, 9.0),
        (2, 6.0, 3.0),
        (3, 4.0, 1.0),
        (4, 2.0, None),
    ]
    by_place = duration.load_duration(
        small, Scope(None, ["baseline"], [2025]), "year", [2025, 2030]
    )
    assert [r for r in rows(by_place) if r[0] == "there"] == [("there", 0, 100.0, None)]


def test_row_numbers_match_brute_force(spark, small):
    twice = small.unionByName(small.filter("sector = 'A'"))
    df = series.comparison(twice, Scope("here", ["baseline"]), "Sector", series.HOURLY)
    expected = []
    data = twice.filter("geography = 'here' and scenario = 'baseline'").collect()
    for year in (2025, 2030):
        ordered = sorted(
            (r for r in data if r.model_year == year),
            key=lambda r: (r.timestamp, r.sector, r.metric, r.value),
        )
        expected += [
            ("baseline", year, n, r.sector, r.value) for n, r in enumerate(ordered, start=1)
        ]
    assert rows(df) == expected
    hours = series.comparison(
        twice, Scope("here", ["baseline"], [2025]), "Sector", series.HOURLY, hour_of_year=True
    )
    assert {r[2] for r in rows(hours)} == {1, 2, 3, 4} and hours.count() == 20


def test_resampled_periods(small):
    scope = Scope("here", ["baseline"], [2025])
    daily = rows(series.comparison(small, scope))
    assert daily == [("baseline", 2025, 2, 21 / 9), ("baseline", 2025, 3, 1 / 3)]
    assert rows(series.comparison(small, scope, None, series.WEEKLY_MEAN)) == [
        ("baseline", 2025, 1, 22 / 12)
    ]
    assert [r[2:] for r in rows(series.comparison(small, scope, None, series.HOURLY))] == [
        (1, 3.0),
        (2, 9.0),
        (3, 9.0),
        (4, 1.0),
    ]
    totals = rows(series.comparison(small, scope, totals_first=True))
    assert totals == [("baseline", 2025, 2, 7.0), ("baseline", 2025, 3, 1.0)]
    with pytest.raises(ValueError):
        series.comparison(small, scope, None, "Monthly")


@pytest.mark.parametrize("agg", list(seasonal.AGGREGATES))
def test_weekdays_and_weekends(week_load, agg):
    df = seasonal.profile(week_load, HERE, "Weekday/Weekend", agg)
    found = {(r.day_type, r.hour_of_day): r.value for r in df.collect()}
    assert len(found) == 48
    assert {v for (kind, _), v in found.items() if kind == "Weekday"} == {4.0}
    assert {v for (kind, _), v in found.items() if kind == "Weekend"} == {32.0}


def test_seasons_and_breakdown(week_load):
    df = seasonal.profile(
        week_load, HERE, "Seasonal and Weekday/Weekend", "Peak Day", "End Use"
    )
    assert df.count() == 4 * 2 * 24 * 2
    assert {r.season for r in df.collect()} == {"Winter", "Spring", "Summer", "Fall"}
    mean = seasonal.profile(week_load, HERE, "Seasonal", "Average Day").collect()
    spring_days = 151 - 79
    spring = next(r.value for r in mean if r.season == "Spring" and r.hour_of_day == 0)
    weekend = week_load.filter(
        "scenario = 'baseline' and metric = 'other' and sector = 'Commercial' and hour(timestamp) = 0"
        " and dayofyear(timestamp) >= 79 and dayofyear(timestamp) < 151 and value = 8"
    ).count()
    assert spring == pytest.approx(4 * (spring_days + 7 * weekend) / spring_days)
    with pytest.raises(ValueError):
        seasonal.profile(week_load, HERE, "Monthly", "Peak Day")


def test_listing(small):
    assert rows(listing.unique_values(small, "metric", "here")) == [("x",), ("y",)]
    ordered = listing.scenarios_in_order(small, ["later", "none", "baseline"], "here")
    assert rows(ordered) == [("later", 0), ("baseline", 2)]
    assert listing.matching_id(small, "geography", "HERE") == "here"
    with pytest.raises(ValueError):
        listing.matching_id(small, "geography", "nowhere")


def test_weather_series_and_overlay(project):
    days = project.calculated_table("baseline", "weather_degree_days")
    stored = weather.weather_series(days, "HDD", series.HOURLY, "north")
    assert stored.columns == ["datetime", "value"] and stored.count() == 365
    weekly = weather.weather_series(days, "BAIT", series.WEEKLY_MEAN, "north").collect()
    assert len(weekly) == 53 and weekly[1].datetime.day == 8
    overlay = weather.weather_overlay(days, "BAIT", series.HOURLY, "north").collect()
    assert [r.time_period for r in overlay] == list(range(1, 8761))
    assert len({r.value for r in overlay[:24]}) == 1
    with pytest.raises(ValueError):
        weather.weather_series(days, "Rain", series.HOURLY)
    with pytest.raises(ValueError):
        weather.weather_series(days, "BAIT", "Monthly Mean")


def test_secondary_metrics(spark, project):
    table = project.catalog.scenario("rich").table
    assert rows(secondary.secondary_metric(table, "GDP", [2025], "north")) == [(2025, 110.0)]
    head = rows(secondary.secondary_metric(table, "GDP Per Capita", None, "north"))
    assert head == [(2025, 110.0 * 1e9 / 1e6), (2030, 120.0 * 1e9 / 1e6)]
    with pytest.raises(NotImplementedError):
        secondary.secondary_metric(table, "Rain")

    def missing(name):
        raise ValueError(name)

    both = secondary.secondary_of_scenarios({"rich": table, "gone": missing}, "GDP", [2030])
    assert {r.scenario for r in both.collect()} == {"rich"}
    with pytest.raises(ValueError):
        secondary.secondary_of_scenarios({"gone": missing}, "GDP")


@pytest.fixture(scope="module")
def client(spark, tiny):
    from conftest import CONFIG
    from kilocast import Project

    project = Project(spark, CONFIG.with_countries("north"), tiny)
    project.compute_energy_projection()
    return ProjectionClient(project)


def test_client_answers(client):
    assert client.geography == "north"
    assert client.get_years() == [2025, 2030]
    assert client.scenarios == ["baseline", "rich", "electric"]
    assert client.get_unique_sectors() == [
        "Commercial",
        "Industrial",
        "Residential",
        "Transportation",
    ]
    assert client.get_unique_end_uses() == ["cooling", "heating", "lighting"]
    assert client.get_annual_electricity_consumption(group_by="Sector").count() == 24
    peaks = client.get_annual_peak_demand(["rich"], [2030])
    summary = client.get_scenario_summary("rich", 2030)
    assert summary["PEAK_DEMAND"] == pytest.approx(peaks.first().value)
    assert summary["PERCENT_GROWTH"] > 0 and summary["TOTAL_CONSUMPTION"] > 0
    assert client.get_annual_peak_demand(["rich"], [2030], "End Use").count() == 12
    assert client.get_load_duration_curve().columns == ["rank", "baseline", "rich", "electric"]
    assert client.get_load_duration_curve([2025, 2030], ["rich"]).columns == ["rank", "2025", "2030"]
    assert client.get_time_series_comparison("rich", 2030).count() == 365
    assert client.get_seasonal_load_lines("rich").count() == 2 * 4 * 4
    assert client.get_seasonal_load_area("rich", 2030, breakdown="Sector").count() == 64
    assert client.get_secondary_metric("rich", "Population").count() == 2
    both = client.get_secondary_metric_of_scenarios(["baseline", "rich"], "GDP")
    assert both.count() == 4
    assert client.get_weather_metric("rich", 2030, "CDD", series.DAILY_MEAN).count() == 365
    assert client.get_weather_overlay("rich", "CDD", series.HOURLY).count() == 8760
    assert client.get_scenario_difference("baseline", "rich").count() == 2
    assert client.get_growth_indicators("rich").count() == 2
    client.refresh_metadata()
    assert client.years == [2025, 2030]


def test_client_checks_names(client):
    for call in (
        lambda: client.get_annual_electricity_consumption(["nobody"]),
        lambda: client.get_annual_peak_demand(years=[1999]),
        lambda: client.get_load_duration_curve([2025, 2030], ["baseline", "rich"]),
        lambda: client.get_weather_metric("rich", 2030, "Rain", series.HOURLY),
        lambda: client.get_time_series_comparison("rich", 2030, resample="Monthly"),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(NotImplementedError):
        client.get_secondary_metric("rich", "Rain")
