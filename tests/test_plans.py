"""The shape of physical plans: what is pushed down, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kilocast.operators.weather import daily_weather
from kilocast.queries import annual, series
from kilocast.queries.scope import Scope
from kilocast.sources.files import write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weather_year_and_country_reach_the_scan(spark, tiny, tmp_path):
    path = str(tmp_path / "weather.parquet")
    write_table(tiny["weather_bait"], path)
    text = plan(daily_weather(spark.read.parquet(path), ["north"], 2018))
    pushed = re.search(r"PushedFilters: \[(.*?)\],? ReadSchema", text, re.S).group(1)
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    assert "north" in pushed
    assert text.count("Exchange hashpartitioning") == 1


def test_projection_queries_prune_partitions_and_columns(project):
    result = project.compute_energy_projection(["baseline", "rich"])
    text = plan(annual.consumption(result, Scope("north", ["rich"], [2030])))
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\],? PushedFilters", text, re.S).group(1)
    assert "rich" in partition_filters and "2030" in partition_filters
    assert "ReadSchema: struct<geography:string,value:double>" in text


def test_no_product_of_tables_anywhere(project):
    for scenario in project.list_scenario_names():
        text = plan(project.calculated_table(scenario, "energy_projection"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hours_are_neither_shuffled_nor_joined_again(project):
    """Representative rows are joined, dealt and sorted; what makes hours of them comes after all that."""
    text = plan(project.prepared_projection(files=4))
    above = text.split("Generate inline", 1)[0]
    assert not any(step in above for step in ("Union", "Exchange", "Join", "Sort"))
    assert re.search(r"Exchange hashpartitioning\(scenario#\d+, model_year#\d+L, .*REPARTITION_BY_COL", text)


def test_row_numbers_are_not_made_in_one_task_per_series(project):
    result = project.compute_energy_projection(["baseline"])
    df = series.comparison(result, Scope(None, ["baseline"]), "Sector", series.HOURLY)
    text = plan(df)
    assert "SinglePartition" not in text
    windows = re.findall(r"row_number\(\) windowspecdefinition\((.*?)\)", text)
    raw = [w for w in windows if "sector" in w]
    assert raw and all("timestamp" in w.split("sector")[0] for w in raw)


def test_wide_aggregates_have_map_side_partials(project):
    result = project.compute_energy_projection(["baseline"])
    text = plan(annual.peak(result, Scope(None)).select(F.sum("value")))
    assert "partial_sum" in text and "partial_max" in text


@pytest.fixture
def no_broadcast(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("prepared", [False, True])
def test_the_days_join_is_split_by_hours(project, no_broadcast, prepared):
    df = project.prepared_projection() if prepared else project.energy_projection()
    text = plan(df)
    assert "Broadcast" not in text
    assert re.search(r"hashpartitioning\(geography#\d+, month#\d+L, day_type#\d+, _slot", text)


def test_years_do_not_scan_hours(project):
    project.compute_energy_projection()
    text = plan(project.get_projection_keys().select("model_year").distinct())
    assert "_keys" in text and "timestamp" not in text


def test_number_of_files_is_bounded(project, tmp_path):
    project.result_path = str(tmp_path / "result")
    project.compute_energy_projection(files=3)
    for folder in (tmp_path / "result").glob("data/run=*/scenario=*/model_year=*"):
        assert 1 <= len(list(folder.glob("*.parquet"))) <= 3
    assert len(list((tmp_path / "result").glob("data/run=*/scenario=*/model_year=*"))) == 6


def test_flagship_starts_few_jobs_before_its_action(spark):
    context = spark.sparkContext
    context.setJobGroup("flagship", "flagship")
    try:
        df = contract.entry(spark)
        # Seven of them read the footers of the given tables.
        assert len(context.statusTracker().getJobIdsForGroup("flagship")) < 25
    finally:
        context._jsc.clearJobGroup()
    assert not df.isEmpty()
