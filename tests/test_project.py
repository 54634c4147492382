import pytest
from pyspark.sql import functions as F

from conftest import CONFIG, YEARS
from kilocast import Project, ProjectConfig, ProjectionClient, Scenario, TableOverride
from kilocast.errors import InvalidOperation, InvalidParameter
from kilocast.plans import storage
from kilocast.plans.models import MODELS
from kilocast.plans.tables import share_expansion
from kilocast.schemas import PROJECTION
from kilocast.sources.files import write_table

RES = "energy_projection_res_load_shapes"
ANNUAL_RES = "energy_intensity_res_hdi_population_applied_regression"


def total(df, sector=None, scenario="baseline"):
    rows = df.filter(F.col("scenario") == scenario)
    if sector:
        rows = rows.filter(F.col("sector") == sector)
    return rows.agg(F.sum("value")).first()[0]


def test_configuration_is_checked():
    with pytest.raises(InvalidParameter):
        Scenario("default")
    with pytest.raises(InvalidParameter):
        Scenario("s", tables={"unknown": "x.csv"})
    with pytest.raises(InvalidParameter):
        ProjectConfig("p", 2025, 2030, 2018, scenarios=(Scenario("a"), Scenario("a")))
    assert CONFIG.list_model_years() == YEARS


def test_every_calculated_table_builds(project):
    for name in MODELS:
        assert not project.calculated_table("electric", name).isEmpty(), name


def test_scenarios_fall_back_to_the_baseline(project):
    hdi = [project.data_table(s, "hdi") for s in ("baseline", "rich")]
    assert hdi[0] is hdi[1]
    gdp = [project.calculated_table(s, "gdp_country").agg(F.sum("value")).first()[0] for s in ("baseline", "rich")]
    assert gdp[1] == 2 * gdp[0]
    shared = [project.calculated_table(s, "temperature_multipliers") for s in ("baseline", "rich")]
    assert shared[0] is shared[1]


def test_one_expansion_gives_what_each_scenario_gives(project):
    fused = project.energy_projection()
    assert share_expansion(project.catalog, ["baseline", "rich", "electric"]) == [
        ["baseline", "rich", "electric"]
    ]
    assert fused.columns == PROJECTION.fieldNames()
    for name in project.list_scenario_names():
        alone = project.calculated_table(name, "energy_projection")
        ours = fused.filter(F.col("scenario") == name)
        both = ours.withColumnRenamed("value", "v").join(
            alone, ["scenario", "model_year", "geography", "sector", "metric", "timestamp"]
        )
        assert both.count() == alone.count() == ours.count() > 0
        assert both.filter(F.abs(F.col("v") / F.col("value") - 1) > 1e-12).isEmpty()
    assert total(fused, "Industrial", "rich") == pytest.approx(2 * total(fused, "Industrial"))
    assert total(fused, "Residential", "rich") == pytest.approx(total(fused, "Residential"))


def test_multiplier_statistics(project):
    row = project.multiplier_statistics("rich").first()
    assert row.min_other == row.max_other == 1.0
    assert 0 < row.min_heating < 1 < row.max_heating


def test_valid_ids(project):
    assert project.list_valid_model_years() == YEARS
    assert project.list_valid_weather_years() == [2018]
    assert project.list_valid_countries() == ["north", "south"]
    assert project.validate_country("SOUTH") == "south"
    with pytest.raises(InvalidParameter):
        project.validate_country("west")


def test_unknown_names(project):
    with pytest.raises(InvalidParameter):
        project.data_table("nobody", "gdp")
    with pytest.raises(InvalidParameter):
        project.calculated_table("baseline", "nothing")
    with pytest.raises(InvalidParameter):
        project.calculated_table("baseline", f"{RES}_override")
    with pytest.raises(InvalidOperation):
        project.get_energy_projection()


def test_override_round_trip(project, tmp_path):
    before = total(project.energy_projection(), "Residential")
    assert before > 0
    path = str(tmp_path / "res.csv")
    project.export_calculated_table("baseline", RES, path)
    with pytest.raises(Exception, match="(?i)exist"):
        project.export_calculated_table("baseline", RES, path)
    changed = str(tmp_path / "changed.csv")
    table = project.spark.read.csv(path, header=True, inferSchema=True)
    write_table(table.withColumn("value", F.col("value") * 3), changed)

    project.override_calculated_tables([TableOverride("baseline", RES, changed)])
    assert project.get_table_overrides() == {"baseline": [RES]}
    assert f"{RES}_override" in project.list_calculated_tables()
    after = project.energy_projection()
    assert total(after, "Residential") == pytest.approx(3 * before)
    assert total(after, "Residential", "rich") == pytest.approx(before)
    assert total(after, "Industrial") > 0

    project.remove_calculated_table_overrides([TableOverride("baseline", f"{RES}_override")])
    assert project.get_table_overrides() == {}
    assert total(project.energy_projection(), "Residential") == pytest.approx(before)


def test_override_errors(project, tiny, tmp_path):
    path = str(tmp_path / "gdp.parquet")
    write_table(tiny["gdp"], path)

    def ask(scenario, table, file=path):
        project.override_calculated_tables([TableOverride(scenario, table, file)])

    with pytest.raises(InvalidParameter):
        ask("baseline", "gdp_country", None)
    with pytest.raises(InvalidOperation):
        ask("baseline", "gdp_country_override")
    with pytest.raises(InvalidParameter):
        ask("nobody", "gdp_country")
    with pytest.raises(InvalidParameter):
        ask("baseline", "nothing")
    with pytest.raises(InvalidParameter, match="wanted are"):
        ask("baseline", ANNUAL_RES)
    wrong = str(tmp_path / "wrong.parquet")
    write_table(tiny["gdp"].withColumn("model_year", F.col("model_year").cast("int")), wrong)
    with pytest.raises(InvalidParameter, match="should be"):
        ask("baseline", "gdp_country", wrong)
    assert project.get_table_overrides() == {}

    ask("baseline", "gdp_country")
    item = TableOverride("baseline", "gdp_country")
    with pytest.raises(InvalidOperation):
        project.remove_calculated_table_overrides(
            [item, TableOverride("baseline", "gdp_country_override")]
        )
    with pytest.raises(InvalidParameter):
        project.remove_calculated_table_overrides([TableOverride("rich", "gdp_country")])
    with pytest.raises(InvalidParameter):
        project.remove_calculated_table_overrides(
            [TableOverride("baseline", "x_override_override")]
        )
    project.remove_calculated_table_overrides([item])


def _doubled_heat(project):
    m = project.calculated_table("baseline", "temperature_multipliers")
    return m.withColumn("heating_multiplier", F.col("heating_multiplier") * 2)


def test_weather_overrides_reach_the_projection_unless_strict(spark, tiny, project):
    def heat(p):
        rows = p.energy_projection(["baseline"]).filter("metric = 'heating'")
        return rows.agg(F.sum("value")).first()[0]

    before = heat(project)
    project.override_with("baseline", "temperature_multipliers", _doubled_heat(project))
    assert heat(project) > 1.2 * before
    strict = Project(spark, CONFIG, tiny, strict=True)
    strict.override_with("baseline", "temperature_multipliers", _doubled_heat(strict))
    assert heat(strict) == pytest.approx(before)


def test_expanded_shapes_can_be_overridden(project):
    before = total(project.energy_projection(["baseline"]))
    hourly = project.calculated_table("baseline", "load_shapes_expanded")
    project.override_with(
        "baseline",
        "load_shapes_expanded",
        hourly.filter("month(timestamp) = 1"),
    )
    after = project.energy_projection(["baseline"])
    assert after.filter("month(timestamp) <> 1").isEmpty()
    assert total(after) == pytest.approx(before)


def test_written_projection_and_partial_recomputation(project):
    written = project.compute_energy_projection()
    assert written.columns == PROJECTION.fieldNames()
    planned = project.energy_projection()
    assert written.count() == planned.count()
    assert total(written) == pytest.approx(total(planned))
    base, rich = total(written), total(written, scenario="rich")
    table = project.calculated_table("rich", ANNUAL_RES)
    project.override_with("rich", ANNUAL_RES, table.withColumn("value", F.lit(0.0)))
    again = project.compute_energy_projection(["rich"])
    assert total(again) == pytest.approx(base)
    assert total(again, "Residential", "rich") == 0 and total(again, scenario="rich") < rich
    one = project.get_energy_projection("electric")
    assert [r[0] for r in one.select("scenario").distinct().collect()] == ["electric"]


def test_multipliers_are_stored_once(project, monkeypatch):
    from kilocast.plans import project as module

    stored = []

    def pin(df, path):
        stored.append(df.columns)
        return storage.pin(df, path)

    monkeypatch.setattr(module, "pin", pin)
    project.prepared_projection(["baseline"])
    project.prepared_projection()
    assert len(stored) == 1 and "heating_multiplier" in stored[0]
    [path] = project._stored_paths
    project.close()
    with pytest.raises(Exception, match="(?i)not.*exist"):
        project.spark.read.parquet(path)
    assert not project.prepared_projection(["baseline"]).isEmpty()


def test_one_client_lives_through_overrides_and_recomputation(project):
    project.compute_energy_projection()
    client = ProjectionClient(project, geography="north")

    def residential():
        rows = client.get_annual_electricity_consumption(["rich"], group_by="Sector")
        return rows.filter("sector = 'Residential'").agg(F.sum("value")).first()[0]

    before = residential()
    table = project.calculated_table("rich", ANNUAL_RES)
    project.override_with("rich", ANNUAL_RES, table.withColumn("value", F.col("value") * 3))
    assert residential() == pytest.approx(3 * before)
    project.compute_energy_projection()
    assert residential() == pytest.approx(3 * before)
    project.remove_calculated_table_overrides([TableOverride("rich", ANNUAL_RES)])
    assert residential() == pytest.approx(before)
    client.refresh_metadata()
    assert client.years == YEARS


def test_a_recomputed_scenario_keeps_no_old_years(project):
    project.compute_energy_projection()
    for name in (ANNUAL_RES, "energy_intensity_com_ind_tra_gdp_applied_regression"):
        table = project.calculated_table("rich", name)
        project.override_with("rich", name, table.filter("model_year = 2025"))
    left = project.get_energy_projection("rich").select("model_year").distinct().collect()
    assert [r[0] for r in left] == [2025]
    client = ProjectionClient(project, geography="north")
    assert client.years == YEARS
    with pytest.raises(ValueError, match="2030"):
        client.get_scenario_summary("rich", 2030)


def test_export_of_the_projection(project, tmp_path):
    project.compute_energy_projection(["baseline"])
    path = str(tmp_path / "out.parquet")
    project.export_energy_projection(path)
    assert project.spark.read.parquet(path).count() == project.get_energy_projection().count()


def test_empty_scenario_is_an_error(spark, tiny):
    data = dict(tiny, load_shapes=tiny["load_shapes"].limit(0))
    project = Project(spark, CONFIG, data)
    with pytest.raises(InvalidParameter, match="no hourly"):
        project.compute_energy_projection()
    assert project.result_path is None


def test_show_filters_data_tables_only(spark, tiny):
    config = CONFIG.with_countries("north")
    project = Project(spark, config, tiny)
    shown = project.show_data_table("baseline", "gdp", 100)
    assert {r.geography for r in shown.collect()} == {"north"}
    assert project.show_calculated_table("baseline", "gdp_country", 1).count() == 1
    extra = tiny["gdp"].withColumn("weather_year", F.lit(1999).cast("long"))
    project.catalog._data["baseline", "gdp"] = extra
    assert project.show_data_table("baseline", "gdp").isEmpty()


def test_projects_from_files_map_dimensions(spark, tiny, tmp_path):
    files = {}
    for name, df in tiny.items():
        files[name] = str(tmp_path / f"{name}.parquet")
        write_table(df, files[name])
    split = tiny["gdp"].withColumn("value", F.col("value") / 2)
    halves = split.withColumn("geography", F.concat("geography", F.lit("_1"))).unionByName(
        split.withColumn("geography", F.concat("geography", F.lit("_2")))
    )
    text = halves.withColumn("model_year", F.col("model_year").cast("string"))
    write_table(text, files["gdp"], overwrite=True)
    pairs = spark.createDataFrame(
        [(f"{c}_{k}", c) for c in ("north", "south") for k in (1, 2)], "from_id string, to_id string"
    )
    write_table(pairs, str(tmp_path / "map.csv"))
    high = str(tmp_path / "high.csv")
    write_table(halves.withColumn("value", F.lit(1.0)), high)
    config = ProjectConfig(
        "files", 2025, 2030, 2018, 5, scenarios=(Scenario("baseline"), Scenario("low", tables={"gdp": high}))
    )
    project = Project.from_files(
        spark,
        config,
        files,
        {"gdp": [("geography", str(tmp_path / "map.csv"), "many_to_one_aggregation")]},
    )
    assert sorted(project.data_table("baseline", "gdp").collect()) == sorted(tiny["gdp"].collect())
    assert {r.value for r in project.data_table("low", "gdp").collect()} == {2.0}


def _files(tiny, folder, **changed):
    files = {}
    for name, df in (tiny | changed).items():
        files[name] = str(folder / f"{name}.parquet")
        write_table(df, files[name])
    return files


def _config(**more):
    return ProjectConfig("files", 2025, 2030, 2018, 5, **more)


def test_creation_checks_the_time(spark, tiny, tmp_path):
    gap = tiny["weather_bait"].filter("month(timestamp) <> 6")
    files = _files(tiny, tmp_path, weather_bait=gap)
    with pytest.raises(InvalidParameter, match="weather of 2018"):
        Project.from_files(spark, _config(), files)
    Project.from_files(spark, _config(), files, check_time=False)


def test_creation_checks_types_countries_and_associations(spark, tiny, tmp_path):
    files = _files(tiny, tmp_path)
    wrong = str(tmp_path / "text.parquet")
    write_table(tiny["gdp"].withColumn("value", F.col("value").cast("string")), wrong)
    with pytest.raises(InvalidParameter, match="value should be double"):
        Project.from_files(spark, _config(scenarios=(Scenario("baseline"), Scenario("s", tables={"gdp": wrong}))), files)
    project = Project.from_files(spark, _config(countries=("NORTH",)), files)
    assert project.config.countries == ("north",)
    assert {r[0] for r in project.calculated_table("baseline", "gdp_country").select("geography").collect()} == {"north"}
    with pytest.raises(InvalidParameter):
        Project.from_files(spark, _config(countries=("west",)), files)
    sectors = {"energy_intensity": {"sector": ["Commercial", "Industrial", "Residential", "Transportation"]}}
    with pytest.raises(InvalidParameter, match="south.*Commercial"):
        Project.from_files(spark, _config(), files, associations=sectors)


def test_creation_applies_overrides_and_checks_mappings(spark, tiny, tmp_path):
    files = _files(tiny, tmp_path)
    path = str(tmp_path / "gdp_country.parquet")
    write_table(tiny["gdp"].withColumn("value", F.lit(7.0)), path)
    item = TableOverride("baseline", "gdp_country", path)
    project = Project.from_files(spark, _config(calculated_table_overrides=(item,)), files)
    assert {r.value for r in project.calculated_table("baseline", "gdp_country").collect()} == {7.0}
    for rows, problem in (
        ([("north", "n"), ("south", "s"), ("west", "w")], "not in the table"),
        ([("north", "n")], "without a target"),
        ([("north", "n"), ("north", "n"), ("south", "s")], "listed twice"),
        ([("north", "n"), ("north", "m"), ("south", "s")], "several targets"),
    ):
        write_table(spark.createDataFrame(rows, "from_id string, to_id string"), str(tmp_path / "map.csv"), True)
        with pytest.raises(InvalidParameter, match=problem):
            Project.from_files(
                spark, _config(), files, {"gdp": [("geography", str(tmp_path / "map.csv"), "one_to_one")]}
            )
