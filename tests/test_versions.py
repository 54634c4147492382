"""Versions of the stored result: failures, pinned readers, taken-over years, stored sums."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import CONFIG, YEARS
from kilocast import Project, ProjectionClient, TableOverride
from kilocast.errors import InvalidOperation, InvalidParameter
from kilocast.plans import project as module
from kilocast.plans import versions
from kilocast.plans.versions import VersionStore
from kilocast.queries import series

ANNUAL_RES = "energy_intensity_res_hdi_population_applied_regression"


def total(df, *conditions):
    for c in conditions:
        df = df.filter(c)
    return df.agg(F.sum("value")).first()[0]


def times(project, scenario, factor, condition="true"):
    table = project.calculated_table(scenario, ANNUAL_RES)
    value = F.when(F.expr(condition), F.col("value") * factor).otherwise(F.col("value"))
    project.override_with(scenario, ANNUAL_RES, table.withColumn("value", value))


@pytest.fixture
def stored(project, tmp_path):
    project.result_path = str(tmp_path / "result")
    project.compute_energy_projection()
    return project


def runs(project):
    version = VersionStore(project.spark, project.result_path).version()
    return {(s, y): run for s, years in version.runs.items() for y, run in years.items()}


class Stop(Exception):
    pass


STEPS = [
    (module, "pin", 1),
    (module, "factor_prints", 1),
    (module, "shape_prints", 1),
    (module, "weather_print", 1),
    (module, "write_projection", 1),
    (module, "write_sums", 1),
    (module, "write_sums", 2),
    (VersionStore, "written", 1),
    (VersionStore, "commit", 1),
    (versions, "make_file", 1),
]


def test_a_failure_at_any_step_leaves_the_old_result_whole(stored, monkeypatch):
    table = stored.calculated_table("rich", ANNUAL_RES)
    before, rows = total(stored.get_energy_projection()), stored.get_energy_projection().count()
    hours = total(stored.get_hourly_sums())
    for owner, name, turn in STEPS:
        calls, real = [], getattr(owner, name)

        def broken(*args, **kwargs):
            calls.append(name)
            if len(calls) >= turn:
                raise Stop(name)
            return real(*args, **kwargs)

        with monkeypatch.context() as patch:
            patch.setattr(owner, name, broken)
            with pytest.raises(Stop):
                stored.override_with("rich", ANNUAL_RES, table.withColumn("value", F.col("value") * 2))
        assert len(calls) >= turn  # the writes of a run go side by side
        # The override that could not be computed is gone as well.
        assert stored.get_table_overrides() == {} and not stored.catalog.overrides
        assert stored.list_result_versions() == [1]
    assert total(stored.get_energy_projection()) == before and stored.get_energy_projection().count() == rows
    assert total(stored.get_hourly_sums()) == hours
    residential = total(stored.get_energy_projection("rich"), "sector = 'Residential'")
    times(stored, "rich", 2)
    assert stored.list_result_versions() == [1, 2]
    assert total(stored.get_energy_projection("rich"), "sector = 'Residential'") == pytest.approx(2 * residential)


def test_failed_runs_leave_no_files_and_removal_fails_whole(stored, monkeypatch, tmp_path):
    times(stored, "rich", 2)
    with monkeypatch.context() as patch:
        patch.setattr(module, "write_sums", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stored.remove_calculated_table_overrides([TableOverride("rich", ANNUAL_RES)])
    assert stored.get_table_overrides() == {"rich": [ANNUAL_RES]}
    assert len(list((tmp_path / "result" / "data").glob("run=*"))) == 2
    stored.remove_calculated_table_overrides([TableOverride("rich", ANNUAL_RES)])
    assert stored.list_result_versions() == [1, 2, 3]


def test_readers_keep_their_version(stored):
    old = stored.get_energy_projection("rich")
    before = total(old)
    times(stored, "rich", 3)
    after = total(stored.get_energy_projection("rich"))
    assert total(old) == before == total(stored.get_energy_projection("rich", version=1)) < after
    with pytest.raises(InvalidOperation, match="no version 7"):
        stored.get_energy_projection(version=7)
    stored.remove_old_versions()
    assert stored.list_result_versions() == [2] and total(stored.get_energy_projection("rich")) == after
    with pytest.raises(InvalidOperation):
        stored.get_energy_projection(version=1)
    with pytest.raises(InvalidParameter):
        stored.remove_old_versions(0)


def test_two_writers_cannot_make_one_version(stored):
    store = VersionStore(stored.spark, stored.result_path)
    base = store.version()
    store.commit(base, base.runs, base.prints)
    with pytest.raises(InvalidOperation, match="another writer"):
        store.commit(base, base.runs, base.prints)
    assert store.numbers() == [1, 2] and store.version().years("rich") == YEARS


def test_only_changed_years_are_written(stored):
    first = runs(stored)
    times(stored, "rich", 3, "model_year = 2030")
    second = runs(stored)
    assert {k for k in first if first[k] != second[k]} == {("rich", "2030")}
    # The same tables again: nothing is written, and there is no new version.
    stored.compute_energy_projection(only_changed=True)
    assert runs(stored) == second and stored.list_result_versions() == [1, 2]
    stored.remove_calculated_table_overrides([TableOverride("rich", ANNUAL_RES)])
    third = runs(stored)
    assert {k for k in second if second[k] != third[k]} == {("rich", "2030")}
    stored.compute_energy_projection(["baseline"])
    assert {k for k in third if third[k] != runs(stored)[k]} == {("baseline", str(y)) for y in YEARS}


def test_weather_and_shapes_count_for_every_year(stored):
    first = runs(stored)
    m = stored.calculated_table("baseline", "temperature_multipliers")
    stored.override_with("baseline", "temperature_multipliers", m.withColumn("heating_multiplier", F.col("heating_multiplier") * 2))
    second = runs(stored)
    assert {k for k in first if first[k] != second[k]} >= {("baseline", str(y)) for y in YEARS}
    shapes = stored.data_table("baseline", "load_shapes")
    more = F.when(F.expr("model_year = 2025 and hour = 6"), F.col("value") + 1).otherwise(F.col("value"))
    stored.catalog.put_data("baseline", "load_shapes", shapes.withColumn("value", more))
    stored.compute_energy_projection(["electric"], only_changed=True)
    third = runs(stored)
    assert {k for k in second if second[k] != third[k]} == {("electric", "2025")}


def test_without_overrides(project):
    plain = total(project.compute_energy_projection(["rich"]))
    times(project, "rich", 5)
    assert total(project.get_energy_projection()) > plain
    assert total(project.compute_energy_projection(["rich"], use_table_overrides=False)) == pytest.approx(plain)
    assert project.get_table_overrides() == {"rich": [ANNUAL_RES]}


def test_scenarios_from_an_override_have_sums_too(stored):
    hourly = stored.calculated_table("rich", "energy_projection")
    stored.override_with("rich", "energy_projection", hourly.withColumn("value", F.col("value") * 2))
    rows = stored.get_energy_projection("rich")
    for sums in (stored.get_hourly_sums(), stored.get_annual_sums()):
        assert total(sums, "scenario = 'rich'") == pytest.approx(total(rows), rel=1e-12)


def same(ours, theirs):
    """Equal rows; numbers but for the order of adding up."""
    assert ours.columns == theirs.columns
    numbers = [c for c, kind in ours.dtypes if kind == "double"]
    keys = [c for c in ours.columns if c not in numbers]
    a, b = ({tuple(r[k] for k in keys): [r[n] for n in numbers] for r in df.collect()} for df in (ours, theirs))
    assert a.keys() == b.keys() and a
    for key, values in a.items():
        assert values == [v if v is None else pytest.approx(v, rel=1e-9) for v in b[key]], key


QUERIES = {
    "consumption": ("_keys", lambda c: c.get_annual_electricity_consumption()),
    "consumption_by_sector": ("_keys", lambda c: c.get_annual_electricity_consumption(group_by="Sector")),
    "consumption_by_end_use": ("_keys", lambda c: c.get_annual_electricity_consumption(group_by="End Use")),
    "difference": ("_keys", lambda c: c.get_scenario_difference("baseline", "rich")),
    "peak": ("_hours", lambda c: c.get_annual_peak_demand()),
    "duration": ("_hours", lambda c: c.get_load_duration_curve(2030)),
    "growth": ("_hours", lambda c: c.get_growth_indicators("rich")),
    "hours": ("_hours", lambda c: c.get_time_series_comparison("rich", 2030, resample=series.HOURLY)),
    "season": ("_hours", lambda c: c.get_seasonal_load_lines("rich", agg="Median Day")),
    "season_area": ("_hours", lambda c: c.get_seasonal_load_area("rich", 2030)),
    "daily": ("data", lambda c: c.get_time_series_comparison("rich", 2030)),
    "season_by_sector": ("data", lambda c: c.get_seasonal_load_area("rich", 2030, breakdown="Sector")),
}


def test_queries_read_the_smallest_table_that_answers_them(project):
    project.compute_energy_projection()
    quick = ProjectionClient(project, geography="north")
    slow = ProjectionClient(project, project.get_energy_projection(), "north")
    for key, (table, query) in QUERIES.items():
        ours, theirs = query(quick), query(slow)
        folders = {t for t in ("_keys", "_hours", "data") if any(f"/{t}/run=" in f for f in ours.inputFiles())}
        assert folders == {table}, key
        if table != "data":
            same(ours, theirs)
    assert quick.get_unique_sectors() == slow.get_unique_sectors()
    assert quick.years == slow.years and quick.scenarios == slow.scenarios


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parents(text, scan):
    """The lines of a printed plan that stand above the (only) scan of a folder, from below."""
    lines = text.splitlines()
    [at] = [i for i, line in enumerate(lines) if "FileScan" in line and scan in line]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found, now = [], depth[at]
    for i in reversed(range(at)):
        if depth[i] < now:
            found.append(lines[i])
            now = depth[i]
    return found


def test_peak_rows_stay_where_they_are(project, monkeypatch):
    """Peaks are found in the sums by hour, and rows of the result are neither summed nor moved for them."""
    project.compute_energy_projection()
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = project.spark.conf.get(setting)
    project.spark.conf.set(setting, "-1")
    try:
        quick = ProjectionClient(project)
        ours = quick.get_annual_peak_demand(group_by="End Use")
        text = plan(ours)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        above = parents(text, "/data/run=")
        assert any("BroadcastHashJoin" in x for x in above)
        moved = [x for x in above[: next(i for i, x in enumerate(above) if "HashJoin" in x)] if "Exchange" in x or "Aggregate" in x]
        assert moved == []
        theirs = ProjectionClient(project, project.get_energy_projection()).get_annual_peak_demand(group_by="End Use")
        key = lambda r: tuple(r)[:-1] + (round(r.value, 6),)
        assert sorted(map(key, ours.collect())) == sorted(map(key, theirs.collect()))
        monkeypatch.setattr("kilocast.client.FEW_KEYS", 3)
        assert "BroadcastHashJoin" not in plan(ProjectionClient(project).get_annual_peak_demand(group_by="End Use"))
    finally:
        project.spark.conf.set(setting, before)


def test_ranges_of_stored_multipliers_are_not_read_again(stored):
    seen = stored.multiplier_statistics("rich")
    assert not seen.inputFiles()
    plain = Project(stored.spark, CONFIG, {n: stored.data_table("baseline", n) for n in stored.list_data_tables()})
    assert seen.columns == plain.multiplier_statistics("baseline").columns
    assert seen.collect() == plain.multiplier_statistics("baseline").collect()


def test_hours_are_written_in_order_without_being_sorted(stored, tmp_path):
    """Below the writer the hours come from a sort of representative rows; rows of a country lie together."""
    status = stored.spark._jsparkSession.sharedState().statusStore()
    known = status.executionsList()
    for k in reversed(range(known.size())):
        graph = status.planGraph(known.apply(k).executionId()).allNodes()
        nodes = [graph.apply(i).name() for i in range(graph.size())]
        nodes = [n for n in nodes if not n.startswith("WholeStageCodegen")]
        if "WriteFiles" in nodes and "Generate" in nodes[nodes.index("WriteFiles") :][:4]:
            break
    below = nodes[nodes.index("WriteFiles") :]
    assert below[1:4] == ["Project", "Generate", "Sort"] and "Exchange" in below[4:8]
    import pyarrow.parquet as pq

    files = list((tmp_path / "result" / "data").glob("run=*/scenario=*/model_year=*/*.parquet"))
    assert files
    for file in files:
        places = pq.read_table(file, columns=["geography"], partitioning=None)["geography"].to_pylist()
        changes = sum(a != b for a, b in zip(places, places[1:]))
        assert changes == len(set(places)) - 1


def test_one_file_exports_refuse_existing_targets_first(stored, tmp_path, monkeypatch):
    path = tmp_path / "all.csv"
    stored.export_energy_projection(str(path), single_file=True)
    assert path.is_file() and len(path.read_text().splitlines()) == stored.get_energy_projection().count() + 1
    monkeypatch.setattr(module, "write_table", None)
    with pytest.raises(InvalidOperation, match="exists"):
        stored.export_energy_projection(str(path))
    monkeypatch.undo()
    stored.export_calculated_table("baseline", "gdp_country", str(path), overwrite=True, single_file=True)
    assert len(path.read_text().splitlines()) == 5
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("all")] == ["all.csv"]


def test_sums_planned_beside_the_rows_are_written_after_them(project, tmp_path, monkeypatch):
    """The rows' write sets how many files a task may have open, for the whole session and for its own time only."""
    ended, writers = tmp_path / "ended", "spark.sql.maxConcurrentOutputFileWriters"
    marker, write_rows, write_sums = str(ended), module.write_projection, module.write_sums

    def wait(condition):
        stop = time.time() + 60
        while not condition() and time.time() < stop:
            time.sleep(0.01)

    def rows(*args, **kwargs):
        write_rows(*args, **kwargs)
        ended.touch()

    def late(batches):
        wait(lambda: os.path.exists(marker))
        yield from batches

    def sums(df, path):
        wait(lambda: project.spark.conf.get(writers) != "0")
        write_sums(df.coalesce(1).mapInArrow(late, df.schema), path)

    monkeypatch.setattr(module, "write_projection", rows)
    monkeypatch.setattr(module, "write_sums", sums)
    project.result_path = str(tmp_path / "result")
    project.compute_energy_projection()
    expected = total(project.get_energy_projection())
    assert total(project.get_hourly_sums()) == pytest.approx(expected)
    assert total(project.get_annual_sums()) == pytest.approx(expected)
