"""A project: its tables, overrides, computation and exports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kilocast.config import BASELINE, ProjectConfig, TableOverride
from kilocast.errors import InvalidOperation, InvalidParameter
from kilocast.functions.calendar import year_of
from kilocast.operators import weather
from kilocast.operators.checks import association_gaps, time_gaps
from kilocast.operators.drivers import in_countries, in_years
from kilocast.operators.mapping import MANY_TO_ONE, map_dimension, mapping_problems
from kilocast.operators import projection as projections
from kilocast.operators.projection import FILE_ORDER, RESULT_COLUMNS
from kilocast.plans.models import MODELS
from kilocast.plans.prints import factor_prints, shape_prints, weather_print
from kilocast.plans.storage import fresh_path, pin, remove, setting
from kilocast.plans.tables import (
    Catalog,
    group_factors,
    group_projection,
    group_shapes,
    share_expansion,
    stands_alone,
)
from kilocast.plans.versions import Version, VersionStore
from kilocast.queries import listing
from kilocast.schemas import DATA_TABLES, HOURS, PROJECTION, YEARS
from kilocast.sources.files import cast_years, check_target, read_table, write_table

OVERRIDE_SUFFIX = "_override"
KEYS = ("geography", "scenario", "model_year")
# Tables of a stored result: all rows, sums by hour, and sums by year, sector and end use.
ROWS_TABLE, HOURS_TABLE, YEARS_TABLE = RESULT_TABLES = ("data", "_hours", "_keys")
MAPPING = StructType([StructField("from_id", StringType()), StructField("to_id", StringType())])
# Files of the stored projection for each scenario and model year.
FILES_PER_YEAR = 16
# The same of the sums stored beside it.
SUM_FILES = 2
# Files that a task may have open when its rows come in order; with more of them Spark sorts the rest.
OPEN_FILES = 8
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class Project:
    """Data, configuration and calculated tables of all scenarios; everything is lazy
    until ``compute_energy_projection`` or an export writes it."""

    def __init__(
        self,
        spark: SparkSession,
        config: ProjectConfig,
        data: Mapping[str, DataFrame],
        scenario_data: Mapping[tuple[str, str], DataFrame] | None = None,
        result_path: str | None = None,
        strict: bool = False,
    ) -> None:
        self.spark = spark
        self.config = config
        self.catalog = Catalog(config, data, scenario_data, strict)
        self.result_path = result_path
        self._overrides: list[TableOverride] = []
        # Multipliers as planned or as stored, and as stored.
        self._pinned: list[tuple[DataFrame, DataFrame]] = []
        self._stored_paths: list[str] = []
        # Ranges of the multipliers, seen while they were stored.
        self._ranges: list[tuple[DataFrame, Observation]] = []

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        config: ProjectConfig,
        files: Mapping[str, str],
        mappings: Mapping[str, Sequence[tuple[str, str, str]]] | None = None,
        result_path: str | None = None,
        strict: bool = False,
        check_time: bool = True,
        associations: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    ) -> Project:
        """Read the baseline's data tables and those that scenarios replace, and check them.

        ``mappings`` lists, for a table, (dimension, mapping file, mapping type)
        to apply on reading; tables without an entry are taken as they are.
        Every table must have the columns and types of its kind. Mappings are
        checked, and so is the weather's time unless ``check_time`` is off;
        ``associations`` lists, for a table, the ids of dimensions of which
        every combination must be there. The configuration's countries may be
        written in any case, and its overrides are applied.
        """
        mappings = mappings or {}

        def load(name: str, path: str) -> DataFrame:
            df = fit(cast_years(read_table(spark, path, DATA_TABLES[name])), DATA_TABLES[name], name)
            for dimension, mapping_path, kind in mappings.get(name, ()):
                mapping = read_table(spark, mapping_path, MAPPING)
                problems = mapping_problems(df, mapping, dimension, kind or MANY_TO_ONE)
                refuse(problems, f"the mapping of {dimension} of {name}")
                df = map_dimension(df, mapping, dimension, kind or MANY_TO_ONE)
            return df

        data = {name: load(name, path) for name, path in files.items()}
        own = {
            (s.name, name): load(name, path)
            for s in config.scenarios
            for name, path in s.tables.items()
        }
        project = cls(spark, config, data, own, result_path, strict)
        if config.countries is not None:
            spelt = [project.validate_country(c) for c in config.countries]
            project.config = project.catalog.config = config.with_countries(*spelt)
        if check_time:
            project.check_time()
        for name, others in (associations or {}).items():
            table = project.data_table(BASELINE, name)
            places = project.data_table(BASELINE, "gdp").select("geography").distinct()
            refuse(association_gaps(table, places, others), f"the combinations in {name}")
        project.override_calculated_tables(config.calculated_table_overrides)
        return project

    def check_time(self) -> None:
        """Every variable of the weather must have each day of the weather year once."""
        year = self.config.weather_year
        for scenario in self.list_scenario_names():
            if scenario != BASELINE and not self.catalog.replaces(scenario, "weather_bait"):
                continue
            days = in_countries(self.data_table(scenario, "weather_bait"), self.config.countries)
            days = days.filter(year_of(F.col("timestamp")) == year)
            gaps = time_gaps(
                days, ["geography", "metric"], 24, f"{year}-01-01 00:00:00", f"{year}-12-31 00:00:00"
            )
            refuse(gaps, f"the weather of {year} in {scenario!r}")
            if days.isEmpty():
                raise InvalidParameter(f"scenario {scenario!r} has no weather of {year}")

    # Names

    def list_scenario_names(self) -> list[str]:
        return [s.name for s in self.config.scenarios]

    @staticmethod
    def list_data_tables() -> list[str]:
        return list(DATA_TABLES)

    def list_calculated_tables(self) -> list[str]:
        """All calculated tables, and the overrides that exist in any scenario."""
        return [*MODELS, *sorted({f"{o.table_name}{OVERRIDE_SUFFIX}" for o in self._overrides})]

    def valid_ids(self, table: str, dimension: str) -> DataFrame:
        """Ids of a dimension that the baseline's table has; weather years come from dates."""
        df = self.data_table(BASELINE, table)
        if dimension == "weather_year" and dimension not in df.columns:
            df = df.select(year_of(F.col("timestamp")).alias(dimension))
        return listing.valid_ids(df, dimension)

    def list_valid_model_years(self) -> list[int]:
        return [row[0] for row in self.valid_ids("load_shapes", "model_year").collect()]

    def list_valid_weather_years(self) -> list[int]:
        return [row[0] for row in self.valid_ids("weather_bait", "weather_year").collect()]

    def list_valid_countries(self) -> list[str]:
        return [row[0] for row in self.valid_ids("gdp", "geography").collect()]

    def validate_country(self, country: str) -> str:
        """The country as the data spell it."""
        return listing.matching_id(self.data_table(BASELINE, "gdp"), "geography", country)

    def _check_scenario(self, scenario: str) -> None:
        if scenario not in self.list_scenario_names():
            raise InvalidParameter(f"the project has no scenario {scenario!r}")

    def _check_table(self, scenario: str, table: str) -> None:
        self._check_scenario(scenario)
        if table not in MODELS:
            raise InvalidParameter(f"scenario {scenario!r} calculates no table {table!r}")

    # Tables

    def data_table(self, scenario: str, name: str) -> DataFrame:
        self._check_scenario(scenario)
        return self.catalog.data(scenario, name)

    def calculated_table(self, scenario: str, name: str) -> DataFrame:
        """A calculated table of a scenario, overrides included."""
        base = name.removesuffix(OVERRIDE_SUFFIX)
        if base != name and (scenario, base) not in self.catalog.overrides:
            raise InvalidParameter(f"{name!r} does not exist in {scenario=}")
        self._check_table(scenario, base)
        return self.catalog.scenario(scenario).table(base)

    def show_data_table(self, scenario: str, name: str, limit: int = 20) -> DataFrame:
        """First rows of a data table within the project's countries and years."""
        df = self.data_table(scenario, name)
        if "geography" in df.columns:
            df = in_countries(df, self.config.countries)
        if "model_year" in df.columns:
            df = in_years(df, self.config.list_model_years())
        if "weather_year" in df.columns:
            df = df.filter(F.col("weather_year") == self.config.weather_year)
        return df.limit(limit)

    def show_calculated_table(self, scenario: str, name: str, limit: int = 20) -> DataFrame:
        return self.calculated_table(scenario, name).limit(limit)

    # Projection

    def energy_projection(self, scenarios: Sequence[str] | None = None) -> DataFrame:
        """Plan of the hourly projection; scenarios with equal shapes share one expansion.

        Nothing runs yet, and the optimizer chooses the joins.
        """
        groups = share_expansion(self.catalog, self._names(scenarios))
        return reduce(
            DataFrame.unionByName, [group_projection(self.catalog, g) for g in groups]
        )

    def prepared_projection(
        self, scenarios: Sequence[str] | None = None, files: int | None = None
    ) -> DataFrame:
        """The same, with the multipliers computed and stored first.

        ``files`` lays the rows out for writing, in so many files for each
        scenario and year.
        """
        names = self._names(scenarios)
        self._pin_multipliers(names)
        groups = share_expansion(self.catalog, names)
        return reduce(
            DataFrame.unionByName, [group_projection(self.catalog, g, files) for g in groups]
        )

    def _names(self, scenarios: Sequence[str] | None) -> list[str]:
        names = list(scenarios) if scenarios is not None else self.list_scenario_names()
        for name in names:
            self._check_scenario(name)
        return names

    def _pin_multipliers(self, names: Sequence[str]) -> None:
        planned = {
            name: self.catalog.scenario(name).weather("temperature_multipliers")
            for name in names
            if not self.catalog.scenario(name).replaced("temperature_multipliers")
        }
        for name, multipliers in planned.items():
            stored = next((new for old, new in self._pinned if old is multipliers), None)
            if stored is None:
                path = fresh_path(self.spark)
                self._stored_paths.append(path)
                seen = Observation()
                stored = pin(multipliers.observe(seen, *weather.range_columns()), path)
                self._ranges.append((stored, seen))
                self._pinned += [(multipliers, stored), (stored, stored)]
            self.catalog.scenario(name).use_stored_multipliers(stored)

    def close(self) -> None:
        """Delete the intermediate tables; the result stays. Tables planned before are not to be read after."""
        for path in self._stored_paths:
            remove(self.spark, path)
        self._stored_paths.clear()
        self._pinned.clear()
        self._ranges.clear()
        self.catalog.forget_plans()

    def multiplier_statistics(self, scenario: str) -> DataFrame:
        """Range of each temperature multiplier of a scenario, in one row.

        Multipliers that a computation has stored were looked at while they were
        written, and are not read again.
        """
        table = self.calculated_table(scenario, "temperature_multipliers")
        seen = next((seen for stored, seen in self._ranges if stored is table), None)
        if seen is None:
            return weather.multiplier_range(table)
        names = [f"{label}_{kind}" for kind in weather.KINDS for label in ("min", "max")]
        schema = StructType([StructField(name, DoubleType()) for name in names])
        return self.spark.createDataFrame([tuple(seen.get[name] for name in names)], schema)

    def compute_energy_projection(
        self,
        scenarios: Sequence[str] | None = None,
        files: int = FILES_PER_YEAR,
        use_table_overrides: bool = True,
        only_changed: bool = False,
    ) -> DataFrame:
        """Compute and write the projection, partitioned by scenario and model year.

        The result gets a new version, which takes over the scenarios that are
        not named. Nothing of the old version is touched and it stays the result
        until the new one is whole, so a failure at any step leaves it; a
        DataFrame read before goes on showing it. Sums by hour and by year are
        stored beside the rows, for the queries that need no more. A scenario
        without rows is an error.

        With ``only_changed`` years whose factors, shapes and weather have the
        fingerprints of the last version are taken over and not written again.
        Without ``use_table_overrides`` the tables are those without overrides.
        """
        names = self._names(scenarios)
        with nullcontext() if use_table_overrides else self._without_overrides():
            path = self.result_path or fresh_path(self.spark)
            store = VersionStore(self.spark, path)
            base = store.version()
            run = store.new_run()
            pinned: list[str] = []
            try:
                runs, prints = self._write_run(store, base if only_changed else None, run, names, files, pinned)
            except BaseException:
                store.discard(run, RESULT_TABLES)
                raise
            finally:
                for folder in pinned:
                    remove(self.spark, folder)
            if base is not None:
                # Scenarios that were not asked for stay, unless the project has lost them.
                kept = set(self.list_scenario_names()) - set(names) if scenarios is not None else ()
                runs = {s: base.runs[s] for s in base.runs if s in kept} | runs
                prints = {s: base.prints[s] for s in base.prints if s in kept} | prints
            if base is None or (dict(base.runs), dict(base.prints)) != (runs, prints):
                store.commit(base, runs, prints)
            self.result_path = path
        return self.get_energy_projection()

    def _write_run(
        self,
        store: VersionStore,
        base: Version | None,
        run: str,
        names: Sequence[str],
        files: int,
        pinned: list[str],
    ) -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
        """Write what differs from ``base``; the run and the fingerprint of each scenario and year."""
        self._pin_multipliers(names)
        runs: dict[str, dict[str, str]] = {name: {} for name in names}
        prints: dict[str, dict[str, str]] = {name: {} for name in names}
        for members in share_expansion(self.catalog, names):
            if stands_alone(self.catalog, members[0]):
                self._write_alone(store, run, members[0])
                continue
            path = fresh_path(self.spark)
            pinned.append(path)
            factors = pin(group_factors(self.catalog, members), path)
            shapes, multipliers = group_shapes(self.catalog, members)
            outside = weather_print(multipliers)
            by_year = shape_prints(shapes)
            wanted: dict[str, list[str]] = {}
            for (scenario, year), own in factor_prints(factors).items():
                found = f"{own}-{by_year.get(year, '')}-{outside}"
                prints[scenario][year] = found
                if base is not None and base.prints.get(scenario, {}).get(year) == found:
                    runs[scenario][year] = base.runs[scenario][year]
                else:
                    wanted.setdefault(scenario, []).append(year)
            if wanted:
                self._write_group(store, run, members, _of_years(factors, wanted), files)
        written = store.written(ROWS_TABLE, run)
        for name in names:
            runs[name].update(dict.fromkeys(written.get(name, ()), run))
            # Factors of which no shape is there have no rows.
            prints[name] = {year: p for year, p in prints[name].items() if year in runs[name]}
        empty = [name for name in names if not runs[name]]
        if empty:
            raise InvalidParameter(f"there is no hourly projection for scenarios {empty}")
        return runs, prints

    def _write_group(
        self, store: VersionStore, run: str, members: Sequence[str], factors: DataFrame, files: int
    ) -> None:
        """Rows, hours and years of scenarios that share an expansion."""
        shapes, multipliers = group_shapes(self.catalog, members)
        rows = group_projection(self.catalog, members, files, factors)
        hours = projections.project_hours(shapes, multipliers, factors)
        years = projections.project_years(shapes, multipliers, factors)
        # None needs another, so the small ones fill what the large one leaves idle. All end before a failure shows.
        with ThreadPoolExecutor(3) as threads:
            parts = [
                threads.submit(write_projection, rows, store.folder(ROWS_TABLE, run), in_order=True),
                threads.submit(write_sums, hours, store.folder(HOURS_TABLE, run)),
                threads.submit(write_sums, years, store.folder(YEARS_TABLE, run)),
            ]
        for part in parts:
            part.result()

    def _write_alone(self, store: VersionStore, run: str, name: str) -> None:
        """The same of a scenario whose rows come from an override, summed up from what is written."""
        folder = store.folder(ROWS_TABLE, run)
        write_projection(self.catalog.scenario(name).table("energy_projection"), folder)
        written = store.scenario_folders(ROWS_TABLE, run).get(name)
        if written is None:
            return
        rows = self.spark.read.schema(PROJECTION).option("basePath", folder).parquet(written)
        by_hour = rows.groupBy("timestamp", *FILE_ORDER).agg(F.sum("value").alias("value"))
        write_sums(by_hour, store.folder(HOURS_TABLE, run))
        by_year = rows.groupBy(*FILE_ORDER, "sector", "metric").agg(F.sum("value").alias("value"))
        write_sums(by_year, store.folder(YEARS_TABLE, run))

    @property
    def result_version(self) -> int:
        """Number of the latest version of the stored result, 0 if there is none."""
        known = [] if self.result_path is None else VersionStore(self.spark, self.result_path).numbers()
        return known[-1] if known else 0

    def list_result_versions(self) -> list[int]:
        return [] if self.result_path is None else VersionStore(self.spark, self.result_path).numbers()

    def remove_old_versions(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and what failed runs have left.

        DataFrames of the others are not to be read after, and nobody may be computing meanwhile.
        """
        if keep < 1:
            raise InvalidParameter("at least one version has to stay")
        if self.result_path is not None:
            VersionStore(self.spark, self.result_path).keep_last(keep, RESULT_TABLES)

    def _stored(self, table: str, schema: StructType, version: int | None) -> DataFrame:
        found = None
        if self.result_path is not None:
            store = VersionStore(self.spark, self.result_path)
            found = store.version(version)
        if found is None:
            raise InvalidOperation("the energy projection has not been computed yet")
        return store.read(found, table, schema)

    def get_projection_keys(self, version: int | None = None) -> DataFrame:
        """Countries, scenarios and model years of the written projection."""
        return self.get_annual_sums(version).select(*KEYS).distinct()

    def get_annual_sums(self, version: int | None = None) -> DataFrame:
        """Energy of the written projection by year, sector and end use."""
        return self._stored(YEARS_TABLE, YEARS, version)

    def get_hourly_sums(self, version: int | None = None) -> DataFrame:
        """Load of the written projection by hour, of all sectors and end uses together."""
        return self._stored(HOURS_TABLE, HOURS, version)

    def _recompute(self, scenarios: Iterable[str]) -> None:
        """Bring the stored result, if there is one, up to date with changed scenarios."""
        changed = list(dict.fromkeys(scenarios))
        if changed and self.result_version:
            self.compute_energy_projection(changed, only_changed=True)

    def get_energy_projection(self, scenario: str | None = None, version: int | None = None) -> DataFrame:
        """The written projection, the latest version if none is named; one scenario reads its partitions only."""
        result = self._stored(ROWS_TABLE, PROJECTION, version)
        if scenario is not None:
            self._check_scenario(scenario)
            result = result.filter(F.col("scenario") == scenario)
        return result.select(*RESULT_COLUMNS)

    # Overrides

    def get_table_overrides(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for item in self._overrides:
            found.setdefault(item.scenario, []).append(item.table_name)
        return found

    def override_calculated_tables(self, overrides: Iterable[TableOverride]) -> None:
        """Replace calculated tables by files, in the named scenarios only.

        A stored projection of these scenarios is computed again.
        """
        requests = list(overrides)
        for item in requests:
            if item.filename is None:
                raise InvalidParameter(f"an override needs a file: {item}")
            if OVERRIDE_SUFFIX in item.table_name:
                raise InvalidOperation(f"an override cannot be overridden: {item.table_name}")
            self._check_table(item.scenario, item.table_name)
        loaded = []
        for item in requests:
            schema = self.calculated_table(item.scenario, item.table_name).schema
            df = read_table(self.spark, item.filename, schema)
            loaded.append((item, conform(df, schema)))
        with self._all_or_nothing():
            for item, df in loaded:
                self._put(item.scenario, item.table_name, df)
            self._recompute(item.scenario for item, _ in loaded)

    def override_with(self, scenario: str, table: str, df: DataFrame) -> None:
        """Replace a calculated table by a DataFrame of the same columns; recomputes as above."""
        with self._all_or_nothing():
            self._put(scenario, table, df)
            self._recompute([scenario])

    def _put(self, scenario: str, table: str, df: DataFrame) -> None:
        existing = self.calculated_table(scenario, table)
        self.catalog.put_override(scenario, table, conform(df, existing.schema))
        entry = TableOverride(scenario, table)
        if entry not in self._overrides:
            self._overrides.append(entry)

    def remove_calculated_table_overrides(self, overrides: Iterable[TableOverride]) -> None:
        """Undo overrides, named with or without the override suffix."""
        entries = []
        for item in overrides:
            base = item.table_name.removesuffix(OVERRIDE_SUFFIX)
            if "override" in base:
                raise InvalidParameter(f"unexpected table name {item.table_name!r}")
            self._check_scenario(item.scenario)
            entry = TableOverride(item.scenario, base)
            if entry not in self._overrides:
                raise InvalidParameter(f"{base!r} is not overridden in {item.scenario!r}")
            if entry in entries:
                raise InvalidOperation(f"{item.table_name!r} is named more than once")
            entries.append(entry)
        with self._all_or_nothing():
            for entry in entries:
                self._overrides.remove(entry)
                self.catalog.drop_override(entry.scenario, entry.table_name)
            self._recompute(entry.scenario for entry in entries)

    @contextmanager
    def _all_or_nothing(self) -> Iterator[None]:
        """Put the overrides back as they were if a change of them, or what follows from it, fails."""
        tables, entries = dict(self.catalog.overrides), list(self._overrides)
        try:
            yield
        except BaseException:
            self.catalog.restore_overrides(tables)
            self._overrides[:] = entries
            raise

    @contextmanager
    def _without_overrides(self) -> Iterator[None]:
        tables = dict(self.catalog.overrides)
        self.catalog.restore_overrides({})
        try:
            yield
        finally:
            self.catalog.restore_overrides(tables)

    # Exports

    def export_calculated_table(
        self, scenario: str, table: str, path: str, overwrite: bool = False, single_file: bool = False
    ) -> None:
        check_target(self.spark, path, overwrite)
        write_table(self.calculated_table(scenario, table), path, overwrite, single_file)

    def export_energy_projection(self, path: str, overwrite: bool = False, single_file: bool = False) -> None:
        check_target(self.spark, path, overwrite)
        write_table(self.get_energy_projection(), path, overwrite, single_file)


def schema_differences(new: StructType, existing: StructType) -> list[str]:
    """What keeps ``new`` from standing in for ``existing``; column order does not matter."""
    ours, theirs = (
        sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
        for schema in (new, existing)
    )
    if len(ours) != len(theirs):
        return [f"there are columns {[c for c, _ in ours]}, wanted are {[c for c, _ in theirs]}"]
    return [f"column {a} should be {b}" for a, b in zip(ours, theirs) if a != b]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The table in the column order of ``schema``, or an error if it does not fit."""
    problems = schema_differences(df.schema, schema)
    if problems:
        raise InvalidParameter(problems[0])
    return df.select(*schema.fieldNames())


def fit(df: DataFrame, schema: StructType, name: str) -> DataFrame:
    """An input in the columns and types of its kind; only lossless changes of number and time types are made."""
    wider = {
        "bigint": ("tinyint", "smallint", "int", "bigint"),
        "double": ("float", "double", "tinyint", "smallint", "int", "bigint"),
        "timestamp_ntz": ("timestamp_ntz", "timestamp"),
    }
    found = dict(df.dtypes)
    for field in schema.fields:
        wanted = field.dataType.simpleString()
        if found.get(field.name) not in wider.get(wanted, (wanted,)):
            raise InvalidParameter(
                f"{name}: column {field.name} should be {wanted}, is {found.get(field.name, 'missing')}"
            )
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def refuse(problems: DataFrame, what: str) -> None:
    """Raise if a check has found anything, with the first few rows."""
    rows = [tuple(r) for r in problems.take(5)]
    if rows:
        raise InvalidParameter(f"{what} cannot be used, for instance: {rows}")


def _of_years(factors: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """The factors of some scenarios and years."""
    chosen = [
        (F.col("scenario") == scenario) & F.col("model_year").isin([int(y) for y in years])
        for scenario, years in wanted.items()
    ]
    return factors.filter(reduce(lambda a, b: a | b, chosen))


def write_projection(projection: DataFrame, path: str, in_order: bool = False) -> None:
    """Write by scenario and model year, rows of one country together.

    Rows that are ``in_order`` in their tasks are written as they come, each
    task with the files of its few scenarios and years open; others are sorted
    first, so that a task has one file open at a time. May add to what a run has
    written already.
    """
    with setting(projection.sparkSession, _WRITERS, str(OPEN_FILES if in_order else 0)):
        rows = projection if in_order else projection.sortWithinPartitions(*FILE_ORDER)
        rows.write.mode("append").partitionBy("scenario", "model_year").parquet(path)


def write_sums(sums: DataFrame, path: str) -> None:
    """Write a table of sums, the rows of a scenario and year in few files.

    Sorted here: Spark leaves its own sort out if it plans while rows are written
    ``in_order`` beside it, and opens a file again if that has ended when its tasks start.
    """
    dealt = sums.repartition("scenario", "model_year", F.pmod(F.xxhash64("geography"), F.lit(SUM_FILES)))
    dealt = dealt.sortWithinPartitions("scenario", "model_year")
    dealt.write.mode("append").partitionBy("scenario", "model_year").parquet(path)
