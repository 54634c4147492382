"""Every registered query: the Spark side, and the SQL it is checked against.

Floating-point results are cut to significant digits on both sides, because
the two engines add up in different orders. The cut is spelled out, so that
both treat a tie alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.adapters import CONFIG, YEARS, Inputs
from contract.oracles import compose
from kilocast import Project, ProjectionClient, TableOverride
from kilocast.errors import InvalidParameter
from kilocast.functions.calendar import QUERY_WEEKEND, day_kind, day_of_year, season
from kilocast.operators import checks, mapping, shapes, weather
from kilocast.operators.intensity import NON_RESIDENTIAL, RESIDENTIAL
from kilocast.operators.projection import annual_mwh, replace_road_energy, scaling_factors
from kilocast.plans.project import MAPPING
from kilocast.plans.storage import fresh_path
from kilocast.queries import annual, duration, listing, seasonal, secondary, series
from kilocast.queries import weather as weather_queries
from kilocast.queries.scope import Scope
from kilocast.schemas import DATA_TABLES
from kilocast.sources.files import cast_years, read_table, write_table

Query = Callable[[Inputs], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ["baseline", "high_growth"]
ALL = Scope("all", scenario_order=ORDER)
BASE = Scope("all", ["baseline"], scenario_order=ORDER)
_MODELLED = (*NON_RESIDENTIAL, *RESIDENTIAL)


def add(key: str, query: Query, sql: str) -> None:
    QUERIES[key] = query
    ORACLES[key] = compose(sql)


def _significant(x: Column, digits: int) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * scale + 0.5) / scale)


def _cut(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: _significant(F.col(c), digits) for c in columns})


def cut(x: str, digits: int = 9) -> str:
    scale = f"pow(10e0, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0e0 ELSE floor({x} * {scale} + 0.5e0) / {scale} END"


def named(x: str, digits: int = 9) -> str:
    return f"{cut(x, digits)} AS {x}"


# Sources and sinks

_GDP_SQL = f"SELECT geography, model_year, {named('value')} FROM gdp"


def _through_file(i: Inputs, suffix: str) -> DataFrame:
    path = fresh_path(i.spark, suffix)
    write_table(i.gdp, path)
    schema = DATA_TABLES["gdp"] if suffix == ".csv" else None
    return _cut(read_table(i.spark, path, schema), "value")


add("src_csv", lambda i: _through_file(i, ".csv"), _GDP_SQL)
add("src_parquet", lambda i: _through_file(i, ".parquet"), _GDP_SQL)


def _through_partitions(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark)
    i.gdp.write.partitionBy("model_year").parquet(path)
    return _cut(read_table(i.spark, path).select("geography", "model_year", "value"), "value")


add("src_parquet_partitioned", _through_partitions, _GDP_SQL)


def _text_ids(i: Inputs) -> DataFrame:
    """Customers' balances, in folders named by nations like 007 and by year."""
    path = fresh_path(i.spark)
    rows = i.given("customer").groupBy(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("geography"),
        (2025 + F.col("c_custkey") % 3).alias("model_year"),
    ).agg(F.sum(F.round(F.col("c_acctbal") * 100)).alias("value"))
    rows.write.partitionBy("geography", "model_year").parquet(path)
    return read_table(i.spark, path).select("geography", "model_year", "value")


add(
    "src_parquet_text_ids",
    _text_ids,
    "SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS geography, CAST(2025 + c_custkey % 3 AS BIGINT) AS model_year, "
    "SUM(ROUND(c_acctbal * 100)) AS value FROM customer GROUP BY ALL",
)


def _export(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, ".parquet")
    i.project.export_calculated_table("baseline", "temperature_multipliers", path)
    kept = read_table(i.spark, path)
    return _cut(
        kept.select("geography", "timestamp", "heating_multiplier", "cooling_multiplier"),
        "heating_multiplier",
        "cooling_multiplier",
    )


add(
    "sink_export",
    _export,
    f'SELECT geography, "timestamp", {named("heating_multiplier")}, '
    f"{named('cooling_multiplier')} FROM multipliers",
)
add(
    "cast_years",
    lambda i: _cut(
        cast_years(i.gdp.withColumn("model_year", F.col("model_year").cast("string"))), "value"
    ),
    _GDP_SQL,
)


def _shown(i: Inputs) -> DataFrame:
    """Which rows the limit shows is open: each has to be one of the table, and so many there have to be."""
    shown = i.project.show_data_table("alternate_gdp", "load_shapes", 20)
    found = shown.join(i.load_shapes, shown.columns, "left_semi")
    return found.groupBy().agg(F.count("*").alias("n"), F.count_distinct(*shown.columns).alias("different"))


add(
    "show_data_table",
    _shown,
    "SELECT LEAST(COUNT(*), 20) AS n, LEAST(COUNT(*), 20) AS different FROM load_shapes",
)


def _written(i: Inputs) -> DataFrame:
    project = i.settled.project
    project.compute_energy_projection()
    return _cut(project.get_energy_projection("ev_projection"), "value", digits=6)


def _written_all(i: Inputs) -> DataFrame:
    return _cut(i.settled.project.compute_energy_projection(), "value", digits=6)


_PROJECTION_SQL = (
    'SELECT scenario, "timestamp", model_year, sector, geography, metric, '
    f"{named('value', 6)} FROM projections"
)
add("projection_all", _written_all, _PROJECTION_SQL)


def _years_left(i: Inputs) -> DataFrame:
    """A scenario computed again without its last year: nothing of that year may stay."""
    project = i.settled.project
    project.compute_energy_projection()
    name = "energy_intensity_res_hdi_population_applied_regression"
    for table in (name, "energy_intensity_com_ind_tra_gdp_applied_regression"):
        kept = project.calculated_table("baseline", table).filter("model_year < 2035")
        project.override_with("baseline", table, kept)
    return _consumption(project.get_energy_projection())


def _query_after_override(i: Inputs) -> DataFrame:
    """One client through computation and override."""
    project = i.settled.project
    project.compute_energy_projection()
    client = ProjectionClient(project)
    client.get_annual_electricity_consumption()
    _triple(project)
    return _cut(client.get_annual_electricity_consumption(group_by="Sector"), "value")


def _query_after_removal(i: Inputs) -> DataFrame:
    project = i.settled.project
    project.compute_energy_projection()
    client = ProjectionClient(project)
    _triple(project)
    client.get_annual_electricity_consumption()
    name = "energy_intensity_res_hdi_population_applied_regression_override"
    project.remove_calculated_table_overrides([TableOverride("baseline", name)])
    return _cut(client.get_annual_electricity_consumption(group_by="Sector"), "value")


add(
    "get_projection",
    _written,
    f"SELECT scenario, \"timestamp\", model_year, sector, geography, metric, {named('value', 6)} "
    "FROM projections WHERE scenario = 'ev_projection'",
)
add(
    "valid_model_years",
    lambda i: i.project.valid_ids("load_shapes", "model_year"),
    "SELECT DISTINCT model_year FROM load_shapes",
)
add(
    "valid_weather_years",
    lambda i: i.project.valid_ids("weather_bait", "weather_year"),
    'SELECT DISTINCT CAST(year("timestamp") AS BIGINT) AS weather_year FROM weather_in',
)
add(
    "valid_countries",
    lambda i: i.project.valid_ids("gdp", "geography"),
    "SELECT DISTINCT geography FROM gdp",
)
add(
    "validate_country",
    lambda i: _cut(
        i.gdp.filter(F.col("geography") == i.project.validate_country("europe")),
        "value",
    ),
    f"SELECT geography, model_year, {named('value')} FROM gdp WHERE lower(geography) = 'europe'",
)

# Scenarios and overrides

add(
    "scenario_fallback",
    lambda i: _cut(i.project.calculated_table("alternate_gdp", "hdi_country"), "value"),
    f"SELECT geography, model_year, {named('value')} FROM hdi",
)
add(
    "scenario_replace",
    lambda i: _cut(i.project.calculated_table("alternate_gdp", "gdp_country"), "value"),
    f"SELECT geography, model_year, {named('value')} FROM gdp_alt",
)


def _consumption(projection: DataFrame, by: str | None = "Sector") -> DataFrame:
    return _cut(annual.consumption(projection, Scope(), by), "value")


_CONSUMPTION_SQL = (
    "SELECT scenario, geography, model_year AS year, sector, "
    f"{cut('SUM(value)')} AS value FROM {{}} GROUP BY scenario, geography, model_year, sector"
)


def _triple(project: Project) -> DataFrame:
    name = "energy_intensity_res_hdi_population_applied_regression"
    table = project.calculated_table("baseline", name)
    project.override_with("baseline", name, table.withColumn("value", F.col("value") * 3))
    return table


def _tripled(i: Inputs) -> tuple[Project, DataFrame]:
    project = i.settled.project
    return project, _triple(project)


def _override_file(i: Inputs) -> DataFrame:
    """Export, change and load a table as CSV with its columns in another order."""
    project = i.settled.project
    name = "energy_projection_res_load_shapes"
    path = fresh_path(i.spark, ".csv")
    table = project.calculated_table("baseline", name).withColumn("value", F.col("value") * 3)
    write_table(table.select(*sorted(table.columns)), path)
    project.override_calculated_tables([TableOverride("baseline", name, path)])
    return _consumption(project.calculated_table("baseline", "energy_projection"))


def _override_removed(i: Inputs) -> DataFrame:
    project, _ = _tripled(i)
    name = "energy_intensity_res_hdi_population_applied_regression_override"
    project.remove_calculated_table_overrides([TableOverride("baseline", name)])
    return _consumption(project.calculated_table("baseline", "energy_projection"))


_TRIPLED = (
    "(SELECT 'baseline' AS scenario, * REPLACE "
    "(CASE sector WHEN 'Residential' THEN 3 ELSE 1 END * value AS value) FROM projection)"
)
_TRIPLED_ALL = (
    "(SELECT * REPLACE (CASE WHEN scenario = 'baseline' AND sector = 'Residential' "
    "THEN 3 ELSE 1 END * value AS value) FROM projections)"
)
_BASE_ONLY = "(SELECT 'baseline' AS scenario, * FROM projection)"
add(
    "override_table",
    lambda i: _consumption(_tripled(i)[0].calculated_table("baseline", "energy_projection")),
    _CONSUMPTION_SQL.format(_TRIPLED),
)
add("override_apply", _override_file, _CONSUMPTION_SQL.format(_TRIPLED))
add("override_remove", _override_removed, _CONSUMPTION_SQL.format(_BASE_ONLY))
add(
    "override_one_scenario",
    lambda i: _consumption(_tripled(i)[0].prepared_projection()),
    _CONSUMPTION_SQL.format(_TRIPLED_ALL),
)
add("override_then_query", _query_after_override, _CONSUMPTION_SQL.format(_TRIPLED_ALL))
add("override_removed_query", _query_after_removal, _CONSUMPTION_SQL.format("projections"))
add(
    "recompute_fewer_years",
    _years_left,
    _CONSUMPTION_SQL.format(
        "(SELECT * FROM projections WHERE scenario <> 'baseline' OR model_year < 2035)"
    ),
)


def _reordered_override(i: Inputs) -> DataFrame:
    """Tables that do not fit are refused; one with its columns in another order gives what its names say."""
    project = i.project
    gdp = project.calculated_table("baseline", "gdp_country")
    refused = 0
    for df in (gdp.withColumn("model_year", F.col("model_year").cast("int")), gdp.withColumn("more", F.lit(1))):
        try:
            project.override_with("baseline", "gdp_country", df)
        except InvalidParameter:
            refused += 1
    grown = gdp.select((F.col("value") * 1.5).alias("value"), "model_year", "geography")
    project.override_with("baseline", "gdp_country", grown)
    found = _cut(project.calculated_table("baseline", "gdp_country"), "value")
    return found.withColumn("refused", F.lit(refused).cast("long"))


add(
    "schema_diff",
    _reordered_override,
    f"SELECT geography, model_year, {cut('value * 1.5e0')} AS value, CAST(2 AS BIGINT) AS refused FROM gdp",
)


def _guarded(i: Inputs) -> DataFrame:
    """A project whose shapes are gone must refuse to compute; the result it had is the one that stays."""
    project = i.settled.project
    project.compute_energy_projection()
    project.catalog.put_data("baseline", "load_shapes", project.data_table("baseline", "load_shapes").filter("month > 12"))
    try:
        project.compute_energy_projection()
    except InvalidParameter:
        return _consumption(project.get_energy_projection())
    raise AssertionError("an empty projection was written")


add("empty_guard", _guarded, _CONSUMPTION_SQL.format("projections"))


def _versions(i: Inputs) -> DataFrame:
    """The consumption of a result that has been replaced, read from its own version, beside that of the new one."""
    project = i.settled.project
    old = project.compute_energy_projection()
    _triple(project)
    first = _consumption(old).withColumn("version", F.lit(1).cast("long"))
    again = _consumption(project.get_energy_projection(version=1)).withColumn("version", F.lit(10).cast("long"))
    last = _consumption(project.get_energy_projection()).withColumn("version", F.lit(project.result_version).cast("long"))
    return first.unionByName(again).unionByName(last)


add(
    "projection_version",
    _versions,
    "SELECT *, CAST(1 AS BIGINT) AS version FROM (" + _CONSUMPTION_SQL.format("projections") + ") "
    "UNION ALL SELECT *, 10 FROM (" + _CONSUMPTION_SQL.format("projections") + ") "
    "UNION ALL SELECT *, 2 FROM (" + _CONSUMPTION_SQL.format(_TRIPLED_ALL) + ")",
)


def _one_year_changed(i: Inputs) -> DataFrame:
    """An override that differs in one year: that year is written again, the others are taken over."""
    project = i.settled.project
    project.compute_energy_projection()
    name = "energy_intensity_res_hdi_population_applied_regression"
    more = F.when(F.col("model_year") == 2030, F.col("value") * 3).otherwise(F.col("value"))
    project.override_with("baseline", name, project.calculated_table("baseline", name).withColumn("value", more))
    return _consumption(project.get_energy_projection())


add(
    "recompute_one_year",
    _one_year_changed,
    _CONSUMPTION_SQL.format(
        "(SELECT * REPLACE (CASE WHEN scenario = 'baseline' AND sector = 'Residential' AND model_year = 2030 "
        "THEN 3 ELSE 1 END * value AS value) FROM projections)"
    ),
)
add(
    "compute_without_overrides",
    lambda i: _consumption(_tripled(i)[0].compute_energy_projection(use_table_overrides=False)),
    _CONSUMPTION_SQL.format("projections"),
)


def _client(i: Inputs) -> ProjectionClient:
    project = i.settled.project
    project.compute_energy_projection()
    return ProjectionClient(project)


_ALL_HOURS = (
    '(SELECT scenario, geography, model_year AS year, "timestamp", SUM(value) AS total FROM projections GROUP BY ALL)'
)
add(
    "hourly_sums",
    lambda i: _cut(_client(i).project.get_hourly_sums(), "value", digits=6),
    f'SELECT scenario, geography, year AS model_year, "timestamp", {cut("total", 6)} AS value FROM {_ALL_HOURS}',
)
add(
    "annual_sums",
    lambda i: _cut(_client(i).project.get_annual_sums(), "value"),
    f"SELECT scenario, geography, model_year, sector, metric, {cut('SUM(value)')} AS value "
    "FROM projections GROUP BY ALL",
)
add(
    "stored_consumption",
    lambda i: _cut(_client(i).get_annual_electricity_consumption(group_by="End Use"), "value"),
    f"SELECT scenario, geography, model_year AS year, metric, {cut('SUM(value)')} AS value FROM projections GROUP BY ALL",
)
add(
    "stored_peak",
    lambda i: _cut(_client(i).get_annual_peak_demand(), "value"),
    f"SELECT scenario, geography, year, {cut('MAX(total)')} AS value FROM {_ALL_HOURS} GROUP BY ALL",
)
add(
    "stored_peak_by_sector",
    lambda i: _cut(_client(i).get_annual_peak_demand(group_by="Sector"), "value", digits=6),
    f"SELECT p.scenario, p.geography, model_year AS year, sector, {cut('value', 6)} AS value FROM projections p JOIN "
    f"(SELECT * FROM {_ALL_HOURS} QUALIFY row_number() OVER (PARTITION BY scenario, geography, year "
    'ORDER BY total DESC, "timestamp") = 1) h ON h.scenario = p.scenario AND h.geography = p.geography '
    'AND h.year = p.model_year AND h."timestamp" = p."timestamp"',
)
add(
    "stored_hours",
    lambda i: _cut(_client(i).get_time_series_comparison("baseline", YEARS, resample=series.HOURLY), "value", digits=6),
    "SELECT scenario, geography, year, CAST(row_number() OVER (PARTITION BY scenario, geography, year "
    f'ORDER BY "timestamp") AS BIGINT) AS time_period, {cut("total", 6)} AS value FROM {_ALL_HOURS} '
    "WHERE scenario = 'baseline'",
)
add(
    "all_scenarios",
    lambda i: _cut(i.settled.project.prepared_projection(), "value", digits=6),
    'SELECT scenario, "timestamp", model_year, sector, geography, metric, '
    f"{named('value', 6)} FROM projections",
)
add(
    "scenario_rows",
    lambda i: i.settled.project.prepared_projection()
    .groupBy("scenario")
    .agg(F.count("*").alias("n")),
    "SELECT scenario, COUNT(*) AS n FROM projections GROUP BY scenario",
)
_KINDS = ("heating", "cooling", "other")
add(
    "multiplier_stats",
    lambda i: _cut(
        i.project.multiplier_statistics("baseline"),
        *[f"{label}_{kind}" for kind in _KINDS for label in ("min", "max")],
    ),
    "SELECT "
    + ", ".join(
        f"{cut(f'{label}({kind}_multiplier)')} AS {label}_{kind}"
        for kind in _KINDS
        for label in ("min", "max")
    )
    + " FROM multipliers",
)

# Dimension mapping and checks


def _balances(i: Inputs) -> DataFrame:
    """Customers' balances in cents by nation and segment."""
    cents = F.round(F.col("c_acctbal") * 100)
    return i.customers.groupBy(
        F.col("n_name").alias("geography"), F.col("c_mktsegment").alias("sector")
    ).agg(F.sum(cents).alias("value"))


_BALANCES = (
    "(SELECT n_name, geography AS region, c_mktsegment AS sector, "
    "SUM(round(c_acctbal * 100)) AS value FROM buyers GROUP BY ALL)"
)


def _mapping_file(i: Inputs) -> DataFrame:
    """Nation to region, by padded keys, written as CSV and read as a project does."""
    path = fresh_path(i.spark, ".csv")
    nation = i.given("nation")
    write_table(
        nation.select(
            F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("from_id"),
            F.concat(F.lit("0"), F.col("n_regionkey").cast("string")).alias("to_id"),
        ),
        path,
    )
    return read_table(i.spark, path, MAPPING)


add(
    "map_dim_agg",
    lambda i: mapping.map_dimension(
        _balances(i),
        i.places.select(F.col("n_name").alias("from_id"), F.col("geography").alias("to_id")),
        "geography",
    ),
    f"SELECT region AS geography, sector, SUM(value) AS value FROM {_BALANCES} GROUP BY ALL",
)
add(
    "map_dim_rename",
    lambda i: mapping.map_dimension(
        _balances(i),
        i.places.select(
            F.col("n_name").alias("from_id"), F.concat(F.lit("id-"), "n_nationkey").alias("to_id")
        ),
        "geography",
        mapping.ONE_TO_ONE,
    ),
    "SELECT concat('id-', n_nationkey) AS geography, sector, value "
    f"FROM {_BALANCES} b JOIN nation USING (n_name)",
)
add(
    "map_dim_numeric_ids",
    # Ids like 007 stay text on the way through a CSV file.
    lambda i: mapping.map_dimension(
        _balances(i).join(i.places.select("n_name", "n_nationkey"), F.col("n_name") == F.col("geography"))
        .select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("geography"), "sector", "value"),
        _mapping_file(i),
        "geography",
    ),
    "SELECT concat('0', r_regionkey) AS geography, sector, SUM(value) AS value "
    f"FROM {_BALANCES} JOIN region ON region = r_name GROUP BY ALL",
)
add(
    "map_passthrough",
    lambda i: _cut(i.project.data_table("baseline", "hdi"), "value"),
    f"SELECT geography, model_year, {named('value')} FROM hdi",
)
add(
    "check_mapping",
    # Nations of indebted suppliers against all nations, regions of rich customers against all.
    lambda i: checks.unknown_mapping_ids(
        i.places.select(F.col("n_name").alias("from_id"), F.col("geography").alias("to_id")),
        i.given("supplier")
        .filter(F.col("s_acctbal") < 0)
        .join(i.places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("id")),
        i.customers.filter(F.col("c_acctbal") > 9999).select(F.col("geography").alias("id")),
    ),
    "SELECT 'from' AS side, n_name AS id FROM nation WHERE n_nationkey NOT IN "
    "(SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) "
    "UNION ALL SELECT 'to', r_name FROM region WHERE r_name NOT IN "
    "(SELECT geography FROM buyers WHERE c_acctbal > 9999)",
)
add(
    "check_time",
    lambda i: checks.time_gaps(i.month_projection, ["scenario", "model_year", "sector"], 1),
    "SELECT 'missing' AS issue, * FROM (SELECT s.*, t.\"timestamp\" FROM "
    "(SELECT DISTINCT scenario, model_year, sector FROM month_projection) s, "
    "(SELECT unnest(generate_series(MIN(\"timestamp\"), MAX(\"timestamp\"), INTERVAL 1 HOUR)) "
    'AS "timestamp" FROM month_projection) t '
    'EXCEPT SELECT scenario, model_year, sector, "timestamp" FROM month_projection) '
    'UNION ALL SELECT \'duplicate\', scenario, model_year, sector, "timestamp" '
    "FROM month_projection GROUP BY ALL HAVING COUNT(*) > 1",
)
_SERIES = ["scenario", "model_year", "sector", "metric"]
add(
    "check_time_duplicates",
    # Every series once more from the fifteenth day on.
    lambda i: checks.time_gaps(
        i.month_projection.unionByName(i.month_projection.filter(F.dayofmonth("timestamp") >= 15)),
        _SERIES,
        1,
    ).filter("issue = 'duplicate'"),
    "SELECT 'duplicate' AS issue, scenario, model_year, sector, metric, \"timestamp\" "
    "FROM month_projection WHERE day(\"timestamp\") >= 15",
)
add(
    "check_time_bounds",
    lambda i: checks.time_gaps(
        i.month_projection, _SERIES, 1, "2024-01-02 00:00:00", "2024-01-20 23:00:00"
    ),
    "SELECT 'missing' AS issue, * FROM (SELECT s.*, t.\"timestamp\" FROM "
    "(SELECT DISTINCT scenario, model_year, sector, metric FROM month_projection) s, "
    "(SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-20 23:00:00', "
    'INTERVAL 1 HOUR)) AS "timestamp") t '
    'EXCEPT SELECT scenario, model_year, sector, metric, "timestamp" FROM month_projection) '
    "UNION ALL SELECT 'misplaced', scenario, model_year, sector, metric, \"timestamp\" "
    "FROM month_projection WHERE \"timestamp\" < TIMESTAMP '2024-01-02' "
    "OR \"timestamp\" > TIMESTAMP '2024-01-20 23:00:00'",
)
_BANDS = [str(b) for b in range(-1, 10)]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _associations(i: Inputs) -> DataFrame:
    """Nations by segment and thousands of balance; the top band may lack in Africa."""
    band = F.floor(F.col("c_acctbal") / 1000).cast("string")
    held = i.customers.select(
        F.col("n_name").alias("geography"),
        F.col("c_mktsegment").alias("sector"),
        band.alias("metric"),
    )
    allowed = i.places.filter(F.col("geography") == "AFRICA").select(
        F.col("n_name").alias("geography"),
        F.explode(F.lit(_SEGMENTS)).alias("sector"),
        F.lit("9").alias("metric"),
    )
    nations = i.given("nation").select(F.col("n_name").alias("geography"))
    return checks.association_gaps(held, nations, {"sector": _SEGMENTS, "metric": _BANDS}, allowed)


add(
    "check_assoc",
    _associations,
    "WITH want AS (SELECT n_name AS geography, sector, CAST(b AS VARCHAR) AS metric FROM nation, "
    "(SELECT DISTINCT c_mktsegment AS sector FROM customer), range(-1, 10) AS r(b)), "
    "held AS (SELECT DISTINCT n_name AS geography, c_mktsegment AS sector, "
    "CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS metric "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT 'missing' AS issue, * FROM (SELECT * FROM want EXCEPT SELECT * FROM held) "
    "WHERE NOT (metric = '9' AND geography IN (SELECT n_name FROM nation JOIN region "
    "ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA')) "
    "UNION ALL SELECT 'orphan', * FROM (SELECT * FROM held EXCEPT SELECT * FROM want)",
)

# Calculated tables


def add_table(key: str, table: str, columns: list[str], floats: list[str], sql: str) -> None:
    """A calculated table of the EV scenario; ``sql`` is what follows FROM."""

    def query(i: Inputs) -> DataFrame:
        df = i.project.calculated_table("ev_projection", table)
        return _cut(df.select(*columns, *floats), *floats)

    chosen = ", ".join([f'"{c}"' for c in columns] + [named(f) for f in floats])
    add(key, query, f"SELECT {chosen} FROM {sql}")


_GY = ["geography", "model_year"]
_GSS = ["geography", "sector", "subsector"]
_ABT = ["a0", "a1", "t0"]
add_table("gdp_country", "gdp_country", _GY, ["value"], "gdp")
add_table("hdi_country", "hdi_country", _GY, ["value"], "hdi")
add_table("population_country", "population_country", _GY, ["value"], "population")
_PARSED = [*_GSS, "parameter", "regression_type"]
add_table("ei_parsed", "energy_intensity_parsed", _PARSED, ["value"], "parsed")
_CIT = "energy_intensity_com_ind_tra"
_RES = "energy_intensity_res"
add_table(
    "ei_com_ind_tra",
    _CIT,
    _PARSED,
    ["value"],
    "parsed WHERE sector IN ('Commercial', 'Industrial', 'Transportation')",
)
add_table("ei_res", _RES, _PARSED, ["value"], "parsed WHERE sector = 'Residential'")
_FORM = [*_GSS, "regression_type"]
add_table("ei_pivot", f"{_CIT}_pivoted", _FORM, _ABT, "coefficients_cit")
add_table("ei_res_pivot", f"{_RES}_pivoted", _FORM, _ABT, "coefficients_res")
add_table(
    "ei_gdp",
    f"{_CIT}_gdp",
    [*_FORM, "model_year"],
    [*_ABT, "gdp_value"],
    "(SELECT c.*, model_year, value AS gdp_value FROM coefficients_cit c JOIN gdp "
    "USING (geography))",
)
add_table(
    "ei_hdi",
    f"{_RES}_hdi",
    [*_FORM, "model_year"],
    [*_ABT, "hdi_value"],
    "(SELECT c.*, model_year, value AS hdi_value FROM coefficients_res c JOIN hdi "
    "USING (geography))",
)
add_table(
    "ei_hdi_pop",
    f"{_RES}_hdi_population",
    [*_FORM, "model_year"],
    [*_ABT, "hdi_value", "population_value"],
    "(SELECT c.*, h.model_year, h.value AS hdi_value, p.value AS population_value "
    "FROM coefficients_res c JOIN hdi h USING (geography) JOIN population p "
    "ON p.geography = h.geography AND p.model_year = h.model_year)",
)
_ANNUAL = [*_GY, "sector", "subsector"]
add_table("annual_cit", f"{_CIT}_gdp_applied_regression", _ANNUAL, ["value"], "annual_cit")
add_table(
    "annual_res", f"{_RES}_hdi_population_applied_regression", _ANNUAL, ["value"], "annual_res"
)


def _keyed(source: str) -> str:
    return (
        "(SELECT geography, string_split(metric, '_')[1] AS parameter, "
        f"string_split(metric, '_')[2] AS regression_type, value FROM {source})"
    )


_KEYED = ["geography", "parameter", "regression_type"]
_PIVOTED = ["geography", "regression_type"]
add_table("vpc_parsed", "vehicle_per_capita_parsed", _KEYED, ["value"], _keyed("vpc_in"))
add_table("vpc_pivot", "vehicle_per_capita_pivoted", _PIVOTED, _ABT, "vpc")
add_table(
    "vpc_pop",
    "vehicle_per_capita_population",
    [*_PIVOTED, "model_year"],
    [*_ABT, "population_value"],
    "(SELECT v.*, model_year, value AS population_value FROM vpc v JOIN population "
    "USING (geography))",
)
add_table("vehicle_stock", "vehicle_stock_total", _GY, ["total_vehicles"], "stock")
add_table(
    "ev_share",
    "ev_stock_share_country",
    _GY,
    ["ev_stock_share"],
    "(SELECT geography, model_year, value AS ev_stock_share FROM ev_share_in)",
)
add_table("ev_stock", "ev_stock_total", _GY, ["ev_stock_total"], "ev_stock_q")
add_table(
    "phev_share",
    "phev_share_country",
    _GY,
    ["phev_share"],
    "(SELECT geography, model_year, value AS phev_share FROM phev_share_in)",
)
add_table("ev_split", "ev_stock_split", _GY, ["bev_stock", "phev_stock"], "ev_split_q")
add_table("km_parsed", "km_per_vehicle_year_parsed", _KEYED, ["value"], _keyed("km_in"))
add_table("km_pivot", "km_per_vehicle_year_pivoted", _PIVOTED, _ABT, "km")
add_table("km_applied", "km_per_vehicle_year_applied", _GY, ["km_per_vehicle_year"], "distance")
add_table(
    "wh_per_km",
    "electricity_per_vehicle_km_country",
    ["geography", "subsector", "model_year"],
    ["wh_per_km"],
    "(SELECT geography, subsector, model_year, value AS wh_per_km FROM wh_in)",
)
add_table(
    "ev_energy_by_type", "ev_energy_by_type", [*_GY, "ev_type"], ["wh_per_year"], "ev_energy"
)
add_table("ev_annual", "ev_annual_energy_tj", _ANNUAL, ["value"], "ev_tj")

_DAY = ["geography", "timestamp", "weather_year", "month", "day", "day_type"]
_VARIABLES = [
    "temperature",
    "solar_radiation",
    "wind_speed",
    "dew_point",
    "humidity",
    "bait",
]
add_table("weather_daily", "weather_bait_daily", _DAY, _VARIABLES, "daily")
add_table("degree_days", "weather_degree_days", _DAY, [*_VARIABLES, "hdd", "cdd"], "days")
_GROUP = ["geography", "weather_year", "month", "day_type"]
add_table(
    "degree_days_grouped",
    "weather_degree_days_grouped",
    [*_GROUP, "num_days"],
    ["total_hdd", "total_cdd"],
    "grouped",
)


def _days(i: Inputs) -> DataFrame:
    return i.project.calculated_table("baseline", "weather_degree_days")


add(
    "max_degree_days",
    lambda i: _cut(weather.max_degree_days(_days(i)), "max_hdd", "max_cdd"),
    f"SELECT {', '.join(_GROUP)}, {named('max_hdd')}, {named('max_cdd')} FROM maxima",
)
_SMOOTHED = ["hdd", "cdd", "total_hdd", "total_cdd", "adjusted_hdd", "adjusted_cdd"]
add(
    "smoothed_degree_days",
    lambda i: _cut(
        weather.smoothed_degree_days(_days(i), CONFIG.model_parameters).select(
            *_DAY, "num_days", *_SMOOTHED, "max_hdd", "max_cdd"
        ),
        *_SMOOTHED,
        "max_hdd",
        "max_cdd",
    ),
    f"SELECT {', '.join(_DAY)}, num_days, "
    + ", ".join(named(c) for c in [*_SMOOTHED, "max_hdd", "max_cdd"])
    + " FROM smoothed",
)
add(
    "adjusted_totals",
    lambda i: _cut(
        weather.adjusted_totals(
            weather.smoothed_degree_days(_days(i), CONFIG.model_parameters)
        ),
        "adjusted_total_hdd",
        "adjusted_total_cdd",
    ),
    f"SELECT {', '.join(_GROUP)}, {named('adjusted_total_hdd')}, {named('adjusted_total_cdd')} "
    "FROM adjusted_sums",
)
add_table(
    "temperature_multipliers",
    "temperature_multipliers",
    [*_DAY, "num_days"],
    [
        "bait",
        *_SMOOTHED,
        "heating_multiplier",
        "cooling_multiplier",
        "other_multiplier",
    ],
    "multipliers",
)

# Shapes and projection


def _base(i: Inputs) -> DataFrame:
    return shapes.base_shapes(i.load_shapes, None, YEARS)


_SHAPE = ["geography", "model_year", "month", "hour", "is_weekday", "sector", "enduse", "day_type"]
add(
    "shapes_base",
    lambda i: _cut(_base(i).select(*_SHAPE, "load_shape_value"), "load_shape_value"),
    f"SELECT {', '.join(_SHAPE)}, {named('load_shape_value')} FROM shapes",
)
add(
    "enduse_map",
    lambda i: shapes.enduse_kinds(_base(i)),
    "SELECT DISTINCT enduse, CASE WHEN enduse IN ('heating', 'cooling') THEN enduse "
    "ELSE 'other' END AS multiplier_type FROM shapes",
)
_HOURLY = ["load_shape_value", "multiplier", "adjusted_value"]
add(
    "shapes_expanded",
    lambda i: _cut(
        i.project.calculated_table("baseline", "load_shapes_expanded"), *_HOURLY, digits=6
    ),
    'SELECT geography, model_year, sector, enduse, "timestamp", weather_year, '
    + ", ".join(named(c, 6) for c in _HOURLY)
    + " FROM hours",
)
_SECTOR = ["geography", "model_year", "sector"]


def _totals(i: Inputs) -> DataFrame:
    return i.project.catalog.scenario("baseline").shape_totals(_MODELLED)


add(
    "shape_totals",
    lambda i: _cut(_totals(i), "load_shape_annual_total"),
    f"SELECT {', '.join(_SECTOR)}, {named('load_shape_annual_total')} FROM totals",
)
_MWH = f"SELECT {', '.join(_SECTOR)}, subsector, {named('annual_mwh')} FROM "
add(
    "annual_mwh",
    lambda i: _cut(i.project.catalog.scenario("baseline").annual_all(), "annual_mwh"),
    _MWH + "mwh",
)
add(
    "annual_with_ev",
    lambda i: _cut(
        replace_road_energy(
            annual_mwh(
                i.project.calculated_table("baseline", f"{_CIT}_gdp_applied_regression")
            ),
            i.project.calculated_table("ev_projection", "ev_annual_energy_tj"),
        ),
        "annual_mwh",
    ),
    _MWH + "mwh_ev WHERE sector <> 'Residential'",
)


def _factors(project: Project, scenario: str) -> DataFrame:
    tables = project.catalog.scenario(scenario)
    return scaling_factors(tables.shape_totals(_MODELLED), tables.annual_all())


for _key, _scenario, _suffix in (
    ("scaling_factors", "baseline", ""),
    ("scaling_factors_alternate", "alternate_gdp", "_alt"),
    ("scaling_factors_ev", "ev_projection", "_ev"),
):
    add(
        _key,
        lambda i, s=_scenario: _cut(_factors(i.settled.project, s), "scaling_factor"),
        f"SELECT {', '.join(_SECTOR)}, {named('scaling_factor')} FROM factors{_suffix}",
    )
_PROJECTED = 'SELECT "timestamp", model_year, geography, sector, metric, ' + named("value", 6)
add(
    "projection_cit",
    lambda i: _cut(
        i.settled.project.calculated_table(
            "ev_projection", "energy_projection_com_ind_tra_load_shapes"
        ),
        "value",
        digits=6,
    ),
    _PROJECTED + " FROM projection_ev WHERE sector <> 'Residential'",
)
add(
    "projection_res",
    lambda i: _cut(
        i.settled.project.calculated_table("baseline", "energy_projection_res_load_shapes"),
        "value",
        digits=6,
    ),
    _PROJECTED + " FROM projection WHERE sector = 'Residential'",
)
add(
    "energy_projection",
    lambda i: _cut(
        i.settled.project.calculated_table("alternate_gdp", "energy_projection"),
        "value",
        digits=6,
    ),
    _PROJECTED + ", 'alternate_gdp' AS scenario FROM projection_alt",
)
add(
    "flagship",
    lambda i: _consumption(i.settled.project.prepared_projection()),
    _CONSUMPTION_SQL.format("projections"),
)
add(
    "flagship_peak",
    lambda i: _cut(annual.peak(i.settled.project.prepared_projection(), Scope()), "value"),
    f"SELECT scenario, geography, year, {cut('MAX(total)')} AS value FROM (SELECT scenario, "
    'geography, model_year AS year, "timestamp", SUM(value) AS total FROM projections '
    "GROUP BY ALL) GROUP BY scenario, geography, year",
)

# Queries over a projection. The month projection holds whole numbers, so sums are exact.

_MONTH = "month_projection"
add(
    "unique_sectors",
    lambda i: listing.unique_values(i.month_projection, "sector", "all"),
    f"SELECT DISTINCT sector FROM {_MONTH}",
)
add(
    "unique_end_uses",
    lambda i: listing.unique_values(i.month_projection, "metric", "all"),
    f"SELECT DISTINCT metric FROM {_MONTH}",
)
add(
    "years",
    lambda i: listing.unique_values(i.month_projection, "model_year", "all"),
    f"SELECT DISTINCT model_year FROM {_MONTH}",
)
_CONFIGURED = ["high_growth", "not_in_data", "baseline"]
add(
    "scenarios",
    lambda i: listing.scenarios_in_order(i.month_projection, _CONFIGURED, "all").select("scenario"),
    f"SELECT DISTINCT scenario FROM {_MONTH}",
)
add(
    "scenario_order",
    lambda i: listing.scenarios_in_order(i.month_projection, _CONFIGURED, "all"),
    "SELECT scenario, CAST(CASE scenario WHEN 'high_growth' THEN 0 ELSE 2 END AS BIGINT) AS rank "
    f"FROM (SELECT DISTINCT scenario FROM {_MONTH})",
)

for _key, _group, _column in (
    ("", None, ""),
    ("_by_sector", "Sector", ", sector"),
    ("_by_end_use", "End Use", ", metric"),
):
    add(
        f"annual_consumption{_key}",
        lambda i, g=_group: annual.consumption(i.month_projection, ALL, g),
        f"SELECT scenario, model_year AS year{_column}, SUM(value) AS value FROM {_MONTH} "
        "GROUP BY ALL",
    )
_HOURS = (
    '(SELECT scenario, model_year AS year, "timestamp", SUM(value) AS total '
    f"FROM {_MONTH} GROUP BY ALL)"
)
add(
    "annual_peak",
    lambda i: annual.peak(i.month_projection, ALL),
    f"SELECT scenario, year, MAX(total) AS value FROM {_HOURS} GROUP BY ALL",
)
for _key, _group, _column in (
    ("peak_by_sector", "Sector", "sector"),
    ("peak_by_end_use", "End Use", "metric"),
):
    add(
        _key,
        lambda i, g=_group: annual.peak_breakdown(i.month_projection, ALL, g),
        f"SELECT p.scenario, model_year AS year, {_column}, value FROM {_MONTH} p JOIN "
        f"(SELECT * FROM {_HOURS} QUALIFY row_number() OVER (PARTITION BY scenario, year "
        'ORDER BY total DESC, "timestamp") = 1) h ON h.scenario = p.scenario '
        'AND h.year = p.model_year AND h."timestamp" = p."timestamp"',
    )


def add_secondary(key: str, metric: str, relation: str) -> None:
    add(
        key,
        lambda i: _cut(
            secondary.secondary_metric(
                i.project.catalog.scenario("alternate_gdp").table, metric, YEARS, "EUROPE"
            ),
            "value",
        ),
        f"SELECT model_year AS year, {named('value')} FROM {relation} WHERE geography = 'EUROPE'",
    )


add_secondary("secondary_gdp", "GDP", "gdp_alt")
add_secondary("secondary_hdi", "Human Development Index", "hdi")
add_secondary("secondary_population", "Population", "population")
add_secondary(
    "gdp_per_capita",
    "GDP Per Capita",
    "(SELECT geography, model_year, g.value * 1e9 / p.value AS value FROM gdp_alt g "
    "JOIN population p USING (geography, model_year))",
)
add(
    "secondary_multi",
    lambda i: _cut(
        secondary.secondary_of_scenarios(
            {s: i.project.catalog.scenario(s).table for s in ("baseline", "alternate_gdp")}, "GDP"
        ),
        "value",
    ),
    f"SELECT 'baseline' AS scenario, geography, model_year AS year, {named('value')} FROM gdp "
    f"UNION ALL SELECT 'alternate_gdp', geography, model_year, {cut('value')} FROM gdp_alt",
)


def _duration_sql(series_column: str, values: dict[str, str], where: str) -> str:
    """Each column sorted by itself; the row count is that of the hours."""
    curves = ", ".join(
        f"list_sort(list(s{n}), 'DESC', 'NULLS LAST') AS l{n}" for n in range(len(values))
    )
    wide = ", ".join(
        f"SUM(value) FILTER ({series_column} = {literal}) AS s{n}"
        for n, literal in enumerate(values.values())
    )
    columns = ", ".join(f'l{n}[r + 1] AS "{name}"' for n, name in enumerate(values))
    return (
        f"SELECT r AS rank, {columns} FROM (SELECT {curves}, COUNT(*) AS n FROM "
        f'(SELECT "timestamp", {wide} FROM {_MONTH} WHERE {where} GROUP BY "timestamp")), '
        "LATERAL (SELECT unnest(range(n)) AS r)"
    )


add(
    "ldc_scenarios",
    lambda i: duration.load_duration(
        i.month_projection, Scope("all", ORDER, [2025]), "scenario", ORDER
    ),
    _duration_sql("scenario", {s: f"'{s}'" for s in ORDER}, "model_year = 2025"),
)
add(
    "ldc_years",
    lambda i: duration.load_duration(
        i.month_projection, Scope("all", ["baseline"], YEARS), "year", YEARS
    ),
    _duration_sql("model_year", {str(y): str(y) for y in YEARS}, "scenario = 'baseline'"),
)

# Weather series

_WEATHER_SQL = {
    series.HOURLY: 'SELECT geography, "timestamp" AS datetime, {} FROM days',
    series.DAILY_MEAN: "SELECT geography, date_trunc('day', \"timestamp\") AS datetime, {} "
    "FROM days GROUP BY ALL",
    series.WEEKLY_MEAN: 'SELECT geography, MIN("timestamp") AS datetime, {} FROM days '
    'GROUP BY geography, (dayofyear("timestamp") - 1) // 7',
}
for _key, _resample, _sql_value in (
    ("weather_hourly", series.HOURLY, f"{cut('hdd')} AS value"),
    ("weather_daily_mean", series.DAILY_MEAN, f"{cut('AVG(hdd)')} AS value"),
    ("weather_weekly_mean", series.WEEKLY_MEAN, f"{cut('AVG(hdd)')} AS value"),
):
    add(
        _key,
        lambda i, r=_resample: _cut(
            weather_queries.weather_series(_days(i), "HDD", r), "value"
        ),
        _WEATHER_SQL[_resample].format(_sql_value),
    )
add(
    "weather_overlay",
    lambda i: _cut(
        weather_queries.weather_overlay(_days(i), "Temperature", series.HOURLY), "value"
    ),
    'SELECT geography, "timestamp" AS datetime, CAST(row_number() OVER (PARTITION BY geography '
    f'ORDER BY "timestamp", h) AS BIGINT) AS time_period, {cut("temperature")} AS value '
    "FROM days, range(24) AS r(h)",
)

# Time series

_NUMBER = (
    "row_number() OVER (PARTITION BY scenario, model_year ORDER BY \"timestamp\", sector, metric)"
)
add(
    "ts_hourly",
    lambda i: series.comparison(i.month_projection, BASE, None, series.HOURLY),
    "SELECT scenario, year, CAST(row_number() OVER (PARTITION BY scenario, year "
    f'ORDER BY "timestamp") AS BIGINT) AS time_period, total AS value FROM {_HOURS} '
    "WHERE scenario = 'baseline'",
)
for _key, _group, _column in (
    ("", None, ""),
    ("_by_sector", "Sector", "sector, "),
    ("_by_end_use", "End Use", "metric, "),
):
    if _group:
        add(
            f"ts_hourly{_key}",
            lambda i, g=_group: series.comparison(i.month_projection, BASE, g, series.HOURLY),
            f"SELECT scenario, model_year AS year, CAST({_NUMBER} AS BIGINT) AS time_period, "
            f"{_column} value FROM {_MONTH} WHERE scenario = 'baseline'",
        )
        add(
            f"ts_hour_of_year{_key}",
            lambda i, g=_group: series.comparison(
                i.month_projection, BASE, g, series.HOURLY, hour_of_year=True
            ),
            "SELECT scenario, model_year AS year, CAST(dense_rank() OVER (PARTITION BY scenario, "
            f'model_year ORDER BY "timestamp") AS BIGINT) AS time_period, {_column} value '
            f"FROM {_MONTH} WHERE scenario = 'baseline'",
        )
    for _name, _resample, _period in (
        ("daily", series.DAILY_MEAN, 'dayofyear("timestamp") + 1'),
        ("weekly", series.WEEKLY_MEAN, '(dayofyear("timestamp") - 1) // 7 + 1'),
    ):
        add(
            f"ts_{_name}{_key}",
            lambda i, g=_group, r=_resample: _cut(
                series.comparison(i.year_projection, BASE, g, r), "value"
            ),
            f"SELECT scenario, model_year AS year, CAST({_period} AS BIGINT) AS time_period, "
            f"{_column} {cut('AVG(value)')} AS value FROM year_projection "
            "WHERE scenario = 'baseline' GROUP BY ALL",
        )
add(
    "ts_daily_totals_first",
    lambda i: _cut(
        series.comparison(i.year_projection, BASE, None, series.DAILY_MEAN, totals_first=True),
        "value",
    ),
    'SELECT scenario, year, CAST(dayofyear("timestamp") + 1 AS BIGINT) AS time_period, '
    f"{cut('AVG(total)')} AS value FROM (SELECT scenario, model_year AS year, \"timestamp\", "
    "SUM(value) AS total FROM year_projection WHERE scenario = 'baseline' GROUP BY ALL) "
    "GROUP BY ALL",
)

# Typical days

_SEASON = (
    'CASE WHEN doy BETWEEN 79 AND 150 THEN \'Spring\' WHEN doy BETWEEN 151 AND 233 THEN '
    "'Summer' WHEN doy BETWEEN 234 AND 323 THEN 'Fall' ELSE 'Winter' END"
)
_KIND = "CASE WHEN isodow(\"timestamp\") > 5 THEN 'Weekend' ELSE 'Weekday' END"
_STAMPS = '(SELECT *, CAST(dayofyear("timestamp") AS BIGINT) AS doy FROM year_projection)'
add(
    "season",
    lambda i: i.year_projection.select(
        day_of_year(F.col("timestamp")).alias("doy"), "value"
    )
    .groupBy("doy", season(F.col("doy")).alias("season"))
    .agg(F.sum("value").alias("value")),
    f"SELECT doy, {_SEASON} AS season, SUM(value) AS value FROM {_STAMPS} GROUP BY ALL",
)
add(
    "day_type_query",
    lambda i: i.year_projection.groupBy(
        day_kind(F.col("timestamp"), QUERY_WEEKEND, "Weekend", "Weekday").alias("day_type")
    ).agg(F.sum("value").alias("value")),
    f"SELECT {_KIND} AS day_type, SUM(value) AS value FROM year_projection GROUP BY ALL",
)


def add_profile(
    key: str, group: str, agg: str, function: str, breakdown: str | None, years: list[int] | None
) -> None:
    parts = []
    if "Seasonal" in group:
        parts.append(f"{_SEASON} AS season")
    if "Weekday" in group:
        parts.append(f"{_KIND} AS day_type")
    if breakdown:
        parts.append("metric" if breakdown == "End Use" else "sector")
    inner = "".join(f", {p}" for p in parts)
    outer = "".join(f", {p.split(' AS ')[-1]}" for p in parts)
    where = "scenario = 'baseline'" + (f" AND model_year IN {tuple(years + [0])}" if years else "")
    scope = Scope("all", ["baseline"], years, ORDER)
    add(
        key,
        lambda i: _cut(
            seasonal.profile(i.year_projection, scope, group, agg, breakdown), "value"
        ),
        f"SELECT scenario, year{outer}, hour_of_day, {cut(f'{function}(total)')} AS value FROM "
        f"(SELECT scenario, model_year AS year{inner}, doy, "
        'CAST(hour("timestamp") AS BIGINT) AS hour_of_day, SUM(value) AS total '
        f"FROM {_STAMPS} WHERE {where} GROUP BY ALL) GROUP BY ALL",
    )


_AGGREGATES = (
    ("avg", "Average Day", "AVG"),
    ("peak", "Peak Day", "MAX"),
    ("min", "Minimum Day", "MIN"),
    ("median", "Median Day", "MEDIAN"),
)
for _short, _group in (
    ("seasonal", "Seasonal"),
    ("daytype", "Weekday/Weekend"),
    ("both", "Seasonal and Weekday/Weekend"),
):
    for _tail, _agg, _function in _AGGREGATES:
        add_profile(f"seasonal_lines_{_short}_{_tail}", _group, _agg, _function, None, None)
add_profile("seasonal_area", "Seasonal", "Average Day", "AVG", None, [1998])
add_profile("seasonal_area_by_sector", "Seasonal", "Average Day", "AVG", "Sector", [1998])
add_profile(
    "seasonal_area_by_end_use",
    "Seasonal and Weekday/Weekend",
    "Peak Day",
    "MAX",
    "End Use",
    [1998],
)

# Indicators

_YEARLY = (
    "(SELECT scenario, year, SUM(total) AS consumption, MAX(total) AS peak, "
    f"MIN(year) OVER (PARTITION BY scenario) AS first FROM {_HOURS} GROUP BY scenario, year)"
)
_WITH_START = (
    f"(SELECT y.*, s.consumption AS c0, s.peak AS p0 FROM {_YEARLY} y JOIN {_YEARLY} s "
    "ON s.scenario = y.scenario AND s.year = y.first)"
)
add(
    "scenario_summary",
    lambda i: _cut(annual.summary(i.month_projection, ALL), "percent_growth"),
    "SELECT scenario, year, consumption AS total_consumption, "
    f"{cut('((consumption - c0) * 100 / c0)')} AS percent_growth, peak AS peak_demand "
    f"FROM {_WITH_START}",
)


def _rate(end: str, start: str) -> str:
    growth = f"((pow({end} / {start}, 1e0 / (year - first)) - 1) * 100)"
    return f"CASE WHEN year <> first AND {start} > 0 AND {end} > 0 THEN {cut(growth, 6)} END"


add(
    "kpi_cagr",
    lambda i: _cut(
        annual.growth_indicators(i.month_projection, ALL),
        "consumption_cagr",
        "peak_cagr",
        digits=6,
    ),
    f"SELECT scenario, year, consumption, {_rate('consumption', 'c0')} AS consumption_cagr, "
    f"peak, {_rate('peak', 'p0')} AS peak_cagr FROM {_WITH_START}",
)
add(
    "stacked_max",
    lambda i: annual.stacked_maximum(i.month_projection, ALL, "Sector"),
    "SELECT MAX(value) AS max_value FROM (SELECT model_year, sector, SUM(value) AS value "
    f"FROM {_MONTH} GROUP BY ALL)",
)
add(
    "scenario_diff",
    lambda i: _cut(
        annual.difference(i.month_projection, ALL, "baseline", "high_growth"), "pct_difference"
    ),
    "SELECT b.model_year AS year, b.v AS value_base, o.v AS value_other, o.v - b.v AS difference, "
    f"{cut('((o.v - b.v) * 100 / b.v)')} AS pct_difference FROM "
    f"(SELECT model_year, SUM(value) AS v FROM {_MONTH} WHERE scenario = 'baseline' GROUP BY ALL) "
    f"b JOIN (SELECT model_year, SUM(value) AS v FROM {_MONTH} WHERE scenario = 'high_growth' "
    "GROUP BY ALL) o USING (model_year)",
)
add(
    "ts_hourly_null_hour",
    # The first hour of the month is unknown in every row; its rows come first.
    lambda i: series.comparison(
        i.month_projection.withColumn(
            "timestamp",
            F.when(F.col("timestamp") >= F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), F.col("timestamp")),
        ),
        BASE,
        "Sector",
        series.HOURLY,
    ),
    "SELECT scenario, model_year AS year, sector, value, ROW_NUMBER() OVER (PARTITION BY model_year "
    'ORDER BY CASE WHEN "timestamp" >= TIMESTAMP \'2024-01-01 01:00:00\' THEN "timestamp" END NULLS FIRST, '
    f"sector, metric, value) AS time_period FROM {_MONTH} WHERE scenario = 'baseline'",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Inputs(spark, sf_dir))

    return {key: bind(query) for key, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
