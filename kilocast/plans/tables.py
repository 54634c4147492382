"""Resolution of a table name in a scenario: override, own data, baseline, or built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.config import BASELINE, ModelParameters, ProjectConfig, Scenario
from kilocast.errors import InvalidParameter
from kilocast.operators import projection, shapes
from kilocast.operators.intensity import NON_RESIDENTIAL, RESIDENTIAL, pick_sectors
from kilocast.plans.models import ANNUAL_NON_RESIDENTIAL, ANNUAL_RESIDENTIAL, MODELS

# Where the strict mode is on, overrides of these are shown but not used by other tables.
WEATHER_CHAIN = (
    "weather_bait_daily",
    "weather_degree_days",
    "weather_degree_days_grouped",
    "temperature_multipliers",
    "load_shapes_expanded",
)

# A projection under an override of one of these cannot share a plan with other scenarios.
_OUTCOMES = (
    "load_shapes_expanded",
    "energy_projection_com_ind_tra_load_shapes",
    "energy_projection_res_load_shapes",
    "energy_projection",
)

_MODELLED = (*NON_RESIDENTIAL, *RESIDENTIAL)


class Catalog:
    """Data tables and overrides of all scenarios of a project."""

    def __init__(
        self,
        config: ProjectConfig,
        data: Mapping[str, DataFrame],
        scenario_data: Mapping[tuple[str, str], DataFrame] | None = None,
        strict: bool = False,
    ) -> None:
        self.config = config
        self.strict = strict
        self._data = {(BASELINE, name): df for name, df in data.items()}
        self._data.update(scenario_data or {})
        self.overrides: dict[tuple[str, str], DataFrame] = {}
        self._scenarios: dict[str, ScenarioTables] = {}

    def scenario(self, name: str) -> ScenarioTables:
        if name not in self._scenarios:
            found = [s for s in self.config.scenarios if s.name == name]
            if not found:
                raise InvalidParameter(f"scenario {name!r} is not part of the project")
            self._scenarios[name] = ScenarioTables(self, found[0])
        return self._scenarios[name]

    def data(self, scenario: str, name: str) -> DataFrame:
        """The scenario's own table, else the baseline's."""
        for owner in (scenario, BASELINE):
            if (owner, name) in self._data:
                return self._data[owner, name]
        raise InvalidParameter(f"data table {name!r} is missing from the baseline")

    def replaces(self, scenario: str, name: str) -> bool:
        return scenario != BASELINE and (scenario, name) in self._data

    def put_override(self, scenario: str, name: str, df: DataFrame) -> None:
        self.overrides[scenario, name] = df
        self._scenarios.clear()

    def drop_override(self, scenario: str, name: str) -> None:
        del self.overrides[scenario, name]
        self._scenarios.clear()

    def forget_plans(self) -> None:
        self._scenarios.clear()

    def restore_overrides(self, overrides: Mapping[tuple[str, str], DataFrame]) -> None:
        """Put back the overrides of an earlier moment."""
        self.overrides = dict(overrides)
        self._scenarios.clear()

    def put_data(self, scenario: str, name: str, df: DataFrame) -> None:
        """Give a scenario another data table."""
        self._data[scenario, name] = df
        self._scenarios.clear()

    def differs(self, scenario: str, name: str) -> bool:
        """Whether the table of this scenario can differ from the baseline's."""
        if (scenario, name) in self.overrides or (BASELINE, name) in self.overrides:
            return True
        if name not in MODELS:
            return self.replaces(scenario, name)
        return any(self.differs(scenario, source) for source in MODELS[name].reads)


class ScenarioTables:
    """Lazy tables of one scenario; each is planned once."""

    def __init__(self, catalog: Catalog, scenario: Scenario) -> None:
        self.catalog = catalog
        self.scenario = scenario
        self._built: dict[str, DataFrame] = {}

    @property
    def countries(self) -> Sequence[str] | None:
        return self.catalog.config.countries

    @property
    def years(self) -> list[int]:
        return self.catalog.config.list_model_years()

    @property
    def weather_year(self) -> int:
        return self.catalog.config.weather_year

    @property
    def parameters(self) -> ModelParameters:
        return self.catalog.config.model_parameters

    def data(self, name: str) -> DataFrame:
        return self.catalog.data(self.scenario.name, name)

    def replaced(self, name: str) -> bool:
        """Whether other tables of this scenario see a user's version of ``name``."""
        if self.catalog.strict and name in WEATHER_CHAIN:
            return False
        return (self.scenario.name, name) in self.catalog.overrides

    def table(self, name: str) -> DataFrame:
        """The calculated table, as overridden by the user if it is."""
        if name not in MODELS:
            raise InvalidParameter(f"{name!r} is not a calculated table")
        override = self.catalog.overrides.get((self.scenario.name, name))
        return self._computed(name) if override is None else override

    def weather(self, name: str) -> DataFrame:
        """A table of the weather chain, for use by another calculated table."""
        return self.table(name) if self.replaced(name) else self._computed(name)

    def use_stored_multipliers(self, stored: DataFrame) -> None:
        self._built["temperature_multipliers"] = stored

    def _computed(self, name: str) -> DataFrame:
        if name not in self._built:
            baseline = self.catalog.scenario(BASELINE) if self._may_share(name) else self
            self._built[name] = (
                MODELS[name].build(self) if baseline is self else baseline._computed(name)
            )
        return self._built[name]

    def _may_share(self, name: str) -> bool:
        if self.scenario.name == BASELINE or name.startswith("energy_projection"):
            return False
        listed = any(s.name == BASELINE for s in self.catalog.config.scenarios)
        return listed and not self.catalog.differs(self.scenario.name, name)

    def base_shapes(self) -> DataFrame:
        return shapes.base_shapes(self.data("load_shapes"), self.countries, self.years)

    def annual_non_residential(self) -> DataFrame:
        """MWh of commerce, industry and transport, with vehicle-based road energy if asked."""
        annual = projection.annual_mwh(self.table(ANNUAL_NON_RESIDENTIAL))
        if not self.scenario.use_ev_projection:
            return annual
        return projection.replace_road_energy(annual, self.table("ev_annual_energy_tj"))

    def annual_residential(self) -> DataFrame:
        return projection.annual_mwh(self.table(ANNUAL_RESIDENTIAL))

    def annual_all(self) -> DataFrame:
        """MWh of all sectors; the two sides never share a sector, overrides included."""
        return pick_sectors(self.annual_non_residential(), NON_RESIDENTIAL).unionByName(
            pick_sectors(self.annual_residential(), RESIDENTIAL)
        )

    def shape_totals(self, sectors: Sequence[str]) -> DataFrame:
        """Adjusted shape energy per year and sector."""
        if self.replaced("load_shapes_expanded"):
            hourly = pick_sectors(self.table("load_shapes_expanded"), sectors)
            return shapes.expanded_totals(hourly)
        chosen = pick_sectors(self.base_shapes(), sectors)
        return shapes.annual_totals(chosen, self.weather("temperature_multipliers"))

    def sector_projection(self, sectors: Sequence[str], annual: DataFrame) -> DataFrame:
        factors = projection.scaling_factors(self.shape_totals(sectors), annual)
        if self.replaced("load_shapes_expanded"):
            hourly = pick_sectors(self.table("load_shapes_expanded"), sectors)
            return projection.project_expanded(hourly, factors)
        chosen = pick_sectors(self.base_shapes(), sectors)
        return projection.project_shapes(
            chosen, self.weather("temperature_multipliers"), factors
        )


def share_expansion(catalog: Catalog, names: Sequence[str]) -> list[list[str]]:
    """Group scenarios whose shapes and weather are the same.

    Their projections differ in scaling factors only, so one expansion serves
    the group. A scenario that overrides a projection or the expanded shapes
    stands alone, and is last.
    """
    groups: list[tuple[DataFrame, DataFrame, list[str]]] = []
    alone: list[list[str]] = []
    for name in names:
        if stands_alone(catalog, name):
            alone.append([name])
            continue
        tables = catalog.scenario(name)
        shape = tables.data("load_shapes")
        multipliers = tables.weather("temperature_multipliers")
        for known_shape, known_multipliers, members in groups:
            if known_shape is shape and known_multipliers is multipliers:
                members.append(name)
                break
        else:
            groups.append((shape, multipliers, [name]))
    return [members for _, _, members in groups] + alone


def stands_alone(catalog: Catalog, scenario: str) -> bool:
    return any((scenario, outcome) in catalog.overrides for outcome in _OUTCOMES)


def group_annual(catalog: Catalog, members: Sequence[str]) -> DataFrame:
    """Annual MWh of several scenarios, with a scenario column.

    Scenarios mostly share their annual tables; each distinct table is planned
    once and repeated for the scenarios that use it.
    """
    electric = [n for n in members if catalog.scenario(n).scenario.use_ev_projection]

    def shared(table: str, names: Sequence[str]) -> list[DataFrame]:
        users: list[tuple[DataFrame, list[str]]] = []
        for name in names:
            found = catalog.scenario(name).table(table)
            known = next((u for df, u in users if df is found), None)
            if known is None:
                users.append((found, [name]))
            else:
                known.append(name)
        return [
            projection.annual_mwh(df).withColumn("scenario", F.explode(F.lit(names)))
            for df, names in users
        ]

    parts = [
        pick_sectors(part, NON_RESIDENTIAL).filter(
            ~F.col("scenario").isin(*electric) | ~projection.is_road()
        )
        for part in shared(ANNUAL_NON_RESIDENTIAL, members)
    ]
    parts += shared("ev_annual_energy_tj", electric)
    parts += [pick_sectors(p, RESIDENTIAL) for p in shared(ANNUAL_RESIDENTIAL, members)]
    return reduce(DataFrame.unionByName, parts)


def group_factors(catalog: Catalog, members: Sequence[str]) -> DataFrame:
    """Scaling factors of scenarios that share shapes and weather, with a scenario column."""
    totals = catalog.scenario(members[0]).shape_totals(_MODELLED)
    return projection.scaling_factors(totals, group_annual(catalog, members))


def group_projection(
    catalog: Catalog,
    members: Sequence[str],
    files: int | None = None,
    factors: DataFrame | None = None,
) -> DataFrame:
    """Hourly projection of such scenarios in one expansion; ``files`` as in ``project_shapes``.

    ``factors`` are those of the group if they are known already, or a part of
    them: other scenarios and years are then left out.
    """
    if stands_alone(catalog, members[0]):
        return catalog.scenario(members[0]).table("energy_projection")
    factors = group_factors(catalog, members) if factors is None else factors
    shapes_, multipliers = group_shapes(catalog, members)
    hourly = projection.project_shapes(shapes_, multipliers, factors, files)
    return hourly.select(*projection.RESULT_COLUMNS)


def group_shapes(catalog: Catalog, members: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The representative rows and the multipliers that the scenarios share."""
    tables = catalog.scenario(members[0])
    return pick_sectors(tables.base_shapes(), _MODELLED), tables.weather("temperature_multipliers")
