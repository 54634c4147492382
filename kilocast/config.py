"""Project configuration: plain frozen dataclasses, checked on construction."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from kilocast.errors import InvalidParameter
from kilocast.schemas import DATA_TABLES

BASELINE = "baseline"

# Fixed value: a catalog schema of this name always exists, so no scenario may use it.
RESERVED_SCENARIO_NAMES = ("default",)


@dataclass(frozen=True)
class Scenario:
    """A named variant; ``tables`` maps a data table name to the file that replaces it."""

    name: str
    use_ev_projection: bool = False
    tables: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name or self.name in RESERVED_SCENARIO_NAMES:
            raise InvalidParameter(f"{self.name!r} cannot name a scenario")
        unknown = sorted(set(self.tables) - set(DATA_TABLES))
        if unknown:
            raise InvalidParameter(f"scenario {self.name!r} replaces unknown tables {unknown}")


@dataclass(frozen=True)
class TableOverride:
    """A request to replace one calculated table of one scenario."""

    scenario: str
    table_name: str
    filename: str | None = None


@dataclass(frozen=True)
class ModelParameters:
    """The defaults are what users expect without a setting."""

    heating_threshold: float = 18.0
    cooling_threshold: float = 18.0
    enable_shoulder_month_smoothing: bool = True
    shoulder_month_smoothing_factor: float = 10.0


@dataclass(frozen=True)
class ProjectConfig:
    """What to project. ``countries`` of None means every geography in the tables.

    ``calculated_table_overrides`` are applied when a project is made from files.
    """

    project_id: str
    start_year: int
    end_year: int
    weather_year: int
    step_year: int = 1
    countries: tuple[str, ...] | None = None
    model_parameters: ModelParameters = ModelParameters()
    scenarios: tuple[Scenario, ...] = (Scenario(BASELINE),)
    calculated_table_overrides: tuple[TableOverride, ...] = ()

    def __post_init__(self) -> None:
        if not self.scenarios:
            raise InvalidParameter("a project needs at least one scenario")
        names = [s.name for s in self.scenarios]
        if len(set(names)) != len(names):
            raise InvalidParameter(f"scenario names repeat: {names}")
        if isinstance(self.countries, str):
            object.__setattr__(self, "countries", (self.countries,))

    def list_model_years(self) -> list[int]:
        return list(range(self.start_year, self.end_year + 1, self.step_year))

    def with_countries(self, *countries: str) -> ProjectConfig:
        return replace(self, countries=tuple(countries))
