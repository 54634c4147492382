"""Query client: the methods users call, over a project and its projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from kilocast.plans.project import Project
from kilocast.queries import annual, duration, listing, seasonal, secondary, series, weather
from kilocast.queries.scope import Scope


# Rows of a table with one for each scenario, year and country that are sent to all tasks.
FEW_KEYS = 100_000


def _as_list(years: int | Sequence[int]) -> list[int]:
    return [years] if isinstance(years, int) else list(years)


class ProjectionClient:
    """Answers with lazy DataFrames; scenario and year names are checked on the driver.

    Without ``geography`` all countries are answered at once, each with a
    ``geography`` column.
    """

    def __init__(
        self,
        project: Project,
        projection: DataFrame | None = None,
        geography: str | None = None,
    ) -> None:
        self.project = project
        self._given = projection
        self._read: tuple[int, DataFrame, DataFrame, DataFrame] | None = None
        countries = project.config.countries
        if geography is None and countries is not None and len(countries) == 1:
            geography = countries[0]
        self.geography = geography
        self._years: list[int] | None = None
        self._scenarios: list[str] | None = None
        self._few_keys: bool | None = None

    def _stored(self) -> tuple[int, DataFrame, DataFrame, DataFrame]:
        """Version, rows, sums by hour and sums by year of the project's result as it is now."""
        version = self.project.result_version
        if self._read is None or self._read[0] != version:
            self._read = (
                version,
                self.project.get_energy_projection(),
                self.project.get_hourly_sums(),
                self.project.get_annual_sums(),
            )
            self._years = self._scenarios = self._few_keys = None
        return self._read

    @property
    def projection(self) -> DataFrame:
        """The projection given, or the project's stored one as it is now."""
        return self._stored()[1] if self._given is None else self._given

    @property
    def _hours(self) -> DataFrame:
        """What queries read that need neither sectors nor end uses: stored sums by hour where there are any."""
        return self._stored()[2] if self._given is None else self._given

    @property
    def _sums(self) -> DataFrame:
        """What queries read that need no hours: stored sums by year, sector and end use where there are any."""
        return self._stored()[3] if self._given is None else self._given

    def _has_few_keys(self) -> bool:
        """Whether the result has at most ``FEW_KEYS`` scenarios, years and countries; counted once a version."""
        self._stored()
        if self._few_keys is None:
            self._few_keys = self.project.get_projection_keys().limit(FEW_KEYS + 1).count() <= FEW_KEYS
        return self._few_keys

    # What is there

    @property
    def years(self) -> list[int]:
        keys = self._sums
        if self._years is None:
            rows = listing.unique_values(keys, "model_year", self.geography).collect()
            self._years = [r[0] for r in rows]
            if self._years and not isinstance(self._years[0], int):
                raise TypeError("model_year must be an integer column")
        return self._years

    @property
    def scenarios(self) -> list[str]:
        keys = self._sums
        if self._scenarios is None:
            rows = listing.scenarios_in_order(
                keys, self.project.list_scenario_names(), self.geography
            ).collect()
            self._scenarios = [r["scenario"] for r in rows]
        return self._scenarios

    def refresh_metadata(self) -> None:
        self._years = self._scenarios = self._read = None

    def get_years(self) -> list[int]:
        return self.years

    def get_unique_sectors(self) -> list[str]:
        return [
            r[0] for r in listing.unique_values(self._sums, "sector", self.geography).collect()
        ]

    def get_unique_end_uses(self) -> list[str]:
        return [
            r[0] for r in listing.unique_values(self._sums, "metric", self.geography).collect()
        ]

    def _scope(self, scenarios: Sequence[str], years: Sequence[int]) -> Scope:
        bad = [s for s in scenarios if s not in self.scenarios]
        if bad:
            raise ValueError(f"no projection of scenarios {bad}; there are {self.scenarios}")
        bad_years = [y for y in years if y not in self.years]
        if bad_years:
            raise ValueError(f"no projection of years {bad_years}; there are {self.years}")
        return Scope(self.geography, list(scenarios), list(years), self.scenarios)

    def _or_all(
        self, scenarios: Sequence[str] | None, years: Sequence[int] | None
    ) -> Scope:
        return self._scope(
            self.scenarios if scenarios is None else scenarios,
            self.years if years is None else years,
        )

    # Annual figures

    def get_annual_electricity_consumption(
        self,
        scenarios: Sequence[str] | None = None,
        years: Sequence[int] | None = None,
        group_by: str | None = None,
    ) -> DataFrame:
        return annual.consumption(self._sums, self._or_all(scenarios, years), group_by)

    def get_annual_peak_demand(
        self,
        scenarios: Sequence[str] | None = None,
        years: Sequence[int] | None = None,
        group_by: str | None = None,
    ) -> DataFrame:
        scope = self._or_all(scenarios, years)
        if group_by is None:
            return annual.peak(self._hours, scope)
        if self._given is not None:
            return annual.peak_breakdown(self._given, scope, group_by)
        return annual.peak_breakdown(self.projection, scope, group_by, self._hours, self._has_few_keys())

    def get_scenario_summary(self, scenario: str, year: int) -> dict[str, float]:
        """Consumption, growth since the first year in percent, and peak, of one country."""
        if self.geography is None:
            raise ValueError("a summary is of one country: give the client a geography")
        self._scope([scenario], [year])
        scope = Scope(self.geography, [scenario], None, self.scenarios)
        row = annual.summary(self._hours, scope).filter(f"year = {int(year)}").first()
        if row is None:
            raise ValueError(f"scenario {scenario!r} has no projection of {year}")
        return {
            "TOTAL_CONSUMPTION": row["total_consumption"],
            "PERCENT_GROWTH": row["percent_growth"],
            "PEAK_DEMAND": row["peak_demand"],
        }

    def get_growth_indicators(self, scenario: str, start_year: int | None = None) -> DataFrame:
        scope = self._or_all([scenario], None)
        return annual.growth_indicators(self._hours, scope, start_year)

    def get_scenario_difference(self, base: str, other: str) -> DataFrame:
        return annual.difference(self._sums, self._or_all([base, other], None), base, other)

    # Curves and series

    def get_load_duration_curve(
        self,
        years: int | Sequence[int] | None = None,
        scenarios: Sequence[str] | None = None,
    ) -> DataFrame:
        wanted_years = self.years[:1] if years is None else _as_list(years)
        wanted = self.scenarios if scenarios is None else list(scenarios)
        if len(wanted_years) > 1 and len(wanted) > 1:
            raise ValueError("choose several years or several scenarios, not both")
        scope = self._scope(wanted, wanted_years)
        if len(wanted_years) > 1:
            return duration.load_duration(self._hours, scope, "year", wanted_years)
        in_order = [s for s in self.scenarios if s in wanted]
        return duration.load_duration(self._hours, scope, "scenario", in_order)

    def get_time_series_comparison(
        self,
        scenario: str,
        years: int | Sequence[int],
        group_by: str | None = None,
        resample: str = series.DAILY_MEAN,
        hour_of_year: bool = False,
        totals_first: bool = False,
    ) -> DataFrame:
        scope = self._scope([scenario], _as_list(years))
        # Hourly totals are all that these two need; the other means are over rows.
        totals = group_by is None and (resample == series.HOURLY or totals_first)
        return series.comparison(
            self._hours if totals else self.projection, scope, group_by, resample, hour_of_year, totals_first
        )

    def get_seasonal_load_lines(
        self,
        scenario: str,
        years: int | Sequence[int] | None = None,
        group_by: str = "Seasonal",
        agg: str = "Average Day",
    ) -> DataFrame:
        scope = self._scope([scenario], self.years if years is None else _as_list(years))
        return seasonal.profile(self._hours, scope, group_by, agg)

    def get_seasonal_load_area(
        self,
        scenario: str,
        year: int,
        group_by: str = "Seasonal",
        agg: str = "Average Day",
        breakdown: str | None = None,
    ) -> DataFrame:
        scope = self._scope([scenario], [year])
        rows = self._hours if breakdown is None else self.projection
        return seasonal.profile(rows, scope, group_by, agg, breakdown)

    # Beside the load

    def get_secondary_metric(
        self, scenario: str, metric: str, years: Sequence[int] | None = None
    ) -> DataFrame:
        scope = self._or_all([scenario], years)
        tables = self.project.catalog.scenario(scenario)
        return secondary.secondary_metric(tables.table, metric, scope.years, self.geography)

    def get_secondary_metric_of_scenarios(
        self, scenarios: Sequence[str], metric: str, years: Sequence[int] | None = None
    ) -> DataFrame:
        scope = self._or_all(scenarios, years)
        tables = {name: self.project.catalog.scenario(name).table for name in scenarios}
        return secondary.secondary_of_scenarios(tables, metric, scope.years, self.geography)

    def get_weather_metric(self, scenario: str, year: int, wvar: str, resample: str) -> DataFrame:
        """The weather year is fixed, so ``year`` is only checked."""
        self._scope([scenario], [year])
        days = self.project.calculated_table(scenario, "weather_degree_days")
        return weather.weather_series(days, wvar, resample, self.geography)

    def get_weather_overlay(self, scenario: str, wvar: str, resample: str) -> DataFrame:
        self._scope([scenario], [])
        days = self.project.calculated_table(scenario, "weather_degree_days")
        return weather.weather_overlay(days, wvar, resample, self.geography)
