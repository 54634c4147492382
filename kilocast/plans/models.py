"""The calculated tables: what each one reads and how it is built.

Names are those that users override and export. ``reads`` lists direct inputs,
which tells whether two scenarios can share a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from kilocast.functions.regression import pivot_coefficients
from kilocast.operators import drivers, intensity, projection, shapes, vehicles, weather

if TYPE_CHECKING:
    from kilocast.plans.tables import ScenarioTables


@dataclass(frozen=True)
class Model:
    reads: tuple[str, ...]
    build: Callable[[ScenarioTables], DataFrame]


def _driver(source: str, value_name: str = "value", extra: tuple[str, ...] = ()) -> Model:
    def build(t: ScenarioTables) -> DataFrame:
        return drivers.select_driver(t.data(source), t.countries, t.years, value_name, extra)

    return Model((source,), build)


def _pivot(source: str) -> Model:
    return Model((source,), lambda t: pivot_coefficients(t.table(source)))


def _attach(left: str, right: str, name: str, on: tuple[str, ...] = ("geography",)) -> Model:
    return Model(
        (left, right), lambda t: drivers.attach_driver(t.table(left), t.table(right), name, on)
    )


def _sectors(names: tuple[str, ...]) -> Model:
    source = "energy_intensity_parsed"
    return Model((source,), lambda t: intensity.pick_sectors(t.table(source), names))


def _vehicle_key(source: str) -> Model:
    return Model((source,), lambda t: vehicles.parse_vehicle_key(t.data(source), t.countries))


def _multipliers(t: ScenarioTables) -> DataFrame:
    name = "weather_degree_days_grouped"
    grouped = t.weather(name) if t.replaced(name) else None
    return weather.temperature_multipliers(
        t.weather("weather_degree_days"), t.parameters, grouped
    )


def _expanded(t: ScenarioTables) -> DataFrame:
    hourly = shapes.expand(t.base_shapes(), t.weather("temperature_multipliers"))
    return shapes.adjust(hourly)


# Table names, as users know them.
_CIT = "energy_intensity_com_ind_tra"
_RES = "energy_intensity_res"
ANNUAL_NON_RESIDENTIAL = "energy_intensity_com_ind_tra_gdp_applied_regression"
ANNUAL_RESIDENTIAL = "energy_intensity_res_hdi_population_applied_regression"
_PROJECTION_CIT = "energy_projection_com_ind_tra_load_shapes"
_PROJECTION_RES = "energy_projection_res_load_shapes"

MODELS: dict[str, Model] = {
    "gdp_country": _driver("gdp"),
    "hdi_country": _driver("hdi"),
    "population_country": _driver("population"),
    "energy_intensity_parsed": Model(
        ("energy_intensity",),
        lambda t: intensity.parse_intensity(t.data("energy_intensity"), t.countries),
    ),
    _CIT: _sectors(intensity.NON_RESIDENTIAL),
    _RES: _sectors(intensity.RESIDENTIAL),
    "energy_intensity_com_ind_tra_pivoted": _pivot(_CIT),
    "energy_intensity_res_pivoted": _pivot(_RES),
    "energy_intensity_com_ind_tra_gdp": _attach("energy_intensity_com_ind_tra_pivoted", "gdp_country", "gdp_value"),
    "energy_intensity_res_hdi": _attach("energy_intensity_res_pivoted", "hdi_country", "hdi_value"),
    "energy_intensity_res_hdi_population": _attach(
        "energy_intensity_res_hdi", "population_country", "population_value", ("geography", "model_year")
    ),
    ANNUAL_NON_RESIDENTIAL: Model(
        ("energy_intensity_com_ind_tra_gdp",), lambda t: intensity.annual_energy(t.table("energy_intensity_com_ind_tra_gdp"), "gdp_value")
    ),
    ANNUAL_RESIDENTIAL: Model(
        ("energy_intensity_res_hdi_population",),
        lambda t: intensity.annual_energy(
            t.table("energy_intensity_res_hdi_population"), "hdi_value", "population_value"
        ),
    ),
    "vehicle_per_capita_parsed": _vehicle_key("vehicle_per_capita_regressions"),
    "vehicle_per_capita_pivoted": _pivot("vehicle_per_capita_parsed"),
    "vehicle_per_capita_population": _attach(
        "vehicle_per_capita_pivoted", "population_country", "population_value"
    ),
    "vehicle_stock_total": Model(
        ("vehicle_per_capita_population",),
        lambda t: vehicles.vehicle_stock(t.table("vehicle_per_capita_population")),
    ),
    "ev_stock_share_country": _driver("ev_stock_share_projections", "ev_stock_share"),
    "ev_stock_total": Model(
        ("vehicle_stock_total", "ev_stock_share_country"),
        lambda t: vehicles.electric_stock(
            t.table("vehicle_stock_total"), t.table("ev_stock_share_country")
        ),
    ),
    "phev_share_country": _driver("phev_share_projections", "phev_share"),
    "ev_stock_split": Model(
        ("ev_stock_total", "phev_share_country"),
        lambda t: vehicles.split_stock(t.table("ev_stock_total"), t.table("phev_share_country")),
    ),
    "km_per_vehicle_year_parsed": _vehicle_key("km_per_vehicle_year_regressions"),
    "km_per_vehicle_year_pivoted": _pivot("km_per_vehicle_year_parsed"),
    "km_per_vehicle_year_applied": Model(
        ("km_per_vehicle_year_pivoted", "population_country"),
        lambda t: vehicles.distance_per_vehicle(
            t.table("km_per_vehicle_year_pivoted"), t.table("population_country")
        ),
    ),
    "electricity_per_vehicle_km_country": _driver(
        "electricity_per_vehicle_km_projections", "wh_per_km", ("subsector",)
    ),
    "ev_energy_by_type": Model(
        ("ev_stock_split", "km_per_vehicle_year_applied", "electricity_per_vehicle_km_country"),
        lambda t: vehicles.energy_by_type(
            t.table("ev_stock_split"),
            t.table("km_per_vehicle_year_applied"),
            t.table("electricity_per_vehicle_km_country"),
        ),
    ),
    "ev_annual_energy_tj": Model(
        ("ev_energy_by_type",),
        lambda t: vehicles.annual_vehicle_energy(t.table("ev_energy_by_type")),
    ),
    "weather_bait_daily": Model(
        ("weather_bait",),
        lambda t: weather.daily_weather(t.data("weather_bait"), t.countries, t.weather_year),
    ),
    "weather_degree_days": Model(
        ("weather_bait_daily",),
        lambda t: weather.degree_days(t.weather("weather_bait_daily"), t.parameters),
    ),
    "weather_degree_days_grouped": Model(
        ("weather_degree_days",),
        lambda t: weather.grouped_degree_days(t.weather("weather_degree_days")),
    ),
    "temperature_multipliers": Model(
        ("weather_degree_days", "weather_degree_days_grouped"), _multipliers
    ),
    "load_shapes_expanded": Model(("load_shapes", "temperature_multipliers"), _expanded),
    _PROJECTION_CIT: Model(
        ("load_shapes_expanded", ANNUAL_NON_RESIDENTIAL, "ev_annual_energy_tj"),
        lambda t: t.sector_projection(intensity.NON_RESIDENTIAL, t.annual_non_residential()),
    ),
    _PROJECTION_RES: Model(
        ("load_shapes_expanded", ANNUAL_RESIDENTIAL),
        lambda t: t.sector_projection(intensity.RESIDENTIAL, t.annual_residential()),
    ),
    "energy_projection": Model(
        (_PROJECTION_CIT, _PROJECTION_RES),
        lambda t: projection.tag_scenario(
            [t.table(_PROJECTION_CIT), t.table(_PROJECTION_RES)], t.scenario.name
        ),
    ),
}
