"""The given tables seen as the library's inputs. ``oracles.py`` holds the same in SQL.

Every value comes from the given tables. Sums are rounded to the cent before
they are divided, so both engines divide the same numbers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast import ModelParameters, Project, ProjectConfig, Scenario
from kilocast.functions.calendar import add_hours, day_start, hour_start, month_of, year_of
from kilocast.plans.storage import pin

YEARS = [2025, 2030, 2035]
WEATHER_YEAR = 1998
SECTORS = {
    "MACHINERY": "Industry",
    "AUTOMOBILE": "Transport",
    "BUILDING": "Service",
    "HOUSEHOLD": "Residential",
}
CONFIG = ProjectConfig(
    project_id="given-tables",
    start_year=2025,
    end_year=2035,
    step_year=5,
    weather_year=WEATHER_YEAR,
    model_parameters=ModelParameters(heating_threshold=20.0, cooling_threshold=30.0),
    scenarios=(
        Scenario("baseline"),
        Scenario("alternate_gdp"),
        Scenario("ev_projection", use_ev_projection=True),
    ),
)


def _recode(column: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == old, new) for old, new in names.items()], column)


def _long(column: Column) -> Column:
    return column.cast("long")


# Aggregates of the given tables, which do not change while a session runs.
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def forget_stored() -> None:
    """Let the aggregates be computed again when they are next asked for."""
    _STORED.clear()


class Inputs:
    """One data directory; inputs are planned when first asked for.

    With ``settled`` the aggregates that many inputs are made from are written
    once, as data tables are in a real project, instead of being planned again
    in every place they are used.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, settled: bool = False) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._settled = settled
        self._given: dict[str, DataFrame] = {}

    def _settle(self, name: str, df: DataFrame) -> DataFrame:
        """The stored table of this name, one for each session and directory."""
        if not self._settled:
            return df
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = pin(df)
        return _STORED[key]

    @property
    def settled(self) -> Inputs:
        return Inputs(self.spark, self.sf_dir, settled=True)

    def given(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._given[name]

    # Projections

    @cached_property
    def month_projection(self) -> DataFrame:
        """Events as a month of hourly values, in hundredths so that every sum is exact."""
        user, event = F.col("user_id"), F.col("event_id")
        return (
            self.given("events")
            .groupBy(
                hour_start(F.col("ts")).alias("timestamp"),
                _long(2025 + 5 * (user % 3)).alias("model_year"),
                F.when(user % 2 == 0, "baseline").otherwise("high_growth").alias("scenario"),
                F.col("event_type").alias("sector"),
                F.lit("all").alias("geography"),
                F.concat(F.lit("k"), (event % 3).cast("string")).alias("metric"),
            )
            .agg(F.round(F.sum("value") * 100).alias("value"))
        )

    @cached_property
    def year_projection(self) -> DataFrame:
        """All line items as hourly values; each year of shipment is a model year."""
        day = day_start(F.col("l_shipdate"))
        return (
            self.given("lineitem")
            .groupBy(
                add_hours(day, F.col("l_orderkey") % 24).alias("timestamp"),
                year_of(F.col("l_shipdate")).alias("model_year"),
                F.when(F.col("l_linenumber") % 2 == 1, "baseline")
                .otherwise("high_growth")
                .alias("scenario"),
                F.col("l_returnflag").alias("sector"),
                F.lit("all").alias("geography"),
                F.col("l_linestatus").alias("metric"),
            )
            .agg(F.sum("l_quantity").alias("value"))
        )

    # Data tables

    @cached_property
    def places(self) -> DataFrame:
        return (
            self.given("nation")
            .join(self.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", F.col("r_name").alias("geography"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.given("customer").join(
            self.places, F.col("c_nationkey") == F.col("n_nationkey")
        )

    @cached_property
    def _orders(self) -> DataFrame:
        buyers = self.customers.select("c_custkey", "c_mktsegment", "geography")
        orders = self.given("orders").withColumn(
            "model_year", _long(2025 + 5 * (F.col("o_orderkey") % 3))
        )
        return orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def _order_years(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self._settle(
            "order_years",
            self._orders.groupBy("geography", "model_year").agg(
                F.round(F.sum("o_totalprice"), 2).alias("price"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(status == "F").alias("n_f"),
                F.count_if(status == "O").alias("n_o"),
                F.count_if(status == "P").alias("n_p"),
            ),
        )

    @cached_property
    def _customer_groups(self) -> DataFrame:
        return self._settle(
            "customer_groups",
            self.customers.groupBy(
                "geography", "c_mktsegment", (F.col("c_custkey") % 2).alias("parity")
            ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        )

    @cached_property
    def _customer_places(self) -> DataFrame:
        return self._customer_groups.groupBy("geography").agg(
            F.sum("n").alias("n"), F.round(F.sum("balance"), 2).alias("balance")
        )

    def _per_year(self, value: Column) -> DataFrame:
        return self._order_years.select("geography", "model_year", value.alias("value"))

    @cached_property
    def gdp(self) -> DataFrame:
        return self._per_year(F.col("price") / 1e9)

    @cached_property
    def alternate_gdp(self) -> DataFrame:
        growth = 1.0 + 0.25 * (F.col("model_year") - 2020) / 5.0
        return self.gdp.withColumn("value", F.col("value") * growth)

    @cached_property
    def hdi(self) -> DataFrame:
        return self._per_year(0.5 + 0.25 * F.col("n_o") / F.col("n"))

    @cached_property
    def population(self) -> DataFrame:
        people = F.col("n") * (1000 + 10 * (F.col("model_year") - 2025))
        years = F.explode(F.lit(YEARS).cast("array<bigint>")).alias("model_year")
        return self._customer_places.select("geography", "n", years).select(
            "geography", "model_year", people.cast("double").alias("value")
        )

    @cached_property
    def ev_share(self) -> DataFrame:
        return self._per_year(F.col("n_f") / F.col("n"))

    @cached_property
    def phev_share(self) -> DataFrame:
        return self._per_year(F.col("n_p") / F.col("n"))

    @cached_property
    def wh_per_km(self) -> DataFrame:
        return (
            self._order_years.withColumn("bev", 150.0 + 100.0 * F.col("n_f") / F.col("n"))
            .withColumn("phev", 200.0 + 100.0 * F.col("n_o") / F.col("n"))
            .unpivot(["geography", "model_year"], ["bev", "phev"], "subsector", "value")
            .select("geography", "subsector", "model_year", "value")
        )

    @cached_property
    def energy_intensity(self) -> DataFrame:
        """Coefficients by region, sector and subsector. One European
        series has an unknown form, and each series an unused parameter."""
        segment = F.col("c_mktsegment")
        sector = _recode(
            segment,
            {
                "MACHINERY": "Industrial",
                "AUTOMOBILE": "Transportation",
                "BUILDING": "Commercial",
                "HOUSEHOLD": "Residential",
            },
        )
        part = F.when(F.col("parity") == 0, "Road").otherwise("Other")
        base = self._customer_groups.select(
            "geography", sector.alias("sector"), part.alias("subsector"), "n", "balance"
        )
        form = (
            F.when(F.col("sector") == "Residential", "lin")
            .when(
                (F.col("geography") == "EUROPE")
                & (F.col("sector") == "Industrial")
                & (F.col("subsector") == "Other"),
                "log",
            )
            .otherwise("exp")
        )
        kind = F.when(F.col("sector") == "Residential", "res").otherwise("nonres")
        return (
            base.withColumn("a0", 0.5 + F.col("balance") / F.col("n") / 1e5)
            .withColumn("a1", F.lit(0.015625))
            .withColumn("t0", F.lit(2020.0))
            .withColumn("r2", F.lit(0.875))
            .unpivot(
                ["geography", "sector", "subsector"], ["a0", "a1", "t0", "r2"], "parameter", "value"
            )
            .select(
                "geography",
                "sector",
                "subsector",
                F.concat_ws("_", kind, F.col("parameter"), form).alias("metric"),
                "value",
            )
        )

    def _region_regression(self, a0: float, a1: float, form: str) -> DataFrame:
        return (
            self._customer_places.withColumn("a0", a0 + F.col("balance") / F.col("n") / 1e5)
            .withColumn("a1", F.lit(a1))
            .withColumn("t0", F.lit(2020.0))
            .unpivot(["geography"], ["a0", "a1", "t0"], "parameter", "value")
            .select("geography", F.concat("parameter", F.lit(f"_{form}")).alias("metric"), "value")
        )

    @cached_property
    def vehicle_per_capita(self) -> DataFrame:
        return self._region_regression(0.25, 0.001953125, "lin")

    @cached_property
    def km_per_vehicle(self) -> DataFrame:
        return self._region_regression(9.0, -0.0009765625, "exp")

    @cached_property
    def load_shapes(self) -> DataFrame:
        """Mean order value, per day of a year: a number off the decimal grid, so that
        results do not fall on rounding ties."""
        date = F.col("o_orderdate")
        priority = F.substring("o_orderpriority", 1, 1)
        metric = F.when(priority == "1", "heating").when(priority == "2", "cooling")
        return self._orders.groupBy(
            "geography",
            "model_year",
            month_of(date).alias("month"),
            _long(F.col("o_orderkey") % 24).alias("hour"),
            (F.weekday(date) < 5).alias("is_weekday"),
            _recode(F.col("c_mktsegment"), SECTORS).alias("sector"),
            metric.otherwise("other").alias("metric"),
        ).agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) / 365.25).alias("value"))

    @cached_property
    def weather_bait(self) -> DataFrame:
        """Quantity shipped per line as temperature, discount and tax as other variables."""
        sellers = self.given("supplier").join(
            self.places, F.col("s_nationkey") == F.col("n_nationkey")
        )
        n = F.count(F.lit(1))
        return (
            self.given("lineitem")
            .join(
                sellers.select("s_suppkey", "geography"), F.col("l_suppkey") == F.col("s_suppkey")
            )
            .groupBy("geography", day_start(F.col("l_shipdate")).alias("timestamp"))
            .agg(
                (F.sum("l_quantity") / n).alias("BAIT"),
                (F.round(F.sum("l_discount"), 2) * 100 / n).alias("Temperature"),
                (F.round(F.sum("l_tax"), 2) * 100 / n).alias("Humidity"),
                n.cast("double").alias("Solar_Radiation"),
                (F.sum("l_linenumber") / n).alias("Wind_Speed"),
                F.min("l_quantity").alias("Dew_Point"),
            )
            .unpivot(
                ["geography", "timestamp"],
                ["BAIT", "Temperature", "Humidity", "Solar_Radiation", "Wind_Speed", "Dew_Point"],
                "metric",
                "value",
            )
        )

    # Projects

    @cached_property
    def data(self) -> dict[str, DataFrame]:
        return {
            "energy_intensity": self.energy_intensity,
            "gdp": self.gdp,
            "hdi": self.hdi,
            "load_shapes": self.load_shapes,
            "population": self.population,
            "weather_bait": self.weather_bait,
            "electricity_per_vehicle_km_projections": self.wh_per_km,
            "ev_stock_share_projections": self.ev_share,
            "km_per_vehicle_year_regressions": self.km_per_vehicle,
            "phev_share_projections": self.phev_share,
            "vehicle_per_capita_regressions": self.vehicle_per_capita,
        }

    @property
    def project(self) -> Project:
        return Project(
            self.spark, CONFIG, self.data, {("alternate_gdp", "gdp"): self.alternate_gdp}
        )
