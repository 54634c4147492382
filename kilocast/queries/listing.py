"""What a projection or a dimension contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.errors import InvalidParameter
from kilocast.queries.scope import Scope


def unique_values(projection: DataFrame, column: str, geography: str | None = None) -> DataFrame:
    """Sorted distinct sectors, end uses (``metric``), model years or scenarios."""
    rows = projection
    if geography is not None:
        rows = rows.filter(F.col("geography") == geography)
    return rows.select(column).distinct().orderBy(column)


def scenarios_in_order(
    projection: DataFrame, configured: Sequence[str], geography: str | None = None
) -> DataFrame:
    """Configured scenarios that have data, with their rank in the configuration."""
    ranked = unique_values(projection, "scenario", geography).filter(
        F.col("scenario").isin(*configured)
    )
    rank = Scope(scenario_order=configured).order()[1]
    return ranked.withColumn("rank", rank).orderBy("rank")


def valid_ids(table: DataFrame, dimension: str) -> DataFrame:
    """Distinct ids of a dimension of a data table."""
    return table.select(dimension).distinct().orderBy(dimension)


def matching_id(table: DataFrame, dimension: str, wanted: str) -> str:
    """The id as the data spell it, found without regard to case."""
    found = (
        table.filter(F.lower(F.col(dimension)) == wanted.lower()).select(dimension).take(1)
    )
    if not found:
        raise InvalidParameter(f"{wanted!r} is not among the ids of {dimension}")
    return found[0][0]
