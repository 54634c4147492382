"""Mapping of dataset dimension ids to project ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilocast.errors import InvalidParameter

# Mapping types.
MANY_TO_ONE = "many_to_one_aggregation"
ONE_TO_ONE = "one_to_one"


def map_dimension(
    df: DataFrame, mapping: DataFrame, dimension: str, mapping_type: str = MANY_TO_ONE
) -> DataFrame:
    """Replace the ids of ``dimension`` by the mapping's ``to_id`` (columns from_id, to_id).

    Many-to-one adds up ``value`` over the ids that meet in one target, with
    partial sums before the shuffle. Ids meet as text and keep the column's
    type. Rows whose id is not mapped are left out (see ``mapping_problems``);
    a pair that is listed twice counts once.
    """
    if mapping_type not in (MANY_TO_ONE, ONE_TO_ONE):
        raise InvalidParameter(f"unknown mapping type {mapping_type!r}")
    kind = df.schema[dimension].dataType
    pairs = mapping.select(
        F.col("from_id").cast("string").alias("_from"), F.col("to_id").cast(kind).alias("_to")
    ).distinct()
    renamed = (
        df.join(pairs, F.col(dimension).cast("string") == F.col("_from"))
        .withColumn(dimension, F.col("_to"))
        .select(*df.columns)
    )
    if mapping_type == ONE_TO_ONE:
        return renamed
    keys = [c for c in df.columns if c != "value"]
    return renamed.groupBy(*keys).agg(F.sum("value").alias("value")).select(*df.columns)


def mapping_problems(df: DataFrame, mapping: DataFrame, dimension: str, mapping_type: str) -> DataFrame:
    """What is wrong with a mapping for a table: rows (problem, id), empty if nothing is.

    Ids of the mapping that the table does not have, ids of the table without a
    target, pairs listed twice, and ids with several targets in one-to-one.
    """
    pairs = mapping.select(F.col("from_id").cast("string").alias("id"), F.col("to_id").cast("string"))
    held = df.select(F.col(dimension).cast("string").alias("id")).distinct()
    named = pairs.select("id").distinct()

    def of(rows: DataFrame, problem: str) -> DataFrame:
        return rows.select(F.lit(problem).alias("problem"), "id")

    twice = pairs.groupBy("id", "to_id").count().where("count > 1")
    found = (
        of(named.join(held, "id", "left_anti"), "not in the table")
        .unionByName(of(held.where("id is not null").join(named, "id", "left_anti"), "without a target"))
        .unionByName(of(twice, "listed twice"))
    )
    if mapping_type == ONE_TO_ONE:
        several = pairs.distinct().groupBy("id").count().where("count > 1")
        found = found.unionByName(of(several, "with several targets"))
    return found
