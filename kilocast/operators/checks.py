"""Data checks. Each returns the offending rows; an empty result means the data pass."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilocast.functions.calendar import add_hours, microseconds

#: Steps of a series that one window looks at.
BLOCK = 4096


def unknown_mapping_ids(
    mapping: DataFrame, dataset_ids: DataFrame, project_ids: DataFrame
) -> DataFrame:
    """Ids named by a mapping that the dataset (from) or the project (to) does not have.

    ``dataset_ids`` and ``project_ids`` have one column, ``id``.
    """

    def missing(side: str, known: DataFrame) -> DataFrame:
        named = mapping.select(F.col(f"{side}_id").alias("id")).distinct()
        return named.join(known.select("id"), "id", "left_anti").select(
            F.lit(side).alias("side"), "id"
        )

    return missing("from", dataset_ids).unionByName(missing("to", project_ids))


def time_gaps(
    df: DataFrame,
    series: Sequence[str],
    step_hours: int,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Missing, misplaced and repeated timestamps of each series.

    All series must run from ``start`` to ``end`` (by default the earliest and
    latest timestamp of any series) in steps of ``step_hours``. The steps that
    are there are numbered; a number that does not follow the one before begins
    after a gap, and only gaps are spelt out. Numbers are compared inside blocks
    of ``BLOCK`` steps, then the ends of the blocks of a series with each other,
    so that a long series is spread over tasks.
    """
    columns = [*series, "timestamp"]
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    ts = F.col("timestamp")
    bounds = counts.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    origin = F.lit(start).cast("timestamp_ntz") if start else bounds.select("first").scalar()
    final = F.lit(end).cast("timestamp_ntz") if end else bounds.select("last").scalar()
    step = step_hours * 3_600_000_000
    past = microseconds(ts) - microseconds(origin)
    after_last = F.floor((microseconds(final) - microseconds(origin)) / step).cast("long") + 1
    number = F.when((past % step == 0) & (past >= 0) & (ts <= final), F.floor(past / step).cast("long"))
    placed = counts.withColumn("_step", number)

    issue = F.when(F.col("_step").isNull(), "misplaced").when(F.col("_rows") > 1, "duplicate")
    odd = placed.select(issue.alias("issue"), *columns).filter(F.col("issue").isNotNull())

    block = F.floor(F.col("_step") / BLOCK)
    steps = placed.filter(F.col("_step").isNotNull()).select(*series, "_step", block.alias("_block"))
    inside = Window.partitionBy(*series, "_block").orderBy("_step")
    inner = steps.select(*series, (F.lag("_step").over(inside) + 1).alias("_from"), (F.col("_step") - 1).alias("_to"))
    # Every series stands between a step before the first and one after the last.
    ends = steps.groupBy(*series, "_block").agg(F.min("_step").alias("_low"), F.max("_step").alias("_high"))
    known = counts.select(*series).distinct()
    for edge in (F.lit(-1).cast("long"), after_last):
        ends = ends.unionByName(known.select(*series, F.lit(None).cast("long").alias("_block"), edge.alias("_low"), edge.alias("_high")))
    along = Window.partitionBy(*series).orderBy("_low")
    outer = ends.select(*series, (F.lag("_high").over(along) + 1).alias("_from"), (F.col("_low") - 1).alias("_to"))
    gaps = inner.unionByName(outer).filter(F.col("_from") <= F.col("_to"))
    gaps = gaps.select(*series, F.explode(F.sequence("_from", "_to")).alias("_step"))
    at = add_hours(origin, F.col("_step") * step_hours).alias("timestamp")
    missing = gaps.select(F.lit("missing").alias("issue"), *series, at)
    return missing.unionByName(odd)


def association_gaps(
    df: DataFrame,
    records: DataFrame,
    others: Mapping[str, Sequence[str]],
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Dimension combinations that are missing from the data, or that no dimension knows.

    ``records`` holds the ids of the largest dimension in its only column; the
    ids of the other dimensions come from the project configuration. Rows of
    ``allowed`` are known to be missing and are not reported.

    Combinations of the other dimensions are numbered, and those that a record
    has are bits, 64 of them a row: the data shrink to such rows before they are
    compared, and only combinations that are missing are spelt out.
    """
    first = records.columns[0]
    dims = [first, *others]
    ids = {name: list(dict.fromkeys(values)) for name, values in others.items()}
    total = math.prod(len(values) for values in ids.values())
    number, strides, stride = F.lit(0).cast("long"), {}, total
    for name, values in ids.items():
        stride //= max(1, len(values))
        strides[name] = stride
        place = F.array_position(F.lit(values), F.col(name)) - 1 if values else F.lit(None).cast("long")
        number = number + F.when(place >= 0, place) * stride
    present = df.select(*dims).distinct().withColumn("_number", number)
    bit = F.expr("shiftleft(1L, cast(_number % 64 AS int))")
    held = (
        present.filter(F.col("_number").isNotNull())
        .groupBy(first, F.expr("_number div 64").alias("_word"))
        .agg(F.bit_or(bit).alias("_held"))
    )
    words = -(-total // 64)
    wanted = records.select(first).distinct()
    wanted = wanted.withColumn("_word", F.explode(F.lit(list(range(words))).cast("array<bigint>")))
    # All bits, but in the last row only as many as there are combinations left.
    rest = total % 64
    full = F.when(F.lit(rest > 0) & (F.col("_word") == words - 1), F.lit((1 << rest) - 1).cast("long")).otherwise(F.lit(-1).cast("long"))
    lacking = full.bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("long"))))
    gaps = wanted.join(held, [first, "_word"], "left").select(first, "_word", lacking.alias("_lacking")).filter("_lacking <> 0")
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("_lacking", b) == 1))
    gaps = gaps.select(first, "_word", at.alias("_bit")).select(first, (F.col("_word") * 64 + F.col("_bit")).alias("_number"))
    missing = gaps.select(
        first,
        *[
            F.element_at(F.lit(values), (F.floor(F.col("_number") / strides[name]) % len(values) + 1).cast("int")).alias(name)
            for name, values in ids.items()
        ],
    )
    if allowed is not None:
        missing = missing.join(allowed.select(*dims), dims, "left_anti")
    # An orphan has an id that its dimension does not list: no product is needed for it.
    known = records.select(first).distinct().withColumn("_known", F.lit(True))
    listed = F.col("_known").isNotNull() & F.col("_number").isNotNull()
    orphan = present.join(known, first, "left").filter(~listed).select(*dims)
    return missing.select(F.lit("missing").alias("issue"), *dims).unionByName(
        orphan.select(F.lit("orphan").alias("issue"), *dims)
    )
