"""CSV and parquet files, chosen by suffix."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilocast.errors import InvalidOperation
from kilocast.plans.storage import exists, move_only_file, remove, setting, subfolders

YEAR_COLUMNS = ("model_year", "weather_year")


def _suffix(path: str) -> str:
    suffix = posixpath.splitext(str(path).rstrip("/"))[1]
    if suffix not in (".csv", ".parquet"):
        raise NotImplementedError(f"cannot tell a CSV or parquet file by {suffix!r}")
    return suffix


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read one CSV or parquet file, or a folder of them.

    ``schema`` types CSV columns by name, so their order in the file is free;
    without it types are inferred. Parquet files carry their own types. Folders
    named ``column=value`` give their columns back as the text they are, so that
    ids like ``001`` stay; ``schema`` types them, and years are numbers.
    """
    if _suffix(path) == ".parquet":
        named = any("=" in name for name in subfolders(spark, str(path)))
        if not named:
            return spark.read.option("recursiveFileLookup", True).parquet(str(path))
        with setting(spark, "spark.sql.sources.partitionColumnTypeInference.enabled", "false"):
            raw = spark.read.parquet(str(path))
        wanted = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
        wanted |= {name: T.LongType() for name in YEAR_COLUMNS if name not in wanted}
        inside = _folder_columns(spark, str(path))
        return raw.withColumns({c: F.col(c).cast(wanted[c]) for c in raw.columns if c in inside and c in wanted})
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(str(path))
    types = {f.name: f.dataType for f in schema.fields}
    raw = reader.csv(str(path))
    return raw.select(
        *[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns]
    )


def _folder_columns(spark: SparkSession, path: str) -> set[str]:
    """Columns that the names of the folders give, from one of the folders of each level."""
    found = set()
    while names := [n for n in subfolders(spark, path) if "=" in n]:
        found.add(names[0].split("=", 1)[0])
        path = posixpath.join(path, names[0])
    return found


def check_target(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Refuse a target that exists, or a suffix that says no format, before any work is done."""
    _suffix(path)
    if not overwrite and exists(spark, str(path)):
        raise InvalidOperation(f"{path} exists; ask for overwriting to replace it")


def write_table(df: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """Write a folder of part files; an existing target is an error unless ``overwrite``.

    ``single_file`` writes one file of that name in its place, which one task
    has to do; it is for tables that other programs are to read.
    """
    suffix = _suffix(path)
    target = str(path)
    spark = df.sparkSession
    if single_file:
        check_target(spark, target, overwrite)
        folder = f"{target.rstrip('/')}-{uuid.uuid4().hex}{suffix}"
        try:
            write_table(df.coalesce(1), folder)
            move_only_file(spark, folder, suffix, target)
        finally:
            remove(spark, folder)
        return
    writer = df.write.mode("overwrite" if overwrite else "error")
    if suffix == ".parquet":
        writer.parquet(target)
    else:
        writer.option("header", True).csv(target)


def cast_years(df: DataFrame) -> DataFrame:
    """Turn string year ids into BIGINT; other columns and types are left alone."""
    textual = [
        f.name
        for f in df.schema.fields
        if f.name in YEAR_COLUMNS and isinstance(f.dataType, T.StringType)
    ]
    return df.withColumns({name: F.col(name).cast("long") for name in textual})
