"""Intermediate and result tables in the folder shared by all executors."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kilocast.errors import InvalidOperation


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A run inside one JVM (tests) may leave it unset and gets a temporary one;
    on a cluster, whose executors do not share local folders, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise InvalidOperation("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kilocast-"))
        folder = context.getCheckpointDir()
    return str(folder)


def fresh_path(spark: SparkSession, suffix: str = ".parquet") -> str:
    return posixpath.join(shared_folder(spark), f"table-{uuid.uuid4().hex}{suffix}")


def pin(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage at a table that survives lost executors. Its files tell
    Spark its size, from which it picks the joins.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; empty if there is none."""
    found, system = _path(spark, path)
    if not system.exists(found):
        return []
    return [s.getPath().getName() for s in system.listStatus(found) if s.isDirectory()]


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def move_only_file(spark: SparkSession, folder: str, suffix: str, target: str) -> None:
    """Put the one file with data of a written folder in the place of ``target``."""
    [name] = [n for n in file_names(spark, folder) if n.endswith(suffix) and not n.startswith((".", "_"))]
    source, system = _path(spark, posixpath.join(folder, name))
    place, _ = _path(spark, target)
    system.delete(place, True)
    if not system.rename(source, place):
        raise InvalidOperation(f"cannot move {name} to {target}")


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; empty if there is none."""
    found, system = _path(spark, path)
    if not system.exists(found):
        return []
    return [s.getPath().getName() for s in system.listStatus(found) if s.isFile()]


def read_text(spark: SparkSession, path: str) -> str:
    found, system = _path(spark, path)
    stream = system.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def make_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and move it into place, so that it is never seen in part."""
    target, system = _path(spark, path)
    system.mkdirs(target.getParent())
    draft, _ = _path(spark, posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}"))
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(draft, target):
        system.delete(draft, False)
        raise InvalidOperation(f"cannot write {path}")
