"""Versions of a stored result: folders that never change, and one small manifest for each version.

A run writes its tables below ``<path>/<table>/run=<run>/scenario=.../model_year=...``.
A manifest, ``<path>/_versions/<number>.json``, names the run that holds each
scenario and year; the one with the highest number is the result. A run that
fails is named by no manifest, so the last version stays whole whatever has
failed, and a DataFrame that was read from a version goes on reading its
folders after later versions.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kilocast.errors import InvalidOperation
from kilocast.plans.storage import file_names, make_file, read_text, remove, subfolders

_MANIFESTS = "_versions"


@dataclass(frozen=True)
class Version:
    """``runs`` and ``prints`` hold, for each scenario and year, the run and a fingerprint of its content."""

    number: int
    runs: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    prints: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    #: What tells this manifest from another writer's of the same number.
    token: str = ""

    def years(self, scenario: str) -> list[int]:
        return sorted(int(y) for y in self.runs.get(scenario, {}))


class VersionStore:
    """The versions below one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def numbers(self) -> list[int]:
        names = file_names(self.spark, posixpath.join(self.path, _MANIFESTS))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The given version, or the latest one; None if there is none yet."""
        known = self.numbers()
        if number is None and not known:
            return None
        if number is not None and number not in known:
            raise InvalidOperation(f"there is no version {number} of the result; there are {known}")
        text = read_text(self.spark, self._manifest(known[-1] if number is None else number))
        return Version(**json.loads(text))

    def _manifest(self, number: int) -> str:
        return posixpath.join(self.path, _MANIFESTS, f"{number:08d}.json")

    def folder(self, table: str, run: str) -> str:
        return posixpath.join(self.path, table, f"run={run}")

    def new_run(self) -> str:
        return uuid.uuid4().hex

    def scenario_folders(self, table: str, run: str) -> dict[str, str]:
        """The folder of each scenario that a run has written, spelt as the writer spells its characters."""
        names = subfolders(self.spark, self.folder(table, run))
        return {unquote(n.removeprefix("scenario=")): posixpath.join(self.folder(table, run), n) for n in names if "=" in n}

    def written(self, table: str, run: str) -> dict[str, list[str]]:
        """The scenarios and years that a run has written of a table."""
        return {
            scenario: [n.removeprefix("model_year=") for n in subfolders(self.spark, folder)]
            for scenario, folder in self.scenario_folders(table, run).items()
        }

    def commit(
        self,
        base: Version | None,
        runs: Mapping[str, Mapping[str, str]],
        prints: Mapping[str, Mapping[str, str]],
    ) -> Version:
        """Make the next version after ``base``; a version that another writer made meanwhile is an error."""
        new = Version(1 if base is None else base.number + 1, runs, prints, uuid.uuid4().hex)
        path = self._manifest(new.number)
        taken = InvalidOperation(f"another writer has made version {new.number} of the result")
        if new.number in self.numbers():
            raise taken
        make_file(self.spark, path, json.dumps(asdict(new)))
        if self.version(new.number) != new:
            raise taken
        return new

    def read(self, version: Version, table: str, schema: StructType) -> DataFrame:
        """A table of a version; filters on scenario and year leave the other folders unread."""
        root = posixpath.join(self.path, table)
        runs = {run for years in version.runs.values() for run in years.values()}
        known = {run: self.scenario_folders(table, run) for run in runs}
        folders = [
            posixpath.join(known[run][scenario], f"model_year={year}")
            for scenario, years in version.runs.items()
            for year, run in years.items()
        ]
        reader = self.spark.read.schema(schema).option("basePath", root)
        return reader.parquet(*folders).select(*schema.fieldNames())

    def discard(self, run: str, tables: Iterable[str]) -> None:
        """Delete what a run has written."""
        for table in tables:
            remove(self.spark, self.folder(table, run))

    def keep_last(self, count: int, tables: Iterable[str]) -> None:
        """Delete older versions, and the runs that only they name; nothing that reads them may go on."""
        numbers = self.numbers()
        old, kept = numbers[:-count], [self.version(n) for n in numbers[-count:]]
        used = {run for v in kept for years in v.runs.values() for run in years.values()}
        for number in old:
            remove(self.spark, self._manifest(number))
        for table in tables:
            for name in subfolders(self.spark, posixpath.join(self.path, table)):
                if name.startswith("run=") and name.removeprefix("run=") not in used:
                    remove(self.spark, posixpath.join(self.path, table, name))
