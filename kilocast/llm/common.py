"""Helpers of the operators: stored tables, word buffers, hashes and bounded filters."""

from __future__ import annotations

import ctypes
import posixpath
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.plans.storage import fresh_path, remove, setting

BLOCK_BYTES = 2 << 20
#: Bytes whose letters are added up at a time.
SUMMED = 1 << 16
MASK = (1 << 64) - 1
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, of which executor and Python worker hold some beside their heaps; texts may be long.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    Spark deletes the shuffle files of the write with its end; otherwise they
    stay until the driver happens to collect its garbage.
    """
    path = fresh_path(df.sparkSession)
    rows = int(df.sparkSession.conf.get(_BATCH))
    with ExitStack() as stack:
        stack.enter_context(setting(df.sparkSession, _SHUFFLE_CLEANUP, "true"))
        stack.enter_context(setting(df.sparkSession, _BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)))
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables; only once all that is computed from them is stored itself."""
    for df in tables:
        for folder in {posixpath.dirname(file) for file in df.inputFiles()}:
            remove(df.sparkSession, folder)


def bytes_of(name: str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def fold(name: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo: the held-out folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + (1 << 16))

            def powers(base: int) -> np.ndarray:
                out = np.full(size, base, np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)

            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        return self.up, self.down

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


_POWERS = _Powers()
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def free_memory() -> None:
    """Give back what a task has left: Python workers live on after it, and other tasks want their memory."""
    _POWERS.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives its memory back at its end."""

    @wraps(run)
    def tidied(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            free_memory()

    return tidied


def byte_sums(buffer: np.ndarray, letters: np.ndarray = _LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes' letters before each place, and the factors that make them independent of the place."""
    up, down = _POWERS.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    for at in range(0, len(buffer), SUMMED):
        values = letters[buffer[at : at + SUMMED]]
        values *= up[at : at + len(values)]
        values[:1] += sums[at : at + 1]
        np.cumsum(values, dtype=np.uint64, out=sums[at + 1 : at + 1 + len(values)])
    return sums, down


def place_free(sums: np.ndarray, factors: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between the given places."""
    return mix((sums[end] - sums[start]) * factors[start])


def mixed_letters(of: np.ndarray) -> np.ndarray:
    """For every byte the letter of another that stands for it."""
    return _LETTERS[of]


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values. ``np.unique`` without counts puts them into a hash table first, which is slower."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


class Words:
    """The words of a block of texts in one buffer, joined by single spaces.

    ``start``, ``end`` and ``doc`` describe word i; ``first`` holds for each
    text the index of its first word (one entry more than texts). ``hashes``
    gives the 64-bit hash of any range of words of one text without a loop.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        parts = [b" ".join((t.lower() if lower else t).split()) for t in texts]
        self.data = b"\n".join(parts)
        buffer = np.frombuffer(self.data, np.uint8)
        cut = np.flatnonzero((buffer == 32) | (buffer == 10))
        start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(buffer)]])
        doc = np.concatenate([[0], np.cumsum(buffer[cut] == 10)])
        full = end > start
        self.start, self.end, self.doc = start[full], end[full], doc[full]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self._sums, self._down = byte_sums(buffer)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between the given positions."""
        return place_free(self._sums, self._down, start, end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words inside one text."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        return at, self.hashes(self.start[at], self.end[at + n - 1])


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches cut and joined to tables of about ``size`` bytes of text; one long text is a table of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(lengths):
            if held and total + lengths[at] > size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            fits = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size - total, side="right")))
            held.append(batch.slice(at, fits))
            total += int(lengths[at : at + fits].sum())
            at += fits
    if held:
        yield pa.Table.from_batches(held)


def offsets_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class IdFilter:
    """A Bloom filter of a fixed size over 64-bit keys, filled on the cluster.

    The size, a power of two, is a parameter and does not grow with the data: a fuller filter
    only lets more rows through to the exact join that follows.
    """

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame, column: str, bits: int = 1 << 23) -> IdFilter:
        spots = keys.select(F.pmod(F.col(column), F.lit(bits)).alias("spot")).union(
            keys.select(F.pmod(F.shiftrightunsigned(F.col(column), 24), F.lit(bits)).alias("spot"))
        )
        filled = (
            spots.where(F.col("spot").isNotNull())
            .groupBy(F.shiftright("spot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("held"))
        )
        words = np.zeros(bits // 64, np.int64)
        for word, held in filled.collect():  # at most bits / 64 rows
            words[word] = held
        return cls(bits, words.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be among those put in."""
        keys = keys.astype(np.int64)
        out = np.ones(len(keys), bool)
        for spot in (keys & (self.bits - 1), (keys.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (self.bits - 1)):
            out &= (self.words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def connected(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b): rows (node, comp), comp the smallest node.

    Alternates large-star and small-star steps; each round is stored in the
    shared folder. Stops when every edge points at a component's smallest node.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        # Small star: smaller neighbours and the node itself move to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stored(small)
        # Done when no node is both a child and a parent and each child has one parent.
        roots = now.select(F.col("b").alias("a")).distinct()
        open_ends = now.join(roots, "a", "left_semi").limit(1).count() + (
            now.groupBy("a").count().where("count > 1").limit(1).count()
        )
        discard(pairs)
        pairs = now
        if not open_ends:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of plain files on the storage that all executors share."""
    from pyarrow import fs

    folder = fresh_path(spark, f"-{name}")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def write_file(uri: str, parts: Iterable[bytes], attempt: int) -> None:
    """Write a file under another name and move it into place, so that a repeated task leaves one whole file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_output_stream(f"{path}.{attempt}.part") as out:
        for part in parts:
            out.write(part)
    system.move(f"{path}.{attempt}.part", path)


def read_file(uri: str, start: int = 0, length: int | None = None) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        if start < 0:
            start += file.size()
        return file.read_at(file.size() - start if length is None else length, start)
