"""Periodic runs of words, found by dyadic square catching.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(``LEAST``, ``TIMES`` * q) that no neighbouring word extends with
the same period.

1. *Catchers.* Every completed block of B = 1, 2, 4 ... words, at a multiple of
   B, is a catcher: it watches the B to 2B - 1 words after its start for the
   next copy of itself. A word that is appended completes one window of each
   size B, and the place of the window tells the one catcher that it concerns,
   so a word costs one comparison of hashes a level. A match at distance p says
   that the B words of the block equal those p words on, half of a square or
   more. A run with period p, B <= p < 2B, holds whole blocks and their copies,
   so none is missed.
2. *Merging.* Matches of neighbouring catchers at one distance are one stretch.
   Its ends lie inside the blocks next to it; suffix and prefix comparisons of
   halving length find them.
3. *Smallest period.* A stretch of at least four periods p whose smallest
   period is q < p is found at q with the same ends; of equal stretches the
   smallest period stays.

All words of a block of texts are appended in array operations, level by
level; a text takes part up to the level of a quarter of its length. Stretches
are compared byte by byte, so the result is exact. Nothing is shuffled; one
text is held by one task.

Defined results: a null or empty text, or one without words, has no words, no
runs and an empty collapsed text; every row is judged by itself, also repeated
rows and rows without id. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import Words, blocks, bytes_of, offsets_list, read

LEAST = 6
TIMES = 4


def _stretches(words: Words, doc: np.ndarray, at: np.ndarray, p: np.ndarray, size: int, long: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal stretches (document, first word, words that equal those p on, p) around matched blocks of ``size`` words."""
    order = np.lexsort((at, p, doc))
    doc, at, p = doc[order], at[order], p[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1]) | (at[1:] != at[:-1] + size)
    head = np.flatnonzero(new)
    covered = np.diff(np.append(head, len(at))) * size
    # What the ends can add at most decides whether a chain is looked at.
    some = covered + 2 * (size - 1) + p[head] >= np.maximum(LEAST, TIMES * p[head])
    head, covered = head[some], covered[some]
    doc, low, p = doc[head], at[head], p[head]
    high = low + covered
    base = words.first[doc]
    limit = long[doc] - p

    def same(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        return words.hashes(words.start[a], words.end[a + n - 1]) == words.hashes(words.start[b], words.end[b + n - 1])

    step = size // 2
    while step:
        can = np.flatnonzero(low >= step)
        x = base[can] + low[can] - step
        low[can[same(x, x + p[can], step)]] -= step
        can = np.flatnonzero(high + step <= limit)
        x = base[can] + high[can]
        high[can[same(x, x + p[can], step)]] += step
        step //= 2
    return doc, low, high - low, p


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a block of texts: document, start, length, period; ordered by these but for the length."""
    long = np.diff(words.first)
    at = np.arange(len(words.start)) - words.first[words.doc]
    place = np.arange(len(words.start))
    found, size = [], 1
    while True:
        # Texts that can hold a run of this level, and the windows that end in them.
        enough = long[words.doc[place]] >= max(LEAST, TIMES * size)
        place = place[enough]
        if not len(place):
            break
        whole = place[at[place] + size <= long[words.doc[place]]]
        key = np.zeros(len(words.start), np.uint64)
        key[whole] = words.hashes(words.start[whole], words.end[whole + size - 1])
        later = whole[at[whole] >= size]
        block = (at[later] // size - 1) * size
        hit = key[later] == key[words.first[words.doc[later]] + block]
        later, block = later[hit], block[hit]
        if len(later):
            found.append(_stretches(words, words.doc[later], block, at[later] - block, size, long))
        size *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    doc, start, equal, period = (np.concatenate(x) for x in zip(*found))
    length = equal + period
    keep = length >= np.maximum(LEAST, TIMES * period)
    doc, start, length, period = doc[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return _exact(words, doc[new], start[new], length[new], period[new])


def _exact(words: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same runs if their bytes agree; a clash of 64-bit hashes is an error, not a wrong run."""
    first = words.first[doc] + start
    last = first + length - 1
    a, b = words.start[first], words.end[last - period]
    c, d = words.start[first + period], words.end[last]
    data = words.data
    for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
        if data[p:q] != data[r:s]:
            raise ArithmeticError("two different passages have one 64-bit hash")
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def collapsed(words: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """Each text without the words of its runs after the first period, joined by single spaces."""
    change = np.zeros(len(words.start) + 1, np.int64)
    first = words.first[doc] + start
    np.add.at(change, first + period, 1)
    np.add.at(change, first + length, -1)
    stay = np.cumsum(change)[:-1] == 0
    touched = np.zeros(len(words.first) - 1, bool)
    touched[doc] = True
    out = []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if touched[i]:
            kept = a + np.flatnonzero(stay[a:b])
            out.append(b" ".join([words.data[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())]))
        else:
            out.append(words.data[words.start[a] : words.end[b - 1]] if b > a else b"")
    return out


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            words = Words([x or b"" for x in table.column("text").to_pylist()])
            doc, start, length, period = find_runs(words)
            counts = np.bincount(doc, minlength=table.num_rows)
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            lists = offsets_list(np.zeros(len(doc), np.int64), counts, pa.int64())
            out = pa.table(
                {
                    "doc_id": table.column("doc_id"),
                    "n_words": pa.array(np.diff(words.first), pa.int64()),
                    "runs": pa.ListArray.from_arrays(lists.offsets, values),
                    "collapsed": pa.array(collapsed(words, doc, start, length, period), pa.binary()),
                }
            )
            yield from out.to_batches()

    found = documents.select("doc_id", bytes_of("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_cycles(documents: DataFrame) -> DataFrame:
    """The query's texts: of every tenth document by crc32 the words from one place on repeat a part of themselves."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = documents.select("doc_id", "text", code.alias("h"), F.when(F.pmod(code, F.lit(10)) == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    place = F.when(n > 0, F.pmod(g, n))
    rows = rows.withColumns({"n": n, "g": g, "a": place})
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", F.lit(1) + F.floor(rest / (F.lit(3) + F.pmod("g", F.lit(8)))))

    def whole(x: Column) -> Column:
        return x.cast("int")

    cycle = F.slice("words", whole(F.col("a") + 1), whole(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(cycle, whole(F.ceil(rest / F.col("p"))))), 1, whole(rest))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), whole(F.col("a"))), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_cycles(read(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of the greatest exponent wins ties.
    best = F.reduce(
        "runs",
        F.try_element_at("runs", F.lit(1)),
        lambda top, x: F.when(x["length"] * top["period"] > top["length"] * x["period"], x).otherwise(top),
    )
    line = F.transform("runs", lambda x: F.format_string("%d,%d,%d\n", x["start"], x["length"], x["period"]))
    lines = F.array_join(line, "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
