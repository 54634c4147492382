"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of a document. A word is removed when
a window that covers it also starts in a document with a smaller doc_id.

1. *Super-k-mers.* Each window is assigned the smallest hash of its runs of
   ``MINIMISER`` words. Consecutive windows with the same minimiser travel as
   one packed string, the words they span, to the bucket of that minimiser;
   so equal windows always meet in one bucket, and a word is sent about three
   times instead of ``width`` times. The strings of a block that go to one
   bucket are one compressed row.
2. *Before the shuffle* equal strings of a block are reduced to those of the
   block's smallest document: any other document with the string has met an
   earlier one already, and its windows are marked at once. A passage that a
   third of all documents share is sent once for each block.
3. *In the bucket* the windows are sorted by hash and document; each window of
   a document after the first is a repetition. Equal hashes are compared byte
   by byte, so the result is exact.
4. The marked windows of a document are joined to its text, which gives the
   kept words.

Windows do not cross documents and are judged on the input. Defined results:
a null or empty text has no words; a text shorter than a window keeps all;
rows of null doc_id are never earlier or later than another document and keep
all words; rows with one doc_id are one document: their windows do not repeat
each other, and a window marked at a position is removed in each of them.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import Words, blocks, bytes_of, mix, read

MINIMISER = 3
#: Bytes of text that are cut and reduced at once.
BLOCK = 4 << 20
#: Buckets for each shuffle partition: a bucket is sorted in memory, so it is a small part of a partition.
SPREAD = 12
_DOC, _WORD = "<i8", "<i4"


def _starts(changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], changed])) if len(changed) else np.zeros(1, np.int64)


def super_kmers(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first window, number of windows and minimiser of each super-k-mer."""
    count = len(words.start) - width + 1
    if count < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    m = min(MINIMISER, width)
    runs = len(words.start) - m + 1
    low = mix(words.hashes(words.start[:runs], words.end[m - 1 :]) ^ np.uint64(0x5851F42D4C957F2D))
    span, left = 1, width - m + 1  # minimum over width - m + 1 runs, by doubling
    while span < left:
        step = min(span, left - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    valid = words.doc[:count] == words.doc[width - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at.astype(np.uint64)
    new = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
    first = _starts(new)
    return at[first], np.diff(np.append(first, len(at))), low[at[first]]


def _spans(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions: document, first position, length; input sorted by both."""
    if not len(at):
        return doc, at, at
    first = _starts((np.diff(at) != 1) | (doc[1:] != doc[:-1]))
    return doc[first], at[first], np.diff(np.append(first, len(at)))


def _marks(doc: np.ndarray, at: np.ndarray) -> dict[str, object]:
    """A row of finished marks; goes through the shuffle as it is."""
    flat = np.stack([x.astype(_DOC) for x in _spans(doc, at)]).tobytes()
    return {"marks": zstandard.compress(flat, 1)}


def scatter(documents: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows (bucket, texts, heads, marks): packed super-k-mers, or windows already marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, turn = zstandard.ZstdCompressor(level=1), 0
        schema = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("heads", pa.binary()), ("marks", pa.binary())])
        for table in blocks(batches, size=BLOCK):
            ids = np.array(table.column("doc_id").to_pylist(), np.int64)
            order = np.argsort(ids, kind="stable")
            texts = table.column("text").to_pylist()
            words = Words([texts[i] or b"" for i in order])
            ids = ids[order]
            first, count, low = super_kmers(words, width)
            if not len(first):
                continue
            start, end = words.start[first], words.end[first + count + width - 2]
            doc = ids[words.doc[first]]
            at = first - words.first[words.doc[first]]
            # Equal strings: the document of the first one is the smallest of the block.
            key = words.hashes(start, end) + (end - start).astype(np.uint64)
            _, leader, member = np.unique(key, return_index=True, return_inverse=True)
            lead = leader[member]
            later = np.flatnonzero(doc > doc[lead])
            data = words.data
            same = np.fromiter(
                (data[start[i] : end[i]] == data[start[j] : end[j]] for i, j in zip(later, lead[later])), bool, len(later)
            )
            later = later[same]
            rows = []
            if len(later):
                reps = count[later]
                spots = np.repeat(at[later] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                docs = np.repeat(doc[later], reps)
                by = np.lexsort((spots, docs))
                rows.append({"bucket": turn % buckets, "texts": None, "heads": None, **_marks(docs[by], spots[by])})
            turn += 7919
            go = np.ones(len(first), bool)
            go[later] = False
            go = np.flatnonzero(go)
            target = (mix(low[go]) % np.uint64(buckets)).astype(np.int64)
            go = go[by := np.argsort(target, kind="stable")]
            cuts = np.searchsorted(target[by], np.arange(buckets + 1))
            for b in range(buckets):
                part = go[cuts[b] : cuts[b + 1]]
                if len(part):
                    packed = b"\n".join([data[s:e] for s, e in zip(start[part].tolist(), end[part].tolist())])
                    heads = doc[part].astype(_DOC).tobytes() + at[part].astype(_WORD).tobytes()
                    rows.append({"bucket": b, "texts": zip_.compress(packed), "heads": zip_.compress(heads), "marks": None})
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema)

    rows = documents.select("doc_id", bytes_of("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "bucket int, texts binary, heads binary, marks binary")


def count_bucket(rows: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and positions of the windows of a bucket that an earlier document has, in order."""
    unzip = zstandard.ZstdDecompressor()
    texts = [unzip.decompress(t) for t, _ in rows]
    docs, spots = [], []
    for _, heads in rows:
        flat = unzip.decompress(heads)
        n = len(flat) // 12
        docs.append(np.frombuffer(flat, _DOC, n))
        spots.append(np.frombuffer(flat, _WORD, n, offset=8 * n))
    words = Words([line for text in texts for line in text.split(b"\n")])
    doc, spot = np.concatenate(docs), np.concatenate(spots).astype(np.int64)
    at, key = words.windows(width)
    of = words.doc[at]
    window_doc = doc[of]
    order = np.lexsort((window_doc, key))
    key, sorted_doc = key[order], window_doc[order]
    first = _starts(key[1:] != key[:-1])
    lead = np.repeat(first, np.diff(np.append(first, len(key))))
    later = np.flatnonzero(sorted_doc > sorted_doc[lead])
    a, b = order[later], order[lead[later]]
    data, start, end = words.data, words.start, words.end
    same = np.fromiter(
        (
            data[p:q] == data[r:s]
            for p, q, r, s in zip(
                start[at[a]].tolist(), end[at[a] + width - 1].tolist(), start[at[b]].tolist(), end[at[b] + width - 1].tolist()
            )
        ),
        bool,
        len(a),
    )
    a = a[same]
    where = spot[of[a]] + at[a] - words.first[of[a]]
    by = np.lexsort((where, window_doc[a]))
    return window_doc[a][by], where[by]


def repeated(documents: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, first, length: runs of positions at which a window starts that an earlier document has."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = SPREAD * partitions

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        docs, firsts, lengths = [], [], []
        packed = [(t, h) for t, h in zip(pdf.texts, pdf.heads) if t is not None]
        found = [_spans(*count_bucket(packed, width))] if packed else []
        for marks in pdf.marks:
            if marks is not None:
                found.append(tuple(np.frombuffer(zstandard.decompress(marks), _DOC).reshape(3, -1)))
        for doc, first, length in found:
            docs.append(doc)
            firsts.append(first)
            lengths.append(length)
        none = np.zeros(0, np.int64)
        return pd.DataFrame(
            {
                "doc_id": np.concatenate([none, *docs]),
                "first": np.concatenate([none, *firsts]),
                "length": np.concatenate([none, *lengths]),
            }
        )

    rows = scatter(documents, width, buckets)
    return rows.groupBy("bucket").applyInPandas(settle, "doc_id long, first long, length long")


def remove_repeated(documents: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``)."""
    spans = repeated(documents, width).groupBy("doc_id").agg(F.collect_list(F.struct("first", "length")).alias("spans"))
    rows = documents.select("doc_id", bytes_of("text")).join(spans.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, removed = [], [], []
            lists = batch.column("spans")
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int32)
                if lists[i].is_valid:
                    values = lists[i].values
                    a, n = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    np.add.at(gone, np.minimum(a, len(words)), 1)
                    np.add.at(gone, np.minimum(a + n + width - 1, len(words)), -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    keep = [words[j] for j in np.flatnonzero(stay).tolist()]
                else:
                    keep = words
                counts.append(len(words))
                removed.append(len(words) - len(keep))
                kept.append(b" ".join(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    done = rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
