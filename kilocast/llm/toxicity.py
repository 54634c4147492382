"""Toxicity scores: logistic regression learnt by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, their stems (first four and five characters),
word pairs and pairs with one word between (A-Z in lower case, marks at a
word's edges removed), hashed to ``2**BITS`` coordinates. Every coordinate has its own learning rate, and the L1
term leaves most weights at zero, so the model that is sent to the executors
is a sparse list of at most ``2**BITS`` numbers.

Training: labelled rows outside the held-out fold, at most about ``max_rows``
of them (a documented bound; chosen by hash of the id). They are dealt to
``SHARDS`` tasks, each of which learns over its share for ``EPOCHS`` passes;
the weights are averaged. Texts, not ids, languages or sources, are the input.

Defined results: a null or empty text has only the constant feature; a null
doc_id is hashed as an empty string and keeps its row; labels without toxic
mark, without document, or with contradicting marks (the higher counts) never
crash; without any label every score is 0.5; repeated rows are scored alike;
further columns are ignored (query) or kept (``score``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import blocks, bytes_of, fold, free_memory, mix, read, tidy

BITS = 18
SHARDS = 4
EPOCHS = 2
MAX_TRAINING_ROWS = 20_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.02
EDGES = bytes(c for c in range(33, 128) if not chr(c).isalnum())
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of a word, without the marks at its edges, and of its stems; kept per Python worker, bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 150_000:
            self.clear()
        bare = word.strip(EDGES) or word
        letters = bare[:20].decode("utf-8", "ignore")
        stems = [xxhash.xxh3_64_digest(letters[:k].encode(), seed=k) for k in (4, 5)]
        self[word] = value = b"".join([xxhash.xxh3_64_digest(bare), *stems])
        return value


_HASHES = _Hashes()


def _forget() -> None:
    """Python workers live on after a task, and other operators' tasks want their memory."""
    _HASHES.clear()


def features(text: bytes) -> np.ndarray:
    """The distinct coordinates of a text; the last one, 2**BITS, is the constant."""
    words = text.lower().split()
    each = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 3)
    h = each[:, 0]
    all_of = np.concatenate([h, each[:, 1], each[:, 2], h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:]])
    spots = np.unique((mix(all_of) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.append(spots, 1 << BITS)


def learn(rows: Iterable[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (text, label) in the given order; returns the weights."""
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)
    seen = [(features(text).astype(np.int32), label) for text, label in rows]

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(
            np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(epochs):
        for at, label in seen:
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - rate * w
            n[at] += gradient * gradient
    return weights(slice(None))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, folds: int = 5) -> np.ndarray:
    """Weights learnt from labelled rows outside fold 0; about ``max_rows`` of them."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    count = marks.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = marks.where(part < F.lit(int((1 << 30) * min(1.0, max_rows / max(count, 1)))))
    rows = documents.select("doc_id", bytes_of("text")).join(chosen, "doc_id").select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).alias("shard"),
        F.xxhash64("text", "doc_id").alias("turn"),
        "text",
        "toxic",
    )

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        w = learn(zip(map(bytes, pdf.text), (pdf.toxic > 0).astype(int)))
        _forget()
        free_memory()
        at = np.flatnonzero(w)
        return pd.DataFrame({"spot": at, "weight": w[at]})

    learnt = rows.groupBy("shard").applyInPandas(shard, "spot long, weight double")
    total = learnt.groupBy("spot").agg(F.sum("weight").alias("weight")).collect()  # at most 2**BITS + 1 rows
    out = np.zeros((1 << BITS) + 1)
    for spot, weight in total:
        out[spot] = weight / SHARDS
    return out


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents with a column ``score``, the probability of label 1."""
    held = documents.sparkSession.sparkContext.broadcast(weights)
    schema = documents.drop("score").schema.add("score", "double", False)
    names = documents.drop("score").columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        try:
            for table in blocks(batches, "_bytes"):
                sums = [w[features(x or b"")].sum() for x in table.column("_bytes").to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
                out = table.select(names).append_column("score", pa.array(scores, pa.float64()))
                yield from out.to_batches()
        finally:
            _forget()

    return documents.drop("score").withColumn("_bytes", bytes_of("text").cast("binary")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(documents, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(documents.withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "text"), weights)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
