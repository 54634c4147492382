"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, learnt from labelled rows, predicts the
probability that a document belongs to each domain. Document rates r >= 0 are
then fitted so that the expected tokens of each domain, sum of
r * tokens * posterior, match ``weight * budget``:

    minimise  1/2 sum_d ((S_d - T_d) / N)^2  +  RIDGE / 2 * sum_i n_i / N * (r_i - r0)^2

with N all tokens, S_d the expected tokens of domain d, T_d its target and
r0 = budget / N the rate of equal use. Projected gradient steps in the metric of the token counts,
with Nesterov momentum: r_i <- clip(y_i - step * (sum_d p_id (S_d - T_d) / N +
RIDGE (y_i - r0))). The state of a document follows from its own posterior and
the vectors S of the steps so far, so a step is one aggregation over the
compact table of token counts and posteriors; only D numbers come to the
driver and nothing per document is written between steps.

Training: labelled rows of ``documents``, at most about ``max_rows`` (a
documented bound, chosen by hash of the id), dealt to ``SHARDS`` tasks whose
weights are averaged.

Defined results: a null or empty text has no words and gets the classifier's
prior and no tokens, so it does not move the totals; its rate is that of its
posterior. Rows with null doc_id and repeated rows have rates of their own.
Without labelled rows the posterior is uniform. Domains absent from the
targets have target 0; targets are scaled to sum to one. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from kilocast.llm.common import blocks, bytes_of, read, stored, tidy

BITS = 15
SHARDS = 4
EPOCHS = 4
RATE = 0.5
MAX_TRAINING_ROWS = 12_000
RIDGE = 1e-3
STEPS = 40
TOLERANCE = 1e-3
#: Domains of the labels table: its two marks together, and weights for them.
TARGETS = {"high_clean": 0.6, "low_clean": 0.25, "high_toxic": 0.1, "low_toxic": 0.05}


class _Spots(dict):
    """Coordinate of a word; kept per Python worker, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()")) >> (64 - BITS)
        return value


_SPOTS = _Spots()


def _forget() -> None:
    """Python workers live on after a task, and other operators' tasks want their memory."""
    _SPOTS.clear()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct word coordinates, their weights (root of the counts, of length one) and the number of words."""
    words = text.lower().split()
    spots = np.fromiter(map(_SPOTS.__getitem__, words), np.int64, len(words))
    at, counts = np.unique(spots, return_counts=True)
    root = np.sqrt(counts)
    return at, root / max(1e-9, np.sqrt((root * root).sum())) if len(at) else root, len(words)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_posteriors(documents: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights (coordinate, domain), the last row the bias, from labelled rows (doc_id, domain)."""
    marks = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    share = min(1.0, max_rows / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    rows = documents.select("doc_id", bytes_of("text")).join(chosen, "doc_id").select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).alias("shard"), F.xxhash64("text", "doc_id").alias("turn"), "text", "domain"
    )
    places = {d: i for i, d in enumerate(domains)}

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        seen = [(features(bytes(t)), places[d]) for t, d in zip(pdf.text, pdf.domain)]
        w, squares = np.zeros(((1 << BITS) + 1, len(domains))), np.full(((1 << BITS) + 1, len(domains)), 1e-2)
        for _ in range(EPOCHS):
            for (at, x, _n), label in seen:
                at, x = np.append(at, 1 << BITS), np.append(x, 0.3)
                gradient = _softmax(x @ w[at])
                gradient[label] -= 1
                step = np.outer(x, gradient)
                squares[at] += step * step
                w[at] -= RATE * step / np.sqrt(squares[at])
        at = np.flatnonzero(w.any(axis=1))
        return pd.DataFrame({"spot": at, "weights": list(w[at])})

    learnt = rows.groupBy("shard").applyInPandas(shard, "spot long, weights array<double>")
    sums = learnt.groupBy("spot").agg(*[F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(domains))])
    out = np.zeros(((1 << BITS) + 1, len(domains)))
    for spot, *values in sums.collect():  # at most 2**BITS + 1 rows
        out[spot] = np.array(values) / SHARDS
    return out


def posteriors(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents' other columns with n_tokens (words) and posterior (array, one entry for each domain)."""
    held = documents.sparkSession.sparkContext.broadcast(weights)
    base = documents.drop("text", "n_tokens", "posterior")
    names = base.columns
    schema = StructType(list(base.schema.fields)).add("n_tokens", "long").add("posterior", ArrayType(DoubleType()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        try:
            for table in blocks(batches):
                counts, values = [], []
                for text in table.column("text").to_pylist():
                    at, x, n = features(text or b"")
                    counts.append(n)
                    values.append(_softmax(x @ w[at] + 0.3 * w[-1]))
                flat = np.concatenate(values)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, w.shape[1]), pa.int32()), pa.array(flat))
                out = table.select(names).append_column("n_tokens", pa.array(counts, pa.int64())).append_column("posterior", lists)
                yield from out.to_batches()
        finally:
            _forget()

    return documents.select(*names, bytes_of("text")).mapInArrow(run, schema)


class Rates:
    """Fitted rates: what the steps have summed, from which the rate of any posterior follows."""

    def __init__(self, target: np.ndarray, total: float, r0: float, step: float, low: float, high: float) -> None:
        self.target, self.total, self.r0, self.step, self.low, self.high = target, total, r0, step, low, high
        self.history: list[np.ndarray] = []

    def points(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of posteriors (rows, D): the point of the next step and the rate after the last one."""
        rate = y = np.full(len(p), min(max(self.r0, self.low), self.high))
        t = 1.0
        for s in self.history:
            slope = p @ ((s - self.target) / self.total) + RIDGE * (y - self.r0)
            new = np.clip(y - self.step * slope, self.low, self.high)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, rate, t = new + (t - 1) / after * (new - rate), new, after
        return y, rate

    def apply(self, table: DataFrame) -> DataFrame:
        """``table`` (with posterior) and its column ``rate``."""
        names, d = [c for c in table.columns if c != "rate"], len(self.target)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(self.points(p)[1], pa.float64())], [*names, "rate"])

        base = table.select(names)
        return base.mapInArrow(run, StructType(list(base.schema.fields)).add("rate", "double"))


def fit_rates(
    table: DataFrame, targets: list[float], growth: float = 1.0, min_rate: float = 0.0, max_rate: float = 8.0, steps: int = STEPS
) -> Rates:
    """Rates for a table with n_tokens and posterior; ``growth``: tokens wanted, in times of the tokens there are."""
    weight = np.array(targets, float) / sum(targets)
    d = len(weight)
    entry: list[Column] = [F.col("posterior")[i] for i in range(d)]
    n = F.col("n_tokens").cast("double")
    first = table.agg(
        F.coalesce(F.sum(n), F.lit(0.0)).alias("total"),
        *[F.coalesce(F.sum(n * entry[i] * entry[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(d) for j in range(d)],
    ).first()
    total = max(first[0], 1.0)
    # The Lipschitz constant of the gradient in the metric of the token counts.
    steepest = np.linalg.eigvalsh(np.array(first[1:]).reshape(d, d) / total)[-1]
    rates = Rates(weight * growth * total, total, growth, 1 / (steepest + RIDGE + 1e-12), min_rate, max_rate)
    last = np.full(d, np.inf)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * d)
            for b in batches:
                p = b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y, rate = rates.points(p)
                tokens = b.column("n_tokens").to_numpy(zero_copy_only=False)
                out += np.concatenate([(y * tokens) @ p, (rate * tokens) @ p])
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = table.select("n_tokens", "posterior").mapInArrow(sums, "s array<double>")
        s = np.array(parts.agg(*[F.coalesce(F.sum(F.col("s")[i]), F.lit(0.0)) for i in range(2 * d)]).first())
        near = np.abs(s[d:] - rates.target).max() < TOLERANCE * growth * total
        still = np.abs(s[d:] - last).max() < TOLERANCE / 20 * growth * total  # bounds can keep targets out of reach
        settled = len(rates.history) > 3 and (near or still)
        last = s[d:]
        rates.history.append(s[:d])
        if settled:
            break
    return rates


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain, the two marks of the labels table together."""
    return labels.select(
        "doc_id",
        F.concat(
            F.when(F.col("quality") > 0, "high").otherwise("low"), F.lit("_"), F.when(F.col("toxic") > 0, "toxic").otherwise("clean")
        ).alias("domain"),
    )


def copies(rate: str, *keys: str) -> Column:
    """How often a row is used: its rate, rounded up or down by a hash of the keys so that it is met on average."""
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(F.col(rate) + draw).cast("int")


def mix_documents(documents: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> tuple[np.ndarray, DataFrame, Rates]:
    """The classifier's weights, the stored table of tokens and posteriors, and the fitted rates."""
    weights = fit_posteriors(documents.select("doc_id", "text"), label_domains(labels), list(targets))
    table = stored(posteriors(documents.select("doc_id", "text"), weights))
    return weights, table, fit_rates(table, list(targets.values()), **options)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table, rates = mix_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), TARGETS)
    return rates.apply(table).select(
        "doc_id",
        "n_tokens",
        *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)],
        "rate",
        copies("rate", "doc_id").alias("copies"),
    )
