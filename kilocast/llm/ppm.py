"""Language-model scores by partial matching over byte contexts.

The model is a trie of byte contexts up to ``ORDER`` long, held as sorted
arrays of grams (context and next byte). A byte is predicted from its longest
known context; where that context has not seen the byte, the model escapes to
the next shorter one and leaves out the bytes that the longer one knows
(symbol exclusion). Estimates follow method D: half a count of each seen byte
goes to the escape. Symbols known to a context are known to all its suffixes,
so exclusion needs only two sums per context, and the code length of a byte
depends on its gram alone: it is computed once for each distinct gram of a
block.

A text is its words, A-Z in lower case, joined by one space, and an end mark;
contexts reach back to ``ORDER`` end marks before the text.

Training counts every gram and word of all training texts on the cluster, and
the model keeps them all: its grams are dealt into shards by the last
``NEAR`` bytes of their context, so that a shard holds whole contexts of that
length and longer. Counts of shorter contexts are sums over all grams, at most
256 ** ``NEAR`` rows whatever the corpus, and go to every shard. The distinct
grams of a block of texts travel to their shards and their code lengths back
to the block, in ``ROUNDS`` rounds of blocks. The unigram base score is exact for the whole vocabulary: the
``COMMON`` most frequent words are sent to the executors, all others meet their
counts in a join.

``held_out`` rows are those outside the training fold; ``score`` may also be
adaptive (``adaptive_score``): the code length of a text under a model that
learns from that text alone as it goes.

Defined results: a null or empty text is the end mark alone; a null doc_id
counts as an empty string for the fold; repeated rows count and are scored
each; without training texts every byte costs log10(256). Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import BLOCK_BYTES, Words, blocks, bytes_of, distinct, fold, mix, offsets_list, read, stored

ORDER = 6
NEAR = 3
#: Bytes of a block of texts to be scored, and grams of the model in a shard.
SCORE_BLOCK = 4 << 20
SHARD = 1 << 20
#: Rounds in which blocks are scored: the code lengths of one round at a time take disk.
ROUNDS = 4
COMMON = 1 << 18
#: Bytes of a block of texts to be counted, and counts in a batch that leaves a Python worker.
COUNT_BLOCK = 1 << 20
ROWS = 1 << 16
END = b"\n"
END_WORD = -1
GRAM, WORD = 0, 1


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams (order + 1 bytes, the last one the next byte) of normal texts with their end, and where each text begins."""
    data = np.frombuffer(b"".join(END * order + t + END for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(firsts[-1]) + np.repeat(np.arange(1, len(texts) + 1) * order, lengths)
    whole = np.zeros(len(data), np.uint64)
    for k in range(order + 1):
        whole[order:] |= data[order - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return whole[at], firsts


def normal(texts: list[bytes | None]) -> list[bytes]:
    return [b" ".join((t or b"").lower().split()) for t in texts]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, key, n: grams and word hashes of the texts with their counts, the end mark as word ``END_WORD``."""

    def rows(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
        keys, counts = _merge(parts)
        parts.clear()
        # In small batches: the executor holds a whole one beside its heap.
        for i in range(0, len(keys), ROWS):
            some = keys[i : i + ROWS].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), kind), pa.int32()), pa.array(some), pa.array(counts[i : i + ROWS], pa.int64())],
                ["kind", "key", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}
        for table in blocks(batches, size=COUNT_BLOCK):
            texts = normal(table.column("text").to_pylist())
            words = Words(texts)
            hashes, n = np.unique(words.hashes(words.start, words.end), return_counts=True)
            held[WORD] += [(hashes, n), (np.array([END_WORD]).view(np.uint64), np.array([len(texts)]))]
            del words, hashes
            held[GRAM].append(np.unique(grams_of(texts, order)[0], return_counts=True))
            for kind, parts in held.items():
                if len(parts) > 6 and (len(parts) > 24 or sum(len(p[0]) for p in parts) > 2_000_000):
                    held[kind] = [_merge(parts)]
                    if len(held[kind][0][0]) > 1_000_000:
                        yield from rows(kind, held[kind])
        for kind, parts in held.items():
            if parts:
                yield from rows(kind, parts)

    found = documents.select(bytes_of("text")).mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _fitting(table: DataFrame, most: int) -> int:
    """A count, about the smallest, such that at most ``most`` rows have it or more; above all counts if there is none."""
    # Counts by their highest five bits, a class for each: at most a thousand numbers come to the driver.
    step = F.expr("shiftleft(1L, greatest(length(bin(n)) - 5, 0))")
    sizes = table.groupBy((F.col("n") - F.col("n") % step).alias("low")).agg(F.count("*"), F.max("n")).collect()
    total, least = 0, max((high for _, _, high in sizes), default=0) + 1
    for low, size, _ in sorted(sizes, reverse=True):
        total += size
        if total > most:
            break
        least = low
    return least


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in 32 bits where they fit."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)


class Trie:
    """Grams of all orders as sorted arrays, with what escapes and exclusion need of each context."""

    def __init__(
        self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER, shorter_of: tuple[np.ndarray, np.ndarray] | None = None
    ) -> None:
        """``grams`` of the full order with their counts; shorter ones follow from them.

        Of a shard, orders under ``NEAR`` follow from ``shorter_of``, the grams
        of ``NEAR`` bytes (of ``order`` if that is less) of all shards.
        """
        self.order = order
        self.grams, self.counts, self.contexts, self.totals, self.kinds, self.excluded = [], [], [], [], [], []
        for j in range(order + 1):
            whole, held = shorter_of if shorter_of and j < min(NEAR, order) else (grams, counts)
            keys, n = _merge([(whole & np.uint64((1 << 8 * (j + 1)) - 1), held)])
            contexts = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.grams.append(keys)
            self.counts.append(_narrow(n))
            self.contexts.append(contexts[first])
            self.totals.append(_narrow(np.add.reduceat(n, first) if len(first) else n))
            self.kinds.append(np.diff(np.append(first, len(keys))).astype(np.uint16))
            # What the next shorter context counts of the symbols of this one.
            shorter = np.zeros(len(keys), np.int64)
            if j:
                at = np.searchsorted(self.grams[j - 1], keys & np.uint64((1 << 8 * j) - 1))
                shorter = self.counts[j - 1][at].astype(np.int64)
            self.excluded.append(_narrow(np.add.reduceat(shorter, first) if len(first) else shorter))

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is missing."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return np.where(table[at] == keys, at, -1)

    @staticmethod
    def _of(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The values at the given places, 0 where the place is -1."""
        if not len(values):
            return np.zeros(len(place))
        return np.where(place >= 0, values[place].astype(np.float64), 0.0)

    def code(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))  # those whose byte has not been met yet
        before = np.full(len(grams), -1)  # their context of one order more
        for j in range(self.order, -1, -1):
            key = grams[open_] & np.uint64((1 << 8 * (j + 1)) - 1)
            place = self._find(self.contexts[j], key >> np.uint64(8))
            total, kinds = self._of(self.totals[j], place), self._of(self.kinds[j], place)
            if j < self.order:
                total -= self._of(self.excluded[j + 1], before)
                kinds -= self._of(self.kinds[j + 1], before)
            seen = self._find(self.grams[j], key)
            met = seen >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                if met.any():
                    out[open_[met]] += np.log10((self.counts[j][seen[met]].astype(np.float64) - 0.5) / total[met])
                escape = ~met & (total > 0)
                out[open_[escape]] += np.log10(0.5 * kinds[escape] / total[escape])
            open_, before = open_[~met], place[~met]
        left = 256 - (int(self.kinds[0][0]) if len(self.kinds[0]) else 0)
        out[open_] -= np.log10(max(left, 1))
        return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _near(order: int) -> int:
    """A mask of the context bytes that a gram is dealt by, with its next byte."""
    return (1 << 8 * (min(NEAR, order) + 1)) - 256


def shards_of(grams: np.ndarray, shards: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the grams by shard, and where each shard begins in it."""
    shard = (mix(grams & np.uint64(_near(order))) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _by_bytes(values: np.ndarray) -> bytes:
    """Integers as their lowest bytes, then their next ones, and so on: alike ones stand together and compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_bytes(data: bytes | memoryview, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return _by_bytes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_from_bytes(data, np.uint64), dtype=np.uint64)


def packed_blocks(documents: DataFrame) -> DataFrame:
    """block, packed: the documents in blocks of about ``SCORE_BLOCK`` bytes, compressed; a block's rows count up from its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        zip_ = zstandard.ZstdCompressor(level=1)
        for table in blocks(batches, size=SCORE_BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            packed = zip_.compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([packed], pa.binary())], ["block", "packed"])
            row += table.num_rows

    return documents.select("doc_id", "held_out", bytes_of("text")).mapInArrow(run, "block long, packed binary")


def _unpacked(packed: bytes) -> tuple[pa.Table, list[bytes]]:
    """The documents of a block and their normal texts."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
    return table, normal(table.column("text").to_pylist())


def codes(packed: DataFrame, counts: DataFrame, order: int, shards: int) -> DataFrame:
    """block, shard, codes: log10 of the probability of each distinct gram of a block, in the order of the shard's grams."""
    spark = packed.sparkSession
    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    low = (1 << 8 * min(NEAR, order)) - 1 if order else 255
    few = grams.groupBy(F.col("key").bitwiseAND(F.lit(low)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    shorter = spark.sparkContext.broadcast((_numbers(few.column("key")).astype(np.uint64), _numbers(few.column("n"))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, bytes_ in zip(batch.column("block").to_pylist(), batch.column("packed")):
                found = distinct(grams_of(_unpacked(bytes_.as_py())[1], order)[0])
                by_shard, edges = shards_of(found, shards, order)
                found = found[by_shard]
                used = np.flatnonzero(np.diff(edges))
                asked = [zip_.compress(pack_sorted(found[edges[i] : edges[i + 1]])) for i in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), block), pa.int64()), pa.array(used, pa.int64()), pa.array(asked, pa.binary())],
                    ["block", "shard", "asked"],
                )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, held = zstandard.ZstdCompressor(level=1), []

        def packed_rows() -> pa.RecordBatch:
            keys, counts = _merge(held)
            by_shard, edges = shards_of(keys, shards, order)
            keys, counts = keys[by_shard], counts[by_shard]
            held.clear()
            used = np.flatnonzero(np.diff(edges))
            cut = [(keys[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]]) for i in used]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int64()),
                    pa.array([zip_.compress(pack_sorted(k)) for k, _ in cut], pa.binary()),
                    pa.array([zip_.compress(_by_bytes(n)) for _, n in cut], pa.binary()),
                ],
                ["shard", "keys", "counts"],
            )

        for batch in batches:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            if sum(len(k) for k, _ in held) >= SHARD:
                yield packed_rows()
        if held:
            yield packed_rows()

    def answer(_, model: pa.Table, asked: pa.Table) -> pa.Table:
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        keys = [unpack_sorted(unzip.decompress(x.as_py())) for x in model.column("keys")]
        counts_ = [_from_bytes(unzip.decompress(x.as_py()), np.int64) for x in model.column("counts")]
        trie = Trie(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts_]), order, shorter.value)
        out = []
        for x in asked.column("asked"):
            out.append(zip_.compress(trie.code(unpack_sorted(unzip.decompress(x.as_py()))).tobytes()))
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "codes": pa.array(out, pa.binary())})

    asked = packed.mapInArrow(ask, "block long, shard long, asked binary")
    model = grams.mapInArrow(deal, "shard long, keys binary, counts binary")
    return model.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "block long, shard long, codes binary")


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a model that starts empty and learns from it byte by byte."""
    table: dict[bytes, dict[int, int]] = {}
    data, total = END * order + normal([text])[0] + END, 0.0
    for i in range(order, len(data)):
        symbol, excluded, met = data[i], set(), False
        for j in range(order, -1, -1):
            seen = table.setdefault(data[i - j : i], {})
            left = {s: n for s, n in seen.items() if s not in excluded}
            size = sum(left.values())
            if not met and symbol in left:
                total += np.log10((left[symbol] - 0.5) / size)
                met = True
            elif not met and left:
                total += np.log10(0.5 * len(left) / size)
            excluded |= seen.keys()
            seen[symbol] = seen.get(symbol, 0) + 1
            if j == 0 and not met:
                total -= np.log10(max(256 - len(excluded), 1))
    return float(total)


def score(documents: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``documents``: doc_id, held_out, text."""
    spark = documents.sparkSession
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = np.log10(total + 0.5 * (kinds + 1))
    least = _fitting(words.where(F.col("key") != END_WORD), COMMON - 1)
    common = words.where((F.col("n") >= least) | (F.col("key") == END_WORD)).toArrow().sort_by("key")
    keys = common.column("key").combine_chunks().to_numpy(zero_copy_only=False)
    values = common.column("n").combine_chunks().to_numpy(zero_copy_only=False)
    held = spark.sparkContext.broadcast((keys, values))
    n_grams = counts.where(F.col("kind") == GRAM).count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_grams // SHARD))
    packed = stored(packed_blocks(documents))
    ends = int(values[keys == END_WORD].sum())

    def run(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        known_keys, known_counts = held.value
        logs = np.log10(known_counts + 0.5)
        row = own.column("block")[0].as_py()
        table, texts = _unpacked(own.column("packed")[0].as_py())
        grams, firsts = grams_of(texts, order)
        asked, member = np.unique(grams, return_inverse=True)
        del grams
        unzip = zstandard.ZstdDecompressor()
        found_codes = answers.sort_by("shard").column("codes")
        code = np.empty(len(asked))
        code[shards_of(asked, shards, order)[0]] = np.concatenate(
            [np.zeros(0), *(np.frombuffer(unzip.decompress(x.as_py()), np.float64) for x in found_codes)]
        )
        sums = np.concatenate([[0.0], np.cumsum(code[member])])
        del member
        scores = sums[firsts[1:]] - sums[firsts[:-1]]
        bases, knowns, tokens_, rares, cuts = [], [], [], [], []
        sizes = np.cumsum([len(t) for t in texts]) // BLOCK_BYTES
        starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for i, j in zip(starts, starts[1:]):
            w = Words(texts[i:j])
            hashes = w.hashes(w.start, w.end).view(np.int64)
            if len(known_keys):
                at = np.searchsorted(known_keys, hashes)
                at[at == len(known_keys)] = 0
                found = known_keys[at] == hashes
            else:
                at, found = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
            base = np.concatenate([[0.0], np.cumsum(np.where(found, logs[at] if len(logs) else 0.0, 0.0))])
            hits = np.concatenate([[0], np.cumsum(found)])
            rare = np.flatnonzero(~found)
            bases.append(np.diff(base[w.first]) + np.log10(ends + 0.5))
            knowns.append(np.diff(hits[w.first]) + (ends > 0))
            tokens_.append(np.diff(w.first) + 1)
            cuts.append(np.diff(np.searchsorted(rare, w.first)))
            rares.append(hashes[rare])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "row": pa.array(np.arange(row, row + len(texts))),
                "n_tokens": pa.array(np.concatenate(tokens_)),
                "known": pa.array(np.concatenate(knowns)),
                "base": pa.array(np.concatenate(bases)),
                "score": pa.array(scores),
                "rare": offsets_list(np.concatenate(rares), np.concatenate(cuts), pa.int64()),
            }
        )

    kind = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, score double, rare array<long>"
    rounds = min(ROUNDS, max(1, packed.count()))
    turn = F.pmod(F.xxhash64("block", F.lit(rounds)), F.lit(rounds))
    parts = []
    for i in range(rounds):
        some = packed.where(turn == i)
        answers = codes(some, counts, order, shards)
        parts.append(stored(some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)))
    scored = reduce(DataFrame.union, parts)
    others = (
        scored.select("row", F.explode("rare").alias("key"))
        .join(words.where(F.col("n") < least), "key", "left")
        .groupBy("row")
        .agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("added"))
    )
    return scored.join(others, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(scale))).alias("base_score"),
        "score",
    )


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 1)
    return score(documents, stored(count(documents.where(~F.col("held_out")))))
