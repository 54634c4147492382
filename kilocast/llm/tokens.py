"""Token-id files: a wavelet matrix for each shard, written and read by the executors.

Documents are dealt by range of doc_id, encoded, and packed into shards of
whole documents. A shard is one file: the documents' ids and offsets, and the
tokens as a wavelet matrix, one bit plane for each bit of the ids. With the
ones counted per block (rank) it answers ``access``, ``rank``, ``select``,
``count`` and ``locate`` without decoding the sequence. Sections are
compressed one by one, so a reader opens only those it needs.

File: magic, length of a JSON head, head (counts, bits, zeros of each plane,
length of each section), sections (doc ids, offsets, planes).

Words are told apart block by block, encoded by the given tokenizer and kept; the ids of a
text are those of its words in a row, which is what the tokenizer itself
gives, since it treats white space as a border (tests compare both).

Defined results: a null or empty text has the end id alone; null doc_ids come
first; repeated doc_ids are ordered by a hash of their texts; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilocast.llm.common import blocks, bytes_of, new_folder, read, read_file, stored, tidy, write_file

MAGIC = b"KWM1"
SHARD_TOKENS = 1 << 21
BLOCK = 512
END_ID = 1
#: Words, and pieces of words, whose ids a Python worker keeps; up to twice as many for a while.
KEPT = 500_000
#: Bytes of text that are encoded at once; a word that comes again there is looked up once.
ENCODED_BYTES = 6 << 20
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SIMPLE = regex.compile(r"[\x21-\x7e\xa1-\xff]*")
#: The same cut of ASCII words in lower case.
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(others)) for b in range(256))


class WordEncoder:
    """A tokenizer with the ids of words and of their pieces kept in bounded tables.

    Words of printing Latin-1 letters are cut by the tokenizer's own rule and
    their pieces go to its model at once; all others go through it as a whole.
    """

    _known: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words, self.old_pieces = self.words, self.pieces

    @classmethod
    def of(cls, path: str, most: int) -> WordEncoder:
        """The Python worker's encoder: later tasks find the words of earlier ones."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        cls._known[path].most = most
        return cls._known[path]

    @classmethod
    def forget(cls) -> None:
        cls._known.clear()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = self.old_pieces.get(piece)
            if known is None:
                # Printing ASCII letters stand for themselves.
                letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                known = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.pieces[piece] = known
        return known

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.most:  # words in use come over from the old table
            self.old_words, self.words = self.words, {}
        if len(self.pieces) > self.most:
            self.old_pieces, self.pieces = self.pieces, {}
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = split.values.dictionary_encode()
        every = coded.dictionary.view(pa.binary()).to_pylist()
        words, old, piece = self.words, self.old_words.get, self._piece
        found = list(map(words.get, every))
        others = []
        for i in [i for i, x in enumerate(found) if x is None]:
            w = every[i]
            known = old(w)
            if known is None:
                if w.isalpha():  # ASCII letters alone are one piece
                    known = piece(w.lower().decode())
                elif b"<|" in w:
                    others.append(i)
                    continue
                else:
                    text = w.decode("utf-8", "replace")
                    if w.isascii() and text.isprintable():
                        known = b"".join(map(piece, _ASCII_PIECE.findall(text.lower())))
                    elif _SIMPLE.fullmatch(text):
                        known = b"".join(map(piece, _PIECE.findall(text.lower())))
                    else:
                        others.append(i)
                        continue
            words[w] = found[i] = known
        odd = [every[i].decode("utf-8", "replace") for i in others]
        for i, ids in zip(others, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            words[every[i]] = found[i] = array("I", ids.ids).tobytes()
        ids = np.frombuffer(b"".join(found), np.uint32)
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        word = coded.indices.to_numpy()
        count = lengths[word]
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        # The place of a word's ids among those of the distinct words, less its place in the texts.
        shift = (np.cumsum(lengths, dtype=np.int32) - lengths)[word] - ends[:-1]
        data = ids[np.repeat(shift, count) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        return [data[4 * a : 4 * b] for a, b in pairwise(ends[split.offsets.to_numpy()].tolist())]


class WaveletMatrix:
    """A sequence of small integers as bit planes; positions and ranges are those of the sequence."""

    def __init__(self, size: int, bits: int, zeros: list[int], planes: list[np.ndarray]) -> None:
        self.size, self.bits, self.zeros, self.planes = size, bits, zeros, planes
        self._ranks: list[np.ndarray | None] = [None] * bits

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(values.max(initial=0)).bit_length())
        left = values.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for k in range(bits - 1, -1, -1):
            one = (left >> k) & 1 == 1
            planes.append(np.packbits(one, bitorder="little"))
            low = left[np.flatnonzero(~one)]
            zeros.append(len(low))
            left = np.concatenate([low, left[np.flatnonzero(one)]])
        return cls(len(values), bits, zeros, planes)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        if self._ranks[k] is None:
            padded = np.zeros((-(-len(self.planes[k]) // (BLOCK // 8)) + 1) * (BLOCK // 8), np.uint8)
            padded[: len(self.planes[k])] = self.planes[k]
            self.planes[k] = padded
            counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1)
            self._ranks[k] = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        block, byte = at // BLOCK, at // 8
        out = self._ranks[k][block]
        for j in range(BLOCK // 8):
            inside = block * (BLOCK // 8) + j
            out = out + np.where(inside < byte, np.bitwise_count(self.planes[k][inside]), 0)
        last = self.planes[k][byte] & ((1 << (at % 8)) - 1).astype(np.uint8)
        return out + np.bitwise_count(last)

    def values(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        out = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[: self.zeros[k]]
            above[np.flatnonzero(one)] = out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k))
            out = above
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for k in range(self.bits):
            ones = self._ones(k, at)
            one = self._ones(k, at + 1) > ones
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = (int(x) for x in self._ones(k, np.array([start, end])))
            one = value >> (self.bits - 1 - k) & 1
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if one else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a value in a range."""
        a, b = self._range(value, start, self.size if end is None else end)
        return b - a

    def rank(self, value: int, end: int) -> int:
        return self.count(value, 0, end)

    def locate(self, value: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of a value in a range, in order: select, plane by plane from the lowest."""
        a, b = self._range(value, start, self.size if end is None else end)
        at = np.arange(a, b)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
            if value >> (self.bits - 1 - k) & 1:
                at = np.flatnonzero(one)[at - self.zeros[k]]
            else:
                at = np.flatnonzero(~one)[at]
        return at

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence, from 0."""
        return int(self.locate(value)[nth])


def pack(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> list[bytes]:
    """The parts of a shard file."""
    matrix, zip_ = WaveletMatrix.build(values), zstandard.ZstdCompressor(level=1)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    sections = [ids.tobytes(), null.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()]
    sections = [zip_.compress(s) for s in sections + [p.tobytes() for p in matrix.planes]]
    head = json.dumps(
        {"docs": len(doc_ids), "tokens": len(values), "bits": matrix.bits, "zeros": matrix.zeros, "sections": [len(s) for s in sections]}
    ).encode()
    return [MAGIC, struct.pack("<I", len(head)), head, *sections]


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc ids, offsets and tokens of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack("<I", data[4:8])[0]
    head, at, parts, unzip = json.loads(data[8 : 8 + size]), 8 + size, [], zstandard.ZstdDecompressor()
    for length in head["sections"]:
        parts.append(unzip.decompress(data[at : at + length]))
        at += length
    null = np.frombuffer(parts[1], np.uint8)
    ids = [None if n else x for x, n in zip(np.frombuffer(parts[0], "<i8").tolist(), null)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(head["tokens"], head["bits"], head["zeros"], planes)


def write_shards(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    kept: int = KEPT,
    block_bytes: int = ENCODED_BYTES,
) -> DataFrame:
    """Write the token files; returns the stored manifest: path, part, turn, n_docs, n_tokens, start."""
    spark = documents.sparkSession
    folder = new_folder(spark, "tokens")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = WordEncoder.of(tokenizer, kept), TaskContext.get()
        part, end = context.partitionId(), np.array([end_id], np.uint32).tobytes()
        ids: list[int | None] = []
        coded: list[bytes] = []
        held = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, coded, held, turn
            path = f"{folder}/shard-{part:06d}-{turn:06d}.kwm"
            lengths = np.array([len(x) // 4 for x in coded])
            write_file(path, pack(ids, lengths, np.frombuffer(b"".join(coded), np.uint32)), context.taskAttemptId())
            row = {"path": path, "part": part, "turn": turn, "n_docs": len(ids), "n_tokens": held}
            ids, coded, held, turn = [], [], 0, turn + 1
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in ("part", "turn", "n_docs", "n_tokens")]])
        for table in blocks(batches, size=block_bytes):
            keys = table.column("doc_id").to_pylist()
            for key, text in zip(keys, encoder.encode([x or b"" for x in table.column("text").to_pylist()])):
                ids.append(key)
                coded.append(text + end)
                held += len(text) // 4 + 1
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", bytes_of("text"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    written = stored(
        dealt.drop("tie").mapInArrow(run, "path string, part long, turn long, n_docs long, n_tokens long")
    )
    # Ids before a shard: those of earlier parts (a row for each part) and of earlier shards of its part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        written.withColumn("of_shards", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("path", "part", "turn", "n_docs", "n_tokens", (F.col("of_parts") + F.col("of_shards")).alias("start"))
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordEncoder.forget()  # all files are written
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                ids, offsets, matrix = unpack(read_file(path))
                data = memoryview(matrix.values().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(offsets[:-1] + start), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(count, "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """doc_id and position in the document of every occurrence of a token, looked up in the wavelet matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                ids, offsets, matrix = unpack(read_file(path))
                at = matrix.locate(token)
                doc = np.searchsorted(offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in doc], pa.int64()), pa.array(at - offsets[doc], pa.int64())], ["doc_id", "position"]
                )

    return manifest.select("path").mapInArrow(run, "doc_id long, position long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read(spark, sf_dir, "documents"), default_tokenizer()))
