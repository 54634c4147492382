"""Spelling variants of one word, by a bit-sliced position index.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower
case, with at least ``LENGTH`` letters and ``COUNT`` occurrences. Two words
are near if one inserted, deleted or replaced letter leads from one to the
other. A word's form is its near word with most occurrences (ties: first in
code-point order) if that has at least twice its own; its root is the end of
the chain of forms.

1. *Counts.* Tasks count the words of their texts and send each word once for
   every ``HELD`` different ones.
2. *Shards.* An edit leaves the first or the last half of a word as it is, so
   near words of which the shorter has L letters meet in the shard of (L,
   first L / 2 letters) or (L, last L / 2 letters). A word goes to the shards
   of its own length and of the length below. Large shards are cut into
   shares, and every share of words asked for meets every share of the index.
3. *Index.* For every position and letter of up to some thousand words a
   bitset tells which of them have the letter there. For a word asked for,
   three sets are carried along its letters: words that agree so far (zero
   errors), and those with one error by now: a replaced letter, or a letter
   more or less, for which the bitsets of the next or the last position are
   read. A step is a few operations on 64 words of the index at once, over
   many words asked for.
4. Where both halves agree a pair would be found twice: the shard of the last
   half leaves out those that agreed after the first half, by the set of zero
   errors at that place.
5. The index is in the order of the forms, so the first bit of the final set
   is the best form and the number of bits the number of near words: pairs are
   never written out.
6. *Roots* by pointer doubling. Occurrences double at least from word to form,
   so chains have at most 63 words and need six rounds.

Defined results: null and empty texts have no words; repeated rows count each
time; rows without id count too, but no letter is taken out of them. Empty
tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import blocks, read, stored

LENGTH = 5
COUNT = 3
#: Different words that a task counts before it sends them.
HELD = 1 << 18
#: Letters of a share of a shard, and of the shards that are indexed together.
LETTERS = 1 << 16
#: Words asked for at once.
ASKED = 512


def _fold() -> bytes:
    """Latin-1 bytes: letters as they are but for A-Z, all else a space."""
    table = bytearray(b" " * 256)
    for code in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)):
        table[code] = code
    for code in range(ord("A"), ord("Z") + 1):
        table[code] = code + 32
    return bytes(table)


_FOLD = _fold()


def words_of(text: str) -> list[bytes]:
    """The words of a text, one byte a letter; letters beyond U+00FF are no letters here."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def word_counts(documents: DataFrame, slip: int | None = None) -> DataFrame:
    """Rows (word, n) of all words of at least ``LENGTH`` letters.

    With ``slip``, words whose crc32 with the document's id is divisible by it
    lose one letter.
    """

    def send(counts: Counter[bytes]) -> pa.RecordBatch:
        found = [(w.decode("latin-1"), n) for w, n in counts.items() if len(w) >= LENGTH and n]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for table in blocks(batches):
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
                counts = Counter(words_of(text or ""))
                total.update(counts)
                if slip and doc_id is not None:
                    start = zlib.crc32(b"%d:" % doc_id)
                    for word, n in counts.items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            total[word] -= n
                            total[word[:at] + word[at + 1 :]] += n
                if len(total) >= HELD:
                    yield send(total)
                    total.clear()
        yield send(total)

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shards(vocabulary: DataFrame) -> DataFrame:
    """Rows (shorter, front, half, i, j, split, word, n, member, asked): share i of a shard's index meets share j of its words."""
    size = F.length("word")

    def place(shorter: Column, front: bool) -> Column:
        h = F.floor(shorter / 2).cast("int")
        half = F.substr("word", F.lit(1), h) if front else F.substr("word", size - h + 1, h)
        return F.struct(shorter.alias("shorter"), F.lit(front).alias("front"), half.alias("half"))

    places = F.array(place(size, True), place(size, False), place(size - 1, True), place(size - 1, False))
    spread = vocabulary.select("word", "n", F.explode(places).alias("at")).select("at.*", "word", "n").where(F.col("shorter") >= LENGTH)
    keys = ["shorter", "front", "half"]
    # A shard needs a word of the shorter length and another one.
    cost = F.count("*") * F.greatest(F.col("shorter") + 1, F.lit(16)) / LETTERS
    sizes = (
        spread.groupBy(*keys)
        .agg(F.ceil(cost).alias("shares"), F.count("*").alias("all"), F.count_if(F.length("word") == F.col("shorter")).alias("short"))
        .where("all > 1 and short > 0")
        .select(*keys, "shares")
    )
    home = F.pmod(F.xxhash64("word"), F.col("shares"))
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("shares") - 1),
        lambda x: F.array(
            F.struct(home.alias("i"), x.alias("j"), F.lit(True).alias("member"), (x == home).alias("asked")),
            F.struct(x.alias("i"), home.alias("j"), F.lit(False).alias("member"), F.lit(True).alias("asked")),
        ),
    )
    cells = F.filter(F.flatten(each), lambda c: c["member"] | (c["i"] != c["j"]))
    rows = spread.join(sizes, keys).select(*keys, (F.col("shares") > 1).alias("split"), "word", "n", F.explode(cells).alias("cell"))
    rows = rows.select(*keys, "cell.i", "cell.j", "split", "word", "n", "cell.member", "cell.asked")
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


class PositionIndex:
    """Bitsets over words of L and L + 1 letters: for each position and letter the words that have it there."""

    def __init__(self, letters: np.ndarray, shorter: int) -> None:
        """``letters``: a row of L + 1 bytes for each word, 0 after the end of a shorter one."""
        self.shorter = shorter
        self.width = -(-max(1, len(letters)) // 64)
        self.rows: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        for column in letters.T:
            present = np.unique(column[column > 0])
            at = np.zeros(256, np.int64)
            at[present] = np.arange(1, len(present) + 1)
            rows = np.zeros((len(present) + 1, self.width), np.uint64)
            rows[1:] = self._bits(column[None, :] == present[:, None])
            self.rows.append(rows)
            self.at.append(at)
        ends = letters[:, shorter] == 0
        self.short, self.long = self._bits(ends[None, :])[0], self._bits(~ends[None, :])[0]

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.width * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def _has(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the bitset of the words with it at the position."""
        return self.rows[position][self.at[position][letters]]

    def near(self, asked: np.ndarray, longer: bool, front: bool) -> np.ndarray:
        """Bitsets of the words one edit from each word asked for, all of L letters or all of L + 1.

        Of pairs that agree in the first L / 2 letters if ``front``, else of the others.
        """
        shape = (len(asked), self.width)
        same = np.full(shape, ~np.uint64(0))
        half = np.zeros(shape, np.uint64)
        if longer:
            less = np.zeros(shape, np.uint64)  # one letter of the word asked for is left out
            for i in range(self.shorter + 1):
                less = less & self._has(i - 1, asked[:, i]) | same if i else same.copy()
                same &= self._has(i, asked[:, i])
                if i + 1 == self.shorter // 2:
                    half = same.copy()
            found = less & self.short
        else:
            other = np.zeros(shape, np.uint64)  # one letter is replaced
            more = same.copy()  # one letter of the index's word is left out
            for i in range(self.shorter):
                here = self._has(i, asked[:, i])
                other = other & here | same & ~here
                same &= here
                more = more & self._has(i + 1, asked[:, i]) | same
                if i + 1 == self.shorter // 2:
                    half = same.copy()
            found = other & self.short | more & self.long
        return found & half if front else found & ~half


def _first_bits(sets: np.ndarray) -> np.ndarray:
    """The place of the first bit of every (non-empty) bitset."""
    block = (sets != 0).argmax(axis=1)
    word = sets[np.arange(len(sets)), block]
    return block * 64 + np.bitwise_count((word & -word) - np.uint64(1)).astype(np.int64)


def _ask(shorter: int, front: bool, words: list[str], n: np.ndarray, member: np.ndarray, asked: np.ndarray) -> list[tuple]:
    """(word, near words, best near word, its n) of the words asked for that have near words in the index."""
    coded = np.array([w.encode("latin-1") for w in words], dtype=f"S{shorter + 1}")
    inside = np.flatnonzero(member)
    inside = inside[np.lexsort((coded[inside], -n[inside]))]
    letters = coded.view(np.uint8).reshape(len(coded), shorter + 1)
    index = PositionIndex(letters[inside], shorter)
    out = []
    for longer in (False, True):
        turn = np.flatnonzero(asked & ((letters[:, shorter] > 0) == longer))
        for at in range(0, len(turn), ASKED):
            part = turn[at : at + ASKED]
            sets = index.near(letters[part], longer, front)
            counts = np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(counts)
            if len(some):
                best = inside[_first_bits(sets[some])]
                out += [(words[a], k, words[b], m) for a, k, b, m in zip(part[some].tolist(), counts[some].tolist(), best.tolist(), n[best].tolist())]
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best (near word of largest n, ties: first) and best_n of the words that have near words."""
    names = ["word", "n_near", "best", "best_n"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                (shorter, front), words = held[0][:2], [r[6] for r in held]
                n = np.array([r[7] for r in held], np.int64)
                member, asked = (np.array([r[k] for r in held], bool) for k in (8, 9))
                out = _ask(shorter, front, words, n, member, asked)
                held.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # Cells stay whole; those of a split shard are on their own, others of one kind share an index.
                if held and row[:5] != held[-1][:5]:
                    full = len(held) * max(16, row[0] + 1) >= LETTERS
                    if row[:2] != held[0][:2] or row[5] or held[-1][5] or full:
                        yield from settle()
                held.append(row)
        yield from settle()

    found = shards(vocabulary).mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """The ends of the chains of rows (word, form), by pointer doubling: rows (word, root)."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored(
            now.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(documents: DataFrame, slip: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    vocabulary = stored(word_counts(documents, slip).where(F.col("n") >= COUNT))
    good = F.col("best_n") >= 2 * F.col("n")
    words = stored(
        vocabulary.join(near_words(vocabulary), "word", "left").select(
            "word",
            F.when(good, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(good, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(words.where("form is not null"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), slip=97)
