"""Benchmark decontamination on template windows.

Words lose the marks at their edges and become lower case; numbers, units
after a number and names become typed placeholders, so that a question asked
again with other values keeps its template. A name is a capitalised word, not
all in capitals, that does not open a sentence or line. Two canonical forms are used, one with names
as placeholders and one with names as words (for passages in another case).

Windows of ``WINDOW`` template tokens of documents and items are joined by
hash. A fixed-size filter over the items' windows keeps nearly all document
windows from the shuffle; it only ever lets more through. Windows that are
mostly placeholders count with their exact words in place of the template.

Slot consistency: the values that fill the placeholders of matched windows
must map one to one between document and item: a value of the item always
meets the same value in the document and the other way round, within a window
and over all matched windows of a copy. A window with conflicting slots is no
evidence. A document is contaminated by an item when
the consistent windows cover at least ``MIN_SHARE`` of the item's windows, or
when some of them make a passage of ``RUN`` words, however long the item is; an
item shorter than a window counts with its whole sequence, wherever in a
document it stands.

Defined results: a null or empty text or item is clean and matches nothing;
rows with a null doc_id are judged with the other rows of null id; repeated
rows give one row for each; items with equal texts are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilocast.llm.common import IdFilter, blocks, byte_sums, bytes_of, mix, mixed_letters, offsets_list, place_free, read, stored, tidy

WINDOW = 8
MIN_SHARE = 0.2
MIN_PLAIN = 4
RUN = 13
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg t oz lb lbs pound pounds ton tons ml l litre litres "
    "liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
    "years dollar dollars euro euros cent cents percent degree degrees mph kmh kph hz khz mhz ghz w kw mw v kb mb gb tb".split()
)
EDGES = bytes(c for c in range(33, 128) if not chr(c).isalnum())
_UNIT_BYTES = frozenset(unit.encode() for unit in UNITS)
NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*")
GLUED = re.compile(rb"([+-]?\d[\d.,]*)([a-z]+)")
PLAIN, NUM, UNIT, CAPITAL, GLUE = range(5)
EXACT = 2
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(WINDOW)], np.uint64)
_PLACEHOLDERS = mix(np.arange(16, dtype=np.uint64))


#: Windows that a task sends at once, and bytes of texts whose words it tells apart at once.
SLICE = 1 << 14
READ_BLOCK = 1 << 18

# Of bytes: white space, in lower case, what is left of a word without its edges, marks that may follow the end of a sentence, ends.
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_LETTERS = mixed_letters(np.where(_UPPER, _BYTES + 32, _BYTES))
_BARE = ~_SPACE & ~np.isin(_BYTES, list(EDGES))
_BEFORE_CLOSING = ~_SPACE & ~np.isin(_BYTES, list(b"\"')]}*&%$#"))
_SENTENCE_END = np.isin(_BYTES, list(b".!?:"))
# Words of other letters, and those that begin with a digit, are looked at one by one.
_DIGIT, _WIDE = (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128


_TAILS = [[bytes([kind, ends]) for ends in (0, 1)] for kind in range(16)]


def _digests(words: list[bytes]) -> np.ndarray:
    """The hashes of words in lower case."""
    ends = np.cumsum([0, *map(len, words)])
    sums, factors = byte_sums(np.frombuffer(b"".join(words), np.uint8), _LETTERS)
    return place_free(sums, factors, ends[:-1], ends[1:])


_UNIT_HASHES = np.sort(_digests(list(_UNIT_BYTES)))


class _Kinds(dict):
    """Of a word: hash, kind and whether it ends a sentence; 10 bytes, kept per Python worker, bounded."""

    def __missing__(self, word: bytes) -> bytes:
        self.learn([word])
        return self[word]

    def learn(self, words: Iterable[bytes]) -> None:
        """Take up new words, hashed all at once."""
        if len(self) > 250_000:
            self.clear()
        words = [w for w in words if w not in self]
        found = [self._parsed(w) for w in words]
        digests = _digests([low for low, _ in found]).tobytes()
        for i, (word, (_, tail)) in enumerate(zip(words, found)):
            self[word] = digests[8 * i : 8 * i + 8] + tail

    @staticmethod
    def _parsed(word: bytes) -> tuple[bytes, bytes]:
        """The word in lower case without its edges, and its kind and end."""
        bare = word.strip(EDGES)
        letters = bare if bare.isascii() else bare.decode("utf-8", "replace")
        low = bare.lower() if letters is bare else letters.lower().encode()
        kind = PLAIN
        if low[:1].isdigit():  # signs are marks at the edge
            if NUMBER.fullmatch(low):
                kind = NUM
            elif (glued := GLUED.fullmatch(low)) and glued[2] in _UNIT_BYTES:
                kind = GLUE
        elif low in _UNIT_BYTES:
            kind = UNIT
        elif letters[:1].isupper() and not letters.isupper():
            kind = CAPITAL
        # What ends a sentence is a mark, too.
        ends = len(bare) < len(word) and word.rstrip(b"\"')]}*&%$#")[-1:] in (b".", b"!", b"?", b":")
        return low, _TAILS[kind + 8 * (not bare)][ends]


_KINDS = _Kinds()


def _forget() -> None:
    """Python workers live on after a task, and other operators' tasks want their memory."""
    _KINDS.clear()


_DTYPE = np.dtype([("hash", "<u8"), ("kind", "u1"), ("ends", "u1")])


def _before(marked: np.ndarray) -> np.ndarray:
    """How many are marked before each place."""
    return np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])


def words_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text its words' hashes and kinds, and whether they open a sentence or line."""
    data = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[buffer]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    start, end = turns[::2], turns[1::2]
    bare, at = _before(_BARE[buffer]), np.flatnonzero(_BARE[buffer])
    full = bare[end] > bare[start]
    first, last = start.copy(), end.copy()
    first[full], last[full] = at[bare[start[full]]], at[bare[end[full]] - 1] + 1
    sums, factors = byte_sums(buffer, _LETTERS)
    each = np.empty(len(start), _DTYPE)
    each["hash"] = place_free(sums, factors, first, last)
    unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, each["hash"]), len(_UNIT_HASHES) - 1)] == each["hash"]
    low = _before(_LOWER[buffer])
    name = _UPPER[buffer[first]] & (low[last] > low[first])
    each["kind"] = np.select([~full, unit, name], [PLAIN + 8, UNIT, CAPITAL], PLAIN)
    # What ends a sentence is a mark, too.
    closing, at = _before(_BEFORE_CLOSING[buffer]), np.flatnonzero(_BEFORE_CLOSING[buffer])
    some = np.flatnonzero(closing[end] > closing[start])
    each["ends"] = 0
    each["ends"][some] = _SENTENCE_END[buffer[at[closing[end[some]] - 1]]]
    wide = _before(_WIDE[buffer])
    odd = np.flatnonzero((wide[end] > wide[start]) | (full & _DIGIT[buffer[first]]))
    if len(odd):
        words = [data[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist())]
        _KINDS.learn(set(words))
        each[odd] = np.frombuffer(b"".join(map(_KINDS.__getitem__, words)), _DTYPE)
    opens = np.diff(np.cumsum(buffer == 10, dtype=np.int32)[start], prepend=-1) > 0
    opens[1:] |= each["ends"][:-1] == 1
    cuts = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    hashes, kinds = each["hash"].copy(), each["kind"].copy()
    return [(hashes[a:b], kinds[a:b], opens[a:b]) for a, b in pairwise(cuts)]


def tokens(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each word of a text: its hash, its token with names as words, its token with names as placeholders.

    If names of the text also open sentences, a fourth has those as placeholders too.
    """
    each, kind, opens = words
    full = kind < 8  # a word of marks alone is no token
    h, kind = each[full], kind[full]
    # Marks alone may stand between the end of a sentence and its next word.
    seen = np.cumsum(opens)[full]
    opened = np.diff(seen, prepend=0) > 0
    opener = (kind == CAPITAL) & opened
    # One that is a name inside another sentence is a name here too, in a form of its own.
    named_opener = opener & np.isin(h, h[(kind == CAPITAL) & ~opened]) if opener.any() else opener
    kind[opener] = PLAIN
    after = np.concatenate([[False], kind[:-1] == NUM])
    kind[(kind == UNIT) & ~after] = PLAIN
    plain = np.where((kind == PLAIN) | (kind == CAPITAL), h, kind.astype(np.uint64))
    named = np.where(kind == PLAIN, h, kind.astype(np.uint64))
    if not named_opener.any():
        return h, plain, named
    return h, plain, named, np.where(named_opener, np.uint64(CAPITAL), named)


def _hashed(mixed: np.ndarray, size: int, form: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``size`` tokens, scrambled, that begin at the given places."""
    if 2 * len(at) > len(mixed):  # most of them: all at once
        n = len(mixed) - size + 1
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total += mixed[i : i + n] * _POWERS[i]
        return mix(total[at] ^ np.uint64(form))
    total = np.full(len(at), size, np.uint64)
    for i in range(size):
        total += mixed[at + i] * _POWERS[i]
    return mix(total ^ np.uint64(form))


def windows(text: bytes, sizes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a text: hash, form, position and size of each, and the hashes of the words.

    ``sizes`` are the window sizes of a document; an item has one size, its own length if that is under ``WINDOW``.
    """
    return windows_of(words_of([text])[0], sizes)


def windows_of(words: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """``windows`` of a text whose words are known."""
    h, *forms = tokens(words)
    mixed = mix(h)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in sizes or (min(WINDOW, len(h)),):
        if not 0 < size <= len(h):
            continue
        most = size - min(MIN_PLAIN, size)
        for form, token in enumerate(forms):
            slot = token < 16
            slots = np.concatenate([[0], np.cumsum(slot)])
            held = slots[size:] - slots[:-size]
            if not form:
                # The first word of an item may be a unit that the document's number before it makes a slot.
                exact = np.flatnonzero(held > most - bool(sizes))
            elif not (forms[0] != token).any():  # the same as the first form
                continue
            at = np.flatnonzero(held <= most)
            if form == 2:  # only where it differs; its windows are of the form with names as placeholders
                changed = np.concatenate([[0], np.cumsum(token != forms[1])])
                at = at[changed[at + size] > changed[at]]
            form = min(form, 1)
            # All but the placeholders are words' hashes.
            scrambled = mixed.copy()
            scrambled[slot] = _PLACEHOLDERS[token[slot]]
            found.append((_hashed(scrambled, size, form, at), np.full(len(at), form), at, np.full(len(at), size)))
        found.append((_hashed(mixed, size, EXACT, exact), np.full(len(exact), EXACT), exact, np.full(len(exact), size)))
    return *(np.concatenate(x) for x in zip(*found)), h


def spread(table: DataFrame, key: str, wanted: IdFilter | None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """A row for each template window: key, row, window, form, position, its words' hashes and the text's windows."""
    held = table.sparkSession.sparkContext.broadcast(wanted)

    names = ("window", "form", "spot", "n_windows")

    def rows(keys: list, parts: list[tuple[np.ndarray, ...]]) -> list[pa.RecordBatch]:
        *columns, words, lengths = (np.concatenate(x) for x in zip(*parts))
        lists = offsets_list(words.view(np.int64), lengths, pa.int64())
        arrays = [pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in columns), lists]
        return pa.table(arrays, names=["key", *names, "words"]).to_batches()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        try:
            for block in blocks(batches, size=READ_BLOCK):
                keys, parts = [], []
                for key_, words in zip(block.column(0).to_pylist(), words_of([x or b"" for x in block.column("text").to_pylist()])):
                    hashes, forms, spots, lengths, h = windows_of(words, sizes)
                    keep = np.flatnonzero(filter_.has(hashes)) if filter_ else np.arange(len(hashes))
                    for i in range(0, len(keep), SLICE):
                        some = keep[i : i + SLICE]
                        at, n = spots[some], lengths[some]
                        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        count = np.full(len(some), max(1, len(h) - WINDOW + 1))
                        keys += [key_] * len(some)
                        parts.append((hashes[some].view(np.int64), forms[some], at, count, h[np.repeat(at, n) + inside], n))
                        if len(keys) >= SLICE:
                            yield from rows(keys, parts)
                            keys, parts = [], []
                if parts:
                    yield from rows(keys, parts)
        finally:
            _forget()

    return (
        table.select(key, bytes_of("text"))
        .mapInArrow(run, "key long, window long, form long, spot long, n_windows long, words array<long>")
        .withColumnRenamed("key", key)
    )


def one_to_one(matched: DataFrame) -> DataFrame:
    """The matched windows whose words keep to one map between item and document in the whole copy.

    A copy is the windows of a document and an item whose offsets lie within
    half an item of each other. A pair of words holds if it fills over half of
    the item's places that either word has in the copy. Exact windows always count.
    """
    copy = ["doc_id", "item_id", "_copy"]
    lined = matched.withColumn("_line", F.col("doc_spot") - F.col("spot")).repartition("doc_id", "item_id")
    along = Window.partitionBy("doc_id", "item_id").orderBy("_line", "spot")
    apart = F.col("_line") - F.lag("_line").over(along) > F.greatest(F.lit(WINDOW), F.col("n_windows") / 2)
    copies = (
        lined.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("_copy", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_exact", F.col("doc_words") == F.col("item_words"))
        .withColumn("_whole", F.min("_exact").over(Window.partitionBy(*copy)))
        .select("*", F.posexplode_outer(F.when(~F.col("_whole"), F.arrays_zip("item_words", "doc_words"))).alias("_at", "_pair"))
    )

    def among(*names: str) -> Column:
        places = F.collect_set(F.col("spot") + F.col("_at"))
        return F.size(places.over(Window.partitionBy(*copy, *(f"_pair.{n}" for n in names))))

    holds = (2 * among("item_words", "doc_words") > among("item_words")) & (
        2 * among("item_words", "doc_words") > among("doc_words")
    )
    return (
        copies.withColumn("_holds", F.col("_exact") | holds)
        .groupBy("doc_id", "item_id", "spot", "doc_spot")
        .agg(F.min("_holds").alias("_holds"), F.max("n_windows").alias("n_windows"))
        .where("_holds")
        .drop("_holds")
    )


def with_runs(matched: DataFrame) -> DataFrame:
    """The matched windows with ``run``: how many follow each other without a gap in both document and item."""
    line = ["doc_id", "item_id", "_line"]
    lined = matched.withColumn("_line", F.col("doc_spot") - F.col("spot")).repartition("doc_id", "item_id")
    placed = lined.withColumn("_start", F.col("spot") - F.row_number().over(Window.partitionBy(*line).orderBy("spot")))
    return placed.withColumn("run", F.count("*").over(Window.partitionBy(*line, "_start"))).drop("_line", "_start")


def leaks(documents: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, matched windows and share of the item's windows, for each contaminated document and item."""
    items = stored(spread(benchmark.select("item_id", "text"), "item_id", None))
    wanted = IdFilter.of(items.select("window").distinct(), "window", 1 << 24)
    # At most WINDOW numbers: the sizes of whole items that are shorter than a window.
    short = [r[0] for r in items.select(F.size("words")).distinct().collect()]
    found = spread(documents.select("doc_id", "text"), "doc_id", wanted, tuple(sorted({WINDOW, *short})))
    pairs = (
        found.drop("n_windows")
        .withColumnRenamed("words", "doc_words")
        .withColumnRenamed("spot", "doc_spot")
        .join(items.withColumnRenamed("words", "item_words"), ["window", "form"])
    )
    # Within a window, equal words of the item must meet equal words of the document, and the other way round.
    zipped = F.arrays_zip("doc_words", "item_words")
    consistent = (F.size("doc_words") == F.size("item_words")) & (
        F.size(F.array_distinct(zipped)) == F.size(F.array_distinct("doc_words"))
    ) & (F.size(F.array_distinct(zipped)) == F.size(F.array_distinct("item_words")))
    matched = pairs.where(consistent).dropDuplicates(["doc_id", "item_id", "spot", "doc_spot"])
    return (
        with_runs(one_to_one(matched))
        .groupBy("doc_id", "item_id", "spot")
        .agg(F.max("n_windows").alias("n_windows"), F.max("run").alias("run"))
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("matched"), F.max("n_windows").alias("n_windows"), F.max("run").alias("run"))
        .withColumn("share", F.col("matched") / F.col("n_windows"))
        .where((F.col("share") >= min_share) | (F.col("run") >= RUN - WINDOW + 1))
        .drop("n_windows", "run")
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Per document: doc_id, contaminated, the number of items found and the best matching one."""
    found = (
        leaks(documents, benchmark, min_share)
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_items"),
            F.max(F.struct("share", "matched", (-F.col("item_id")).alias("less"))).alias("best"),
        )
        .select(F.col("doc_id").alias("_id"), "n_items", (-F.col("best.less")).alias("item_id"), F.col("best.share").alias("share"))
    )
    return (
        documents.select("doc_id")
        .join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .select(
            "doc_id",
            F.col("n_items").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            "item_id",
            "share",
        )
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row for each item found in one; clean documents have no row."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))
