"""Near-duplicate documents by min-hashes with tensored banding.

Documents link when intersection >= ``percent`` / 100 of the union of their
sets of word shingles; a group of linked documents keeps its smallest doc_id.

1. *Two collections.* Of each set two collections of m keys are made, u and v,
   each key from ``PART`` min-hashes. The table (i, j) has the key (u_i, v_j):
   m * m tables of 2 * ``PART`` min-hashes a key from only 2 * m * ``PART``
   min-hashes in all. Two sets of likeness s share no table with probability
   at most 2 * (1 - s ** ``PART``) ** m; m is the smallest for which this is
   at most ``miss`` at the threshold (21 at 0.8, for one in a million).
2. *Equal sets* are one node from here on.
3. *Tables.* Keys of a table need a shared u_i, so first nodes meet by u_i
   and only those that meet anyone get the keys (u_i, v_j). Groups that hold
   the same nodes count once: near copies share most of their keys.
4. *Stars.* Every node of a key is verified against one of them, the one that
   meets most others by its u: the text that copies were made from meets more
   of them than they meet each other.
5. *The rest.* For nodes that share a u_i, but no component after that, the
   shingles are counted that any other of them has too. No set has more in
   common with another than these, so sets that are alone in too many of
   their shingles are settled; far copies of one text mostly are. The others
   are compared by their u and v: within the groups of a u, in squares of
   blocks of ``BLOCK`` nodes; those of groups with more blocks than a node
   has v by table, in squares as well. Pairs
   without an equal v_j, of too different sizes, with too few shared shingles
   or with too few equal ones of ``MARKS`` more min-hashes (a linked pair has
   as few with probability ``miss``) go. A pair that meets in several groups
   is taken in one, that of the smallest equal u and v, and verified.

Verification compares whole shingle sets, as sets of 64-bit hashes of whole
texts; only texts with a candidate travel, compressed, in shares of ``SHARE``
beside one text that they are compared with. No link is reported that does not
hold, and one is missed only if min-hashing misses it (``miss``) and no other
path joins the two.

Defined results: a null or empty text, or one without words, has no shingles,
links with nothing and is kept; a text with fewer words than a shingle is one
shingle. Repeated rows and ids are kept as rows; ``component_id`` is the
smallest non-null doc_id of the component (null if it has none), and a row is
kept if its doc_id is the component's. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import IdFilter, Words, blocks, bytes_of, connected, discard, mix, read, stored

PART = 3
MISS = 1e-6
BLOCK = 1024
SHARE = 256
#: Bytes of text that a task works on at once; an executor's tasks share its memory with Spark.
BYTES = 1 << 20
#: Further min-hashes, a byte each, of the texts that stars have not settled.
MARKS = 512
_SEED = 20


def collections_of(percent: int, miss: float) -> int:
    """Keys in each of the two collections."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** PART))


def least_equal(percent: int, miss: float) -> int:
    """Equal bytes of ``MARKS`` that a linked pair has but for the probability ``miss``."""
    p = percent / 100 + (1 - percent / 100) / 256
    total, k = 0.0, 0
    while True:
        total += math.comb(MARKS, k) * p**k * (1 - p) ** (MARKS - k)
        if total > miss:
            return k
        k += 1


def factors_of(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors: a hash times one of them is another hash."""
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin (one more than texts)."""
    words = Words(texts, lower=True)
    at, hashes = words.windows(n)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence
        first, last = words.first[short], words.first[short + 1] - 1
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, words.hashes(words.start[first], words.end[last])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def keys_of(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with shingles, and a hash of the whole set of each."""
    full = np.flatnonzero(np.diff(edges))
    if not len(full):
        return full, np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(hashes), edges[full])
    return full, mix(sums + np.diff(edges)[full].astype(np.uint64)).view(np.int64)


def banded(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """For every set, beginning at ``starts``, its ``count`` keys of ``PART`` min-hashes each."""
    factors = factors_of(count * PART, _SEED)
    out = np.zeros((count, len(starts)), np.uint64)
    for k, factor in enumerate(factors):
        low = np.minimum.reduceat(hashes * factor, starts)
        out[k // PART] = mix(out[k // PART] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out.T


def sketch(documents: DataFrame, shingle: int, count: int) -> DataFrame:
    """doc_id, n_shingles, key (hash of the set, null if empty), u and v of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, size=BYTES):
            hashes, edges = shingle_sets([x or b"" for x in table.column("text").to_pylist()], shingle)
            full, found = keys_of(hashes, edges)
            keys, here = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, bool)
            keys[full], here[full] = found, True
            bands = np.zeros((table.num_rows, 2 * count), np.uint64)
            if len(full):
                bands[full] = banded(hashes, edges[full], 2 * count)
            # A key tells its place in the collection, so that equal ones are of one place.
            bands = mix(bands ^ np.arange(1, 2 * count + 1, dtype=np.uint64))
            u, v = (
                pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(half).view(np.int64).ravel()), count).cast(pa.list_(pa.int64()))
                for half in (bands[:, :count], bands[:, count:])
            )
            sizes = pa.array(np.diff(edges), pa.int64())
            out = pa.table({"doc_id": table.column("doc_id"), "n_shingles": sizes, "key": pa.array(keys, pa.int64(), mask=~here), "u": u, "v": v})
            yield from out.to_batches()

    return documents.select("doc_id", bytes_of("text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, key long, u array<long>, v array<long>"
    )


def distinct_groups(rows: DataFrame, name: str, *within: str) -> DataFrame:
    """The rows (``within``, ``name``, key) of groups of at least two keys; of groups of the same keys the smallest ``name``."""
    groups = rows.groupBy(*within, name).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    chosen = groups.where("low <> high").groupBy(*within, "n", "x", "low", "high").agg(F.min(name).alias(name))
    return rows.join(chosen.select(*within, name), [*within, name], "left_semi")


def first_groups(nodes: DataFrame) -> DataFrame:
    """Rows (u, key): the nodes that meet others by a key of the first collection."""
    return distinct_groups(nodes.select("key", F.explode("u").alias("u")), "u")


def tables(firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (u, v, key, degree): the keys of all tables that several nodes share, and how often a node meets others by its first keys."""
    sizes = firsts.groupBy("u").agg(F.count("*").alias("n"))
    degrees = firsts.join(sizes, "u").groupBy("key").agg(F.sum("n").alias("degree"))
    # Joined before the tables are spelt out, of which a node has many times as many.
    met = stored(firsts.join(degrees.join(nodes.select("key", "v"), "key"), "key"))
    cells = stored(distinct_groups(met.select("u", "key", "degree", F.explode("v").alias("v")), "v", "u"))
    discard(met)
    return cells


def centred(cells: DataFrame) -> DataFrame:
    """Pairs (a, b): the nodes b of a table's key and its centre a, the node that meets most others by their first keys."""
    centres = cells.groupBy("u", "v").agg(F.max_by("key", F.struct("degree", "key")).alias("a"))
    return cells.join(centres, ["u", "v"]).where("a <> key").select("a", F.col("key").alias("b")).distinct()


def packed_texts(documents: DataFrame, wanted: IdFilter, shingle: int) -> DataFrame:
    """key and compressed text of the documents whose id may be wanted; one row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for table in blocks(batches, size=BYTES):
            ids = table.column("doc_id").to_pylist()
            open_ = wanted.has(np.array([x or 0 for x in ids], np.int64))
            texts = [t or b"" for t, x, o in zip(table.column("text").to_pylist(), ids, open_) if o or x is None]
            if texts:
                full, keys = keys_of(*shingle_sets(texts, shingle))
                packed = [zip_.compress(texts[i]) for i in full.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["key", "packed"])

    found = documents.select("doc_id", bytes_of("text")).mapInArrow(run, "key long, packed binary")
    return found.groupBy("key").agg(F.first("packed").alias("packed"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets link."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    heads = (
        shares.join(texts.withColumnRenamed("key", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "packed")
        .select("a", "share", F.lit(None).cast("long").alias("b"), "packed")
    )
    # Only centres of many pairs have several shares.
    others = (
        pairs.join(shares.where("shares > 1"), "a", "left")
        .withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1).cast("long"))))
        .join(texts.withColumnRenamed("key", "b"), "b")
        .select("a", "share", "b", "packed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, head = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        for table in blocks(batches, "packed", BYTES // 2):
            texts_ = [unzip.decompress(x) for x in table.column("packed").to_pylist()]
            hashes, edges = shingle_sets(texts_, shingle)
            good = []
            for i, (a, b) in enumerate(zip(table.column("a").to_pylist(), table.column("b").to_pylist())):
                own = hashes[edges[i] : edges[i + 1]]
                if b is None:  # the text that the next rows are compared with
                    head = own.copy()
                elif linked(head, own, percent):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"]
            )

    rows = heads.unionByName(others).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def shared_shingles(keys: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """key and shared: how many shingles of each of the nodes any other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for table in blocks(batches, "packed", BYTES // 2):
            hashes, edges = shingle_sets([unzip.decompress(x) for x in table.column("packed").to_pylist()], shingle)
            owner = np.repeat(table.column("key").to_numpy(), np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(hashes.view(np.int64))], ["key", "token"])

    tokens = stored(texts.join(keys, "key", "left_semi").mapInArrow(run, "key long, token long"))
    met = tokens.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    found = stored(tokens.join(met.select("token"), "token", "left_semi").groupBy("key").agg(F.count("*").alias("shared")))
    discard(tokens)
    return found


def marked(keys: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """key and marks: a byte of each of ``MARKS`` min-hashes of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, factors = zstandard.ZstdDecompressor(), factors_of(MARKS, _SEED + 1)
        for table in blocks(batches, "packed", BYTES // 2):
            hashes, edges = shingle_sets([unzip.decompress(x) for x in table.column("packed").to_pylist()], shingle)
            low = np.stack([np.minimum.reduceat(hashes * f, edges[:-1]) for f in factors], axis=1)
            marks = [row.tobytes() for row in mix(low).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(marks, pa.binary())], ["key", "marks"])

    return texts.join(keys, "key", "left_semi").mapInArrow(run, "key long, marks binary")


def unsettled(
    firsts: DataFrame, comps: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int, least: int
) -> DataFrame:
    """Pairs (a, b) of nodes that share a table, but not a component, and that nothing keeps from being linked; each once."""
    placed = firsts.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    def several(rows: DataFrame, *group: str) -> DataFrame:
        """The rows of groups with more than one component, with the number of their nodes."""
        found = rows.groupBy(*group).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
        return rows.join(found.where("low <> high").select(*group, "n"), [*group])

    open_ = several(placed, "u").drop("n")
    shared = shared_shingles(open_.select("key").distinct(), texts, shingle)
    known = nodes.select("key", "size", "v", F.concat("u", "v").alias("bands")).join(shared, "key")
    known = stored(known.where(100 * F.col("shared") >= percent * F.col("size")))
    open_ = stored(several(open_.join(known.select("key"), "key", "left_semi"), "u"))
    known = stored(known.join(marked(open_.select("key").distinct(), texts, shingle), "key"))
    open_ = open_.join(known.select("key", "size", "shared", "v", "bands", "marks"), "key").withColumn("parts", F.ceil(F.col("n") / BLOCK))
    own = ["key", "comp", "size", "shared", "bands", "marks"]
    # A node goes to as many squares as its group has blocks, or to those of a table for each of its v.
    by_table = F.col("parts") > F.size("v")
    small = open_.where(~by_table).select("u", F.lit(None).cast("long").alias("v"), "parts", *own)
    large = several(open_.where(by_table).select("u", F.explode("v").alias("v"), *own), "u", "v")
    rows = small.unionByName(large.select("u", "v", F.ceil(F.col("n") / BLOCK).alias("parts"), *own))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    # Parts i <= j of a group meet in the square (i, j).
    squares = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j")),
    )
    rows = rows.select("u", "v", F.explode(squares).alias("at"), "part", *own)
    rows = rows.select("u", "v", "at.i", "at.j", "part", *own)
    group = ["u", "v", "i", "j"]

    def smallest(equal: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.where(equal, values, np.iinfo(np.int64).max).min(axis=1)

    def compare(
        u: int,
        v: int | None,
        part: np.ndarray,
        key: np.ndarray,
        comp: np.ndarray,
        size: np.ndarray,
        shared: np.ndarray,
        bands: np.ndarray,
        marks: np.ndarray,
    ) -> Iterator[tuple]:
        """Of a square all pairs across its two parts, or within its one part, that belong here."""
        half = bands.shape[1] // 2
        ids, counts = np.unique(comp, return_counts=True)
        # A pair of two components has a node outside the largest.
        outside = comp != ids[counts.argmax()]
        two = part.min() != part.max()
        place = np.arange(len(key))
        for x in np.flatnonzero(outside).tolist():
            y = np.flatnonzero((comp != comp[x]) & (~outside | (place > x)) & ((part != part[x]) if two else True))
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[(100 + percent) * np.minimum(shared[y], shared[x]) >= percent * (size[y] + size[x])]
            y = y[(marks[y] == marks[x]).sum(axis=1) >= least]
            equal = bands[y] == bands[x]
            good = smallest(equal[:, :half], bands[x, :half]) == u
            first = smallest(equal[:, half:], bands[x, half:])
            good &= equal[:, half:].any(axis=1) if v is None else first == v
            y = y[good]
            if len(y):
                yield np.minimum(key[y], key[x]), np.maximum(key[y], key[x])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("u", "part", "key", "comp", "size", "shared")
        u, part, key, comp, size, shared = (table.column(c).to_numpy() for c in names)
        v = table.column("v").to_pylist()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(key), -1)
        ends = [*_cuts(table, group), len(key)]
        found = [
            pair
            for s, e in zip(ends[:-1], ends[1:])
            if e - s > 1
            for pair in compare(u[s], v[s], *(c[s:e] for c in (part, key, comp, size, shared, bands, marks)))
        ]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            # The last square may go on in the next batch.
            last = _cuts(table, group)[-1] if table.num_rows else 0
            if last:
                yield from settle(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def _cuts(table: pa.Table, columns: list[str]) -> list[int]:
    """Where runs of rows that are equal in the columns begin."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for name in columns:
        values = table.column(name).fill_null(0).to_numpy()
        new |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = stored(sketch(documents, shingle, collections_of(percent, miss)))
    nodes = stored(
        docs.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("u").alias("u"), F.first("v").alias("v"))
    )
    firsts = stored(first_groups(nodes))
    cells = tables(firsts, nodes)
    stars = centred(cells)
    sizes = nodes.select("key", "size")
    stars = stored(
        stars.join(sizes.toDF("a", "size_a"), "a")
        .join(sizes.toDF("b", "size_b"), "b")
        .where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        .select("a", "b")
    )
    members = firsts.select("key").distinct()
    wanted = IdFilter.of(nodes.join(members, "key", "left_semi").select("doc_id"), "doc_id")
    texts = stored(packed_texts(documents, wanted, shingle))
    links = stored(verified(stars, texts, shingle, percent))
    discard(cells)
    rest = unsettled(firsts, connected(links), nodes, texts, shingle, percent, least_equal(percent, miss))
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"))
    discard(firsts)
    more = stored(links.unionByName(verified(rest, texts, shingle, percent)))
    discard(texts, rest, stars, links)
    comps = connected(more)

    known = nodes.select("key", "doc_id").join(comps.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("comp", F.coalesce("comp", "key"))
    lowest = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_key = known.join(lowest, "comp").select("key", "component_id")
    found = docs.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op12_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)
