"""Exact Jaccard self-join of word-shingle sets, by a token-group matrix.

Documents link when intersection >= ``percent`` / 100 of the union of their
shingle sets. The result is one row per document with its component.

1. *Signatures.* All tokens have one order, tokens that blocks of texts repeat
   often last. Linked sets share at least percent / 100 of either set, so they
   meet in their first |set| - ceil(percent * |set| / 100) + 1 tokens, which
   are a set's signatures. Sets that share none are never compared and lose no
   link; common passages and phrases come last and bring few sets together.
2. *Equal sets* are one node from here on.
3. *Stars.* Within a signature every set is compared with one set only, the
   smallest; links found so join most copies without pairs within a group.
4. *Token-group matrix.* Sets that share a signature but not a component are
   partitioned into groups of similar sets (same component or same star
   centre, about ``GROUP`` sets each). A set asks the groups that have one of
   about its size under one of its signatures. First they meet by parity bits
   alone: of the tokens of either set in each of some 2**k classes, whether they
   are odd in number. Classes that differ are at most the tokens that only one
   set has, so sets with too many of those cannot link. Queries and members that
   are left meet with their texts. A group keeps the union of its tokens.
   For a query set Q the bound |Q & union| >= percent / 100 * |Q| must hold if
   any member links to it; only groups that meet the bound are opened, their
   parts of ``PART`` sets are held to the same bound, and the members of those
   that meet it compared one by one, one link for each local component.

Whole texts and all tokens take part; sets are compared by 64-bit hashes.
Texts travel compressed to the comparison, and only those with a candidate; groups
meet in rounds, so that few texts or bits are on the way at a time.

Defined results: a null or empty text, or one without words, has no shingles
and links with nothing, not even another empty one; a text with fewer words
than a shingle is one shingle. Rows are nodes by their set, so repeated rows,
repeated ids and null ids are kept; ``component_id`` is the smallest non-null
doc_id of the component (null if it has none). Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from kilocast.llm.common import IdFilter, Words, blocks, bytes_of, connected, discard, distinct, mix, offsets_list, read, stored, tidy

#: Sets of a block that make a token a frequent one, and bits of the filter that holds those.
OFTEN = 3
FREQUENT_BITS = 1 << 24
GROUP = 512
PART = 64
QUERIES = 1024
#: Queries that meet groups in a round, in times of the texts: by their parity bits, and then by their texts.
TRAVEL = 8
TRAVEL_TEXTS = 1
#: Bytes of compressed texts whose pairs are compared at once; both sides are opened to a few times as much.
PACKED_BYTES = 1 << 18


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    words = Words(texts, lower=True)
    at, hashes = words.windows(n)
    edges = np.searchsorted(words.doc[at] if len(at) else at, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        found = hashes[edges[i] : edges[i + 1]]
        if not len(found) and words.first[i + 1] > words.first[i]:
            a, b = words.start[words.first[i]], words.end[words.first[i + 1] - 1]
            found = words.hashes(np.array([a]), np.array([b]))
        out.append(distinct(found))
    return out


def key_of(tokens: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit integer."""
    return int(mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def frequent_tokens(documents: DataFrame, shingle: int) -> IdFilter:
    """Tokens that ``OFTEN`` different sets of some block of texts have, in a filter of a fixed size.

    It only shapes the order of the tokens, which is the same for all sets
    whatever the filter holds.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            sets = shingle_sets([x or b"" for x in table.column("text").to_pylist()], shingle)
            different = {key_of(s): s for s in sets if len(s)}
            if different:
                tokens, counts = np.unique(np.concatenate(list(different.values())), return_counts=True)
                often = tokens[counts >= OFTEN].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64())], ["token"])

    found = documents.select(bytes_of("text")).mapInArrow(run, "token long")
    return IdFilter.of(found, "token", FREQUENT_BITS)


def prefix(tokens: np.ndarray, frequent: IdFilter, percent: int) -> np.ndarray:
    """The first tokens of a set in the common order, frequent ones last, that a linked set must meet."""
    count = len(tokens) - (percent * len(tokens) + 99) // 100 + 1
    order = (tokens >> np.uint64(1)) | (frequent.has(tokens).astype(np.uint64) << np.uint64(63))
    return tokens[np.argpartition(order, count - 1)[:count]]


def sketch(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, size, key (hash of the set, null if empty) and the prefix tokens of every document."""
    held = documents.sparkSession.sparkContext.broadcast(frequent_tokens(documents, shingle))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for table in blocks(batches):
            sets = shingle_sets([x or b"" for x in table.column("text").to_pylist()], shingle)
            found = [prefix(s, frequent, percent) if len(s) else s for s in sets]
            out = pa.table(
                {
                    "doc_id": table.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "key": pa.array([key_of(s) if len(s) else None for s in sets], pa.int64()),
                    "signatures": offsets_list(
                        np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64), np.array([len(x) for x in found]), pa.int64()
                    ),
                }
            )
            yield from out.to_batches()

    return documents.select("doc_id", bytes_of("text")).mapInArrow(
        run, "doc_id long, n_shingles long, key long, signatures array<long>"
    )


def parity(tokens: np.ndarray) -> bytes:
    """For each class of tokens, by their low bits, whether their number is odd; at least as many classes as tokens, 64 at least."""
    classes = max(64, 1 << (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits, 64 in an item of the last axis, brought to fewer classes."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def packed_texts(documents: DataFrame, wanted: IdFilter, shingle: int) -> DataFrame:
    """key, compressed text, size and parity bits of the documents that may be wanted; one row for each key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for table in blocks(batches):
            ids = table.column("doc_id").to_pylist()
            open_ = wanted.has(np.array([x or 0 for x in ids], np.int64)) if ids else np.zeros(0, bool)
            texts = [t or b"" for t, x, o in zip(table.column("text").to_pylist(), ids, open_) if o or x is None]
            sets = shingle_sets(texts, shingle) if texts else []
            rows = [(key_of(s), zip_.compress(t), len(s), parity(s)) for s, t in zip(sets, texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                ["key", "packed", "size", "parity"],
            )

    found = documents.select("doc_id", bytes_of("text")).mapInArrow(run, "key long, packed binary, size long, parity binary")
    return found.groupBy("key").agg(*[F.first(name).alias(name) for name in ("packed", "size", "parity")])


def _unpack(packed: list[bytes], shingle: int) -> list[np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    return shingle_sets([unzip.decompress(bytes(x)) for x in packed], shingle)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets link."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "packed_b", PACKED_BYTES):
            a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
            firsts = dict(zip(a, table.column("packed_a").to_pylist()))
            known = dict(zip(firsts, _unpack(list(firsts.values()), shingle)))
            others = _unpack(table.column("packed_b").to_pylist(), shingle)
            good = [(x, y) for x, y, s in zip(a, b, others) if _linked(known[x], s, percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"]
            )

    rows = pairs.join(texts.select(F.col("key").alias("b"), F.col("packed").alias("packed_b")), "b").join(
        texts.select(F.col("key").alias("a"), F.col("packed").alias("packed_a")), "a"
    )
    return rows.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


def _meeting(candidates: DataFrame, groups: DataFrame, carried: DataFrame) -> PandasCogroupedOps:
    """Queries and members by group and share, each with its row of ``carried`` (key, ...).

    ``candidates``: (q, q_comp, gid); ``groups``: (gid, key, comp). Queries of a
    group are cut into shares of about ``QUERIES``; the members, about
    ``GROUP``, go to each share.
    """
    shares = candidates.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
    own = [F.col(name).alias(name) for name in carried.drop("key").columns]
    asked = (
        candidates.join(shares, "gid")
        .withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")))
        .drop("shares")
        .join(carried.select(F.col("key").alias("q"), *own), "q")
    )
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    held = groups.join(shares, "gid").join(carried, "key").select("gid", share, "key", "comp", *carried.drop("key").columns)
    return asked.groupBy("gid", "share").cogroup(held.groupBy("gid", "share"))


def near_groups(candidates: DataFrame, groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Queries (asks) and members (not asks) that their sizes and parity bits do not rule out, as rows (gid, key, comp, asks).

    Sets link if (100 + percent) * different <= (100 - percent) * (size + size),
    where ``different`` counts the tokens that only one of them has.
    """

    def match(_, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        asking, found = np.zeros(len(queries), bool), np.zeros(len(members), bool)
        if len(queries) and len(members):
            sides = [
                {words: np.flatnonzero(side.parity.map(len) == 8 * words) for words in (side.parity.map(len) // 8).unique()}
                for side in (queries, members)
            ]
            for (words, rows), (others, cols) in product(sides[0].items(), sides[1].items()):
                least = min(words, others)
                bits, held = (
                    folded(np.frombuffer(b"".join(side.parity.iloc[at]), np.uint64).reshape(len(at), -1), least)
                    for side, at in ((queries, rows), (members, cols))
                )
                sizes, comps, keys = (members[name].to_numpy()[cols] for name in ("size", "comp", "key"))
                low, high = sizes.min(), sizes.max()
                for i, size, comp, key, own in zip(
                    rows, queries["size"].to_numpy()[rows], queries.q_comp.to_numpy()[rows], queries.q.to_numpy()[rows], bits
                ):
                    if 100 * size < percent * low or 100 * high < percent * size:
                        continue
                    different = np.maximum(np.bitwise_count(held ^ own).sum(axis=1, dtype=np.int64), np.abs(sizes - size))
                    good = ((100 + percent) * different <= (100 - percent) * (sizes + size)) & (comps != comp) & (keys != key)
                    if good.any():
                        asking[i] = True
                        found[cols[good]] = True
        return pd.DataFrame(
            {
                "gid": np.concatenate([queries.gid.to_numpy()[asking], members.gid.to_numpy()[found]]),
                "key": np.concatenate([queries.q.to_numpy()[asking], members.key.to_numpy()[found]]),
                "comp": np.concatenate([queries.q_comp.to_numpy()[asking], members.comp.to_numpy()[found]]),
                "asks": np.arange(asking.sum() + found.sum()) < asking.sum(),
            }
        )

    return _meeting(candidates, groups, texts.select("key", "size", "parity")).applyInPandas(
        match, "gid long, key long, comp long, asks boolean"
    )


def matched(candidates: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between query sets and the members of the groups that their token unions do not rule out."""

    def match(_, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            sets = _unpack(list(members.packed), shingle)
            comps, keys = members.comp.to_list(), members.key.to_list()
            parts = [range(i, min(i + PART, len(sets))) for i in range(0, len(sets), PART)]
            unions = [distinct(np.concatenate([sets[i] for i in part])) for part in parts]
            union = distinct(np.concatenate(unions))
            for q, comp, tokens in zip(queries.q, queries.q_comp, _unpack(list(queries.packed), shingle)):
                if 100 * _common(tokens, union) < percent * len(tokens):
                    continue
                done = {comp}
                for part, inner in zip(parts, unions):
                    if 100 * _common(tokens, inner) < percent * len(tokens):
                        continue
                    for i in part:
                        if comps[i] not in done and keys[i] != q and _linked(tokens, sets[i], percent):
                            out.append((q, keys[i]))
                            done.add(comps[i])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _meeting(candidates, groups, texts.select("key", "packed")).applyInPandas(match, "a long, b long")


def in_rounds(candidates: DataFrame, groups: DataFrame, most: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Candidates and groups, group by group, in rounds of about ``most`` candidates.

    So the disk that a round takes follows ``most``, not the number of candidates.
    """
    rounds = max(1, math.ceil(candidates.count() / max(1, most)))
    turn = F.pmod(F.xxhash64("gid", F.lit(rounds)), F.lit(rounds))
    for i in range(rounds):
        yield candidates.where(turn == i), groups.where(turn == i)


def open_groups(candidates: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> list[DataFrame]:
    """The stored links between queries and members of groups: those left by ``near_groups`` meet with their texts."""
    near = stored(near_groups(candidates, groups, texts, percent))
    asking = near.where("asks").select(F.col("key").alias("q"), F.col("comp").alias("q_comp"), "gid")
    hosts = stored(near.where("not asks").select("gid", "key", "comp").distinct())
    left = stored(texts.select("key", "packed").join(near.select("key").distinct(), "key", "left_semi"))
    most = TRAVEL_TEXTS * texts.count()
    links = [stored(matched(c, g, left, shingle, percent)) for c, g in in_rounds(asking, hosts, most)]
    discard(near, hosts, left)
    return links


def opened(candidates: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> list[DataFrame]:
    """The stored links of ``open_groups``, group by group in rounds."""
    rounds = in_rounds(candidates, groups, TRAVEL * texts.count())
    return [links for c, g in rounds for links in open_groups(c, g, texts, shingle, percent)]


def components(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and cluster (a key of the component, null for empty sets) of every document."""
    docs = stored(sketch(documents, shingle, percent))
    full = docs.where(F.col("key").isNotNull())
    nodes = stored(
        full.groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("signatures").alias("signatures")
        )
    )
    spread = nodes.select(F.explode("signatures").alias("signature"), "key", "size")
    shared = spread.groupBy("signature").agg(F.min("key").alias("centre"), F.max("key").alias("last")).where("centre <> last")
    members = stored(spread.join(shared.select("signature", "centre"), "signature"))

    pairs = members.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    stars = stored(
        pairs.join(nodes.select(F.col("key").alias("a"), F.col("size").alias("size_a")), "a")
        .join(nodes.select(F.col("key").alias("b"), F.col("size").alias("size_b")), "b")
        .where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        .select("a", "b")
    )
    involved = members.select("key").distinct()
    wanted = IdFilter.of(nodes.join(involved, "key", "left_semi").select("doc_id"), "doc_id")
    texts = stored(packed_texts(documents, wanted, shingle))
    links = stored(verified(stars, texts, shingle, percent))
    discard(stars)
    joined = stored(connected(links))

    # Sets that share a signature and not yet a component: the token-group matrix.
    placed = members.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    several = placed.groupBy("signature").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    unsettled = stored(placed.join(several.select("signature"), "signature", "left_semi"))
    discard(members)
    sizes = joined.groupBy("comp").count().where(F.col("count") >= GROUP).select("comp", F.lit(True).alias("large"))
    homes = (
        unsettled.groupBy("key", "comp")
        .agg(F.min("centre").alias("centre"))
        .join(sizes, "comp", "left")
        .withColumn("home", F.when(F.col("large"), F.xxhash64("comp", F.lit(1))).otherwise(F.xxhash64("centre", F.lit(2))))
    )
    chunks = homes.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    groups = stored(
        homes.join(chunks, "home").select(
            F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("chunks"))).alias("gid"), "key", "comp"
        )
    )
    # Linked sets differ little in size, so a group's sets of a signature are taken by bands of sizes.
    cells = (
        unsettled.select("signature", "key", "size")
        .join(groups, "key")
        .groupBy("signature", "gid", F.floor(F.log(F.col("size")) * (100 / max(1, 100 - percent))).alias("band"))
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.min("key").alias("least"),
            F.min("size").alias("small"),
            F.max("size").alias("big"),
        )
    )
    # A pair is looked at from its larger key.
    candidates = (
        unsettled.select("signature", F.col("key").alias("q"), F.col("comp").alias("q_comp"), "size")
        .join(cells, "signature")
        .where("least < q and not (low = q_comp and high = q_comp)")
        .where((100 * F.col("big") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("small")))
        .select("q", "q_comp", "gid")
        .distinct()
    )
    candidates = stored(candidates)
    discard(unsettled)
    more = opened(candidates, groups, texts, shingle, percent)
    final = connected(reduce(DataFrame.union, more, links))
    discard(candidates, groups, texts, links, joined, *more)

    known = nodes.select("key", "doc_id").join(final.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("comp", F.coalesce("comp", "key"))
    lowest = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_key = known.join(lowest, "comp").select("key", "component_id", F.col("comp").alias("cluster"))
    return docs.join(of_key, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "cluster",
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=90).drop("cluster")
