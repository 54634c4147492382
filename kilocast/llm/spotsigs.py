"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot signature is an anchor (a common word, or the beginning of a line) and
the chain of up to ``CHAIN`` content words that follow it before the next
anchor; what follows beyond that is cut into chains without an anchor. The set
of a text's signatures hardly changes when parts around it do.
Case and all marks between words are left out. The fingerprint is the size of
the set and its ``SIZE`` smallest 32-bit hashes as a string, which has a fixed
length for texts of any length; comparisons use the whole sets.

``likeness`` is the Jaccard index of two whole sets. With a threshold, sets are
in partitions by the logarithm of their length to the base of its reciprocal:
sets whose partitions are not neighbours cannot reach it and get 0 without a
look at their signatures, and so do those whose lengths alone rule it out.

The query needs every text beside the one that follows it. Texts are dealt by
ranges of doc_id, a few for each shuffle partition, and travel once; inside a
range the following text is that of the next row, and the last ids of a range
take the first text of the next range.

Defined results: a null or empty text, or one of marks alone, has an empty set;
two empty sets have likeness 0; rows with null doc_id have no next document
(their edited text is their own without the last quarter); of repeated doc_ids
the row with the smallest text is the next document; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kilocast.llm.common import read

CHAIN = 2
#: Hashes that a printed fingerprint shows.
SIZE = 64
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine er es ist mit nicht sich und von zu "
    "dans de du elle en est et la le les ne pas pour que qui sur un une "
    "al como con del el las lo los más no para por se su y"
).split()


def _anchor_pattern() -> str:
    """Anchors as one pattern, grouped by first letter so that few are tried at a place; a line's beginning is ``|``."""
    groups: dict[str, list[str]] = {}
    for word in sorted(set(ANCHORS), key=lambda w: (w[0], -len(w))):
        groups.setdefault(word[0], []).append(word[1:])
    return " (?=(?:[|]|" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in groups.items()) + ") )"


def signatures(text: Column) -> Column:
    """The distinct 32-bit hashes of a text's spot signatures, sorted."""
    lines = F.regexp_replace(F.translate(F.lower(text), "|", " "), r"[\n\r]+", " | ")
    plain = F.regexp_replace(F.concat(F.lit(" | "), lines, F.lit(" ")), r"[^\p{L}\p{N}|]+", " ")
    spots = F.filter(F.split(plain, _anchor_pattern()), lambda s: F.instr(F.trim(s), " ") > 0)
    words = F.lit(rf"\S+(?: \S+){{0,{CHAIN}}}")
    chains = F.flatten(F.transform(spots, lambda s: F.regexp_extract_all(s, words, F.lit(0))))
    low = F.lit(0xFFFFFFFF).cast("long")
    return F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c).bitwiseAND(low))))


def fingerprint(set_: Column) -> Column:
    """A set as a string: its length, then its smallest hashes, all in hexadecimal."""
    shown = F.transform(F.slice(set_, 1, SIZE), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.concat(F.lower(F.hex(F.size(set_))), F.lit(":"), F.array_join(shown, ""))


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of likeness ``threshold`` or more are in the same partition or in neighbours."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / threshold))


def likeness(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Jaccard index of two sets, 0 to 1; with a threshold, 0 for those that lengths keep under it."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    index = F.when(shorter <= 0, F.lit(0.0))
    if threshold:
        apart = length_partition(longer, threshold) - length_partition(shorter, threshold) > 1
        index = index.when(apart | (shorter < threshold * longer), F.lit(0.0))
    return index.otherwise(both / (F.size(a) + F.size(b) - both))


def ranges(documents: DataFrame, count: int) -> list:
    """The smallest doc_id of each of about ``count`` ranges with as many ids."""
    ids = documents.select("doc_id").where("doc_id is not null").repartitionByRange(count, "doc_id")
    firsts = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in firsts.collect())  # one for each range


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return documents.select("doc_id", fingerprint(signatures(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: the last quarter replaced by the head of the next document."""
    parts = RANGES * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema["doc_id"].dataType
    firsts = ranges(documents, parts)
    bounds = F.lit(firsts).cast(ArrayType(kind)) if firsts else F.array().cast(ArrayType(kind))
    place = F.size(F.filter(bounds, lambda first: first <= F.col("doc_id")))
    alone = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")  # rows without id are dealt out
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNotNull(), place).otherwise(alone))
    rows = rows.withColumn("own", signatures(F.col("text")))

    # The first text of each range is what follows the range before; the first range follows the last.
    smallest = F.min(F.struct("text", "own"))
    heads = rows.where(F.array_contains(bounds, F.col("doc_id"))).groupBy("part").agg(smallest.alias("after"))
    before = F.when(F.col("part") > 1, F.col("part") - 1).otherwise(F.lit(len(firsts)))
    heads = heads.select(before.cast("int").alias("part"), F.col("after.text").alias("after_text"), F.col("after.own").alias("after_own"))

    # From the largest id down: the row before is that of the next id, with its smallest text.
    down = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    first_of_id = F.lag("doc_id").over(down) > F.col("doc_id")
    rows = rows.withColumn("following", F.when(first_of_id, F.struct(F.lag("text").over(down).alias("text"), F.lag("own").over(down).alias("own"))))
    rows = rows.withColumn("following", F.last("following", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.join(heads, "part", "left")
    has_id = F.col("doc_id").isNotNull()
    whole = whole.select(
        "doc_id",
        "text",
        "own",
        F.length("text").cast("long").alias("n_chars"),
        F.when(has_id, F.coalesce("following.text", "after_text")).alias("next_text"),
        F.when(has_id, F.coalesce("following.own", "after_own")).alias("next_own"),
    )
    edited = F.expr(
        "concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) as int)), "
        "substring(coalesce(next_text, ''), 1, cast(floor(n_chars / 4) as int)))"
    )
    made = whole.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    made = made.select("*", F.transform(F.array("edited"), lambda t: signatures(t))[0].alias("changed"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("next_own")), F.lit(0.0)).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
