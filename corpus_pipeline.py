"""From raw documents to token files: filter, deduplicate, decontaminate, mix and encode.

Each stage takes all that the one before has kept. ``run`` stores the result of
every stage as Parquet in the folder of ``spark.checkpoint.dir`` and reads it
again as the next one's documents. Stages decide on rows: rows that share a
doc_id, or have none, are judged one by one by their own texts. Rows with null
in any column, repeated rows and empty texts pass through as each stage
describes; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm import decontaminate, jaccard, mixing, tokens, toxicity
from kilocast.llm.common import read, stored

# No SQL expresses the learnt stages; tests/llm compares the stages with plain versions.
ORACLE_SQL = None

# Words whose ids a Python worker keeps, and bytes of text that it encodes at once; its memory holds what other stages
# have left, too.
KEPT_WORDS = 50_000
ENCODED_BYTES = 1 << 20
MIX = {"growth": 1.5, "min_rate": 1.0, "max_rate": 4.0}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; learnt from labelled rows of ``docs``."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    weights = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, weights).where("score < 0.5").select(*docs.columns)


def _row() -> Column:
    """A key of a row, from its id and text; rows of the same id and text are alike to every stage."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _rows(docs: DataFrame) -> DataFrame:
    """The rows' keys and texts, as the operators take documents."""
    return docs.select(_row().alias("doc_id"), "text")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a Jaccard index of 0.8: that of the smallest doc_id.

    Rows without doc_id come last in a group. Texts without words are kept,
    repeated rows once.
    """
    found = jaccard.components(_rows(docs), shingle=5, percent=80).select(F.col("doc_id").alias("_key"), "cluster")
    ids = docs.select(_row().alias("_key"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key"))
    chosen = found.where("cluster is not null").join(ids, "_key").groupBy("cluster").agg(first.alias("first"))
    keep = chosen.select("first._key").unionByName(found.where("cluster is null").select("_key"))
    kept = docs.withColumn("_key", _row()).join(keep, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template passage with an item of the benchmark."""
    found = decontaminate.leaks(_rows(docs), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key"))
    return docs.withColumn("_key", _row()).join(found, "_key", "left_anti").select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at rates that move the domains towards their target weights.

    Every document is used at least once: the weights are reached by repeats.
    """
    weights, _, rates = mixing.mix_documents(docs, read(spark, sf_dir, "labels"), mixing.TARGETS, **MIX)
    # The documents' own columns go along under other names, whatever they are called.
    own = {name: f"_own{i}" for i, name in enumerate(docs.columns)}
    whole = docs.select(*[F.col(name).alias(new) for name, new in own.items()], "text")
    rated = rates.apply(mixing.posteriors(whole, weights))
    times = mixing.copies("rate", own["doc_id"], own["text"])
    repeated = rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*[F.col(new).alias(name) for name, new in own.items()])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows: doc_id, start, n_tokens, ids_crc32."""
    written = tokens.write_shards(docs, tokens.default_tokenizer(), kept=KEPT_WORDS, block_bytes=ENCODED_BYTES)
    return tokens.read_shards(written)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_targets),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before has kept, stored in between."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
