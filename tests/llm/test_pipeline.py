"""The pipeline's stages: columns, whole inputs, and what must and must not go."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from kilocast.llm.common import read, stored

SMOKE = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = read(spark, SMOKE, "documents")
    benchmark = {r.text for r in read(spark, SMOKE, "benchmark").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SMOKE))
        assert kept.columns == columns
        before = {(r.doc_id, r.text) for r in docs.collect()}
        after = [(r.doc_id, r.text) for r in kept.collect()]
        assert set(after) <= before
        if name == "near_duplicates":
            texts = [t for _, t in after if t and t.split()]
            assert len(set(texts)) == len(texts)
        if name == "decontamination":
            assert not any(b in (t or "") for b in benchmark for _, t in after)
            assert len(after) > 0.8 * len(before)
        if name == "mixing":
            assert set(after) == before and len(after) >= len(before)
        docs = kept
        sizes.append(len(after))
    assert sizes[1] >= 0.8 * sizes[0]
    written = pipeline.STAGES[-1][1](spark, docs, SMOKE)
    total = written.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert written.count() == sizes[-1] and total[0] == total[1]


def test_copies_leave_one_row_for_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "x"), (3, long, "x"), (3, long, "x"), (4, long + " more", "x"), (7, None, None), (8, "", "x"), (None, "no id here", "x"), (None, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster string")
    kept = pipeline.keep_one_of_near_copies(spark, docs, SMOKE)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert (3, long) in found and found.count((3, long)) == 1
    assert {i for i, _ in found} == {3, 7, 8, None} and (None, "no id here") in found


ITEM = "The red fox carried seven small stones across the frozen river before anyone in the village woke up that morning"
ODD = "doc_id long, text string, lang string, source string, cluster string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "c") for i, t in rows], ODD)


def test_leaks_go_row_by_row(spark, tmp_path):
    """Rows without id, or with one id, are judged by their own texts."""
    clean = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    rows = [(None, clean[0]), (None, f"{clean[1]} {ITEM}"), (7, clean[2]), (7, f"x y z {ITEM}"), (8, clean[0]), (9, None)]
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = pipeline.drop_benchmark_leaks(spark, odd(spark, rows), str(tmp_path))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[0], rows[2], rows[4], rows[5]}


def test_near_copies_go_row_by_row(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    rows = [
        (3, long[0]),
        (None, long[0] + " end"),  # a copy without id
        (4, long[1]),
        (9, long[2]),
        (9, long[1] + " end"),  # a copy under an id that a clean row has
        (None, long[3]),
        (None, long[3] + " end"),  # a group without any id
        (None, ""),
        (None, None),
        (5, "short text"),
    ]
    kept = pipeline.keep_one_of_near_copies(spark, odd(spark, rows), SMOKE)
    assert kept.columns == odd(spark, rows).columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    alone = {(None, long[3]), (None, long[3] + " end")}
    assert len(found) == len(set(found)) == 7 and len(alone & set(found)) == 1
    assert set(found) - alone == {rows[0], rows[2], rows[3], rows[7], rows[8], rows[9]}


def test_empty_tables_pass_all_stages(spark, tmp_path):
    docs = odd(spark, []).drop("cluster")
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source"] and docs.count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_the_encoder_keeps_few_words_beside_what_other_stages_have_left():
    from kilocast.llm import tokens

    encoder = tokens.WordEncoder(tokens.default_tokenizer(), pipeline.KEPT_WORDS)
    for i in range(0, 140_000, 10_000):
        encoder.encode([b" ".join(b"w%dx" % n for n in range(i, i + 10_000))])
    assert len(encoder.words) + len(encoder.old_words) <= 120_000
