"""The pipeline against its parts, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from daybook.llm import jaccard_join, langid, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in seen.collect()}, [r["doc_id"] for r in out.collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name == "toxicity":
            predicted = toxicity.score_documents(seen, toxicity.learn(seen, labels)).where("predicted = 0")
            assert set(after) == {r["doc_id"] for r in predicted.collect()}
        if name == "language_id":
            found = langid.identify_documents(seen, langid.learning_text(seen)).where("lang_pred <> 'und'")
            assert set(after) == {r["doc_id"] for r in found.collect()}
        if name == "ngram_jaccard_join":
            assert set(after) == {r["class_id"] for r in jaccard_join.join(seen).collect()}
        if name == "pii":
            assert set(after) == before
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want")).collect()
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in seen.collect()}
    assert all(r["n"] == r["want"] for r in whole)


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "word " * 9000, "en", "s", 45000, "x"), (2, "word " * 9000, "en", "s", 45000, "x"), (3, "a b", None, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _toxicity string")
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            out.count()


def test_run_gives_packed_pieces(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
