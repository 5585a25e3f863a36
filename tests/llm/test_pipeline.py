"""The pipeline's stages, each on what the one before has kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from siltstone.llm import decontaminate


def test_stages(spark, sf, as_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stash(stage(spark, now, sf), "stage")
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert as_rows(decontaminate.hits(now, bench)) == []
    assert now.where(F.col("n_chars") != F.char_length("text")).count() == 0
    lines = now.select(F.explode(F.split("text", "\n")).alias("x")).where(F.length(F.regexp_replace("x", r"[^\p{L}\p{N}]", "")) > 0)
    assert lines.count() == lines.distinct().count()
    packed = as_rows(corpus_pipeline.STAGES[-1][1](spark, now, sf))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.select("doc_id").collect()}


def test_run_equals_its_stages(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.stash(stage(spark, now, sf), "stage")
        now.collect()
