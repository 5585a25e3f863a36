"""From raw documents to packed training sequences: five stages, each by one operator of siltstone.llm.

Every stage reads what the one before it has written, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from siltstone.llm._common import free_name, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs).where("kept").select(*docs.columns)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles; n_chars follows, and documents left without a text go."""
    mark = free_name(docs.columns, "had_text")
    had = docs.withColumn(mark, F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)))
    left = line_dedup.dedup_lines(had).where(~F.col(mark) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", fuzzy_lines),
    ("n-gram Jaccard join", near_documents),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]

#: Sketches, connected components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory; each stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
