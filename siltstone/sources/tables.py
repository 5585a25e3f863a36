"""Readers of the columnar test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor directory; works for any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
