"""Imports every query module so that its queries are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import QUERIES
from siltstone.plans import baseline, extras, features, media, models, profiling, scores, series, splits, texts, topics  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column profile of the events table."""
    return QUERIES["profile_columns"](spark, sf_dir)
