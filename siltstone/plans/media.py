"""Kernels for pictures and sound over arrays made from the tables, as there are no media among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import media
from siltstone.plans import query
from siltstone.sources.tables import table


@query("image_measures")
def _images(spark, sf_dir):
    """Embeddings as pictures of eight columns, four times as large."""
    v = table(spark, sf_dir, "embeddings")
    tiled = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.transform("embedding", lambda x: x.cast("double") * 40 + 128)))
    return v.select("vec_id", media.array_measures(16)(tiled).alias("m")).select("vec_id", "m.*")
