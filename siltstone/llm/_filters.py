"""Filters that let too much pass, never too little: they thin rows before an exact join."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the fewest and the most bits of a filter; in between there are about eight bits a key.
LEAST_BITS, MOST_BITS = 16, 27


class Bitmap:
    """A set of 64-bit identifiers by their upper bits, somewhat larger than it should be."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, width: int) -> None:
        self.width = width
        self.words = np.zeros(1 << (width - 6), np.uint64)
        self.words[slots] = bits.view(np.uint64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = ids >> np.uint64(64 - self.width)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(ids: DataFrame, column: str, keys: int) -> Bitmap:
    """Bitmap of a column of hashed identifiers, of which there are about ``keys``.

    It has at most 2^MOST_BITS bits (16 MB), whatever the input. Beyond that it only thins less, and the exact join
    that follows it takes more rows.
    """
    width = min(MOST_BITS, max(LEAST_BITS, (8 * keys).bit_length()))
    spread = F.shiftrightunsigned(F.col(column), 64 - width)
    found = ids.select(F.shiftright(spread, 6).alias("slot"), spread.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = found.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    return Bitmap(rows.column("slot").to_numpy(), rows.column("bits").to_numpy(), width)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that are over."""
    gc.collect()
    spark._jvm.System.gc()
