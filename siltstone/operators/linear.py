"""Sums of products of many columns in one pass: pairwise correlations and regressions of each column on others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Gram:
    """Of k columns, over the rows in which both of a pair are known: rows n, sums s of the first, q of its squares, p of products; about ``centre``."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, p: np.ndarray, centre: np.ndarray) -> None:
        self.n, self.s, self.q, self.p, self.centre = n, s, q, p, centre

    def correlations(self, least: int = 2) -> np.ndarray:
        """Pearson correlation of each pair; nan with fewer than ``least`` rows or where one does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            cov = self.p - self.s * self.s.T / self.n
            var = self.q - self.s * self.s / self.n
            r = cov / np.sqrt(np.maximum(var * var.T, 0))
        return np.clip(np.where((self.n >= max(least, 2)) & np.isfinite(r), r, np.nan), -1, 1)


def gram(df: DataFrame, columns: list[Column], complete: bool = False) -> Gram:
    """Sums of all pairs of columns in two passes: means first, so that large values far from zero lose no digits.

    Each task sums its own rows in matrices of k x k numbers and gives k rows of 4k; these are added by their row number,
    so neither rows nor products pass through the driver, only the k x k result. complete: only rows with every value.
    """
    k = len(columns)
    if not k:
        empty = np.zeros((0, 0))
        return Gram(empty, empty, empty, empty, np.zeros(0))
    known = [F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double")) for c in columns]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(known)])
    if complete:
        rows = rows.dropna()
    centre = np.array([m or 0.0 for m in rows.agg(*[F.avg(f"c{i}") for i in range(k)]).first()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1)
            there = np.isfinite(x)
            x, m = np.where(there, x - centre, 0.0), there.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            p += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *[pa.array(list(t)) for t in (n, s, q, p)]], ["i", "n", "s", "q", "p"])

    parts = rows.mapInArrow(run, "i int, n array<double>, s array<double>, q array<double>, p array<double>")
    cells = parts.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "v"))
    sums = cells.groupBy("i", "j").agg(*[F.sum(f"v.{t}").alias(t) for t in "nsqp"]).collect()  # k x k rows
    out = [np.zeros((k, k)) for _ in range(4)]
    for r in sums:
        for t, name in zip(out, "nsqp"):
            t[r["i"], r["j"]] = r[name]
    return Gram(*out, centre)
