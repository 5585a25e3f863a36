"""Slopes that outliers don't bend: medians of the slopes of all pairs, found by counting, without a list of pairs.

The pairs with a slope of at most m are those whose order by y - m x is turned against their order by
x. They are counted by merging, for all blocks of a level at once, so a candidate costs n log^2 n;
halving the range of candidates leads to the slopes next to the median, which are then read off
exactly. A series is worked on by one task: these are rates by shift or day, thousands at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turned(values: np.ndarray) -> int:
    """Pairs (i < j) with values[i] >= values[j]."""
    n = len(values)
    if n < 2:
        return 0
    # Ranks with later rows first among equals, so that "not below" becomes "above".
    order = np.lexsort((-np.arange(n), values))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    size = 1 << (n - 1).bit_length()
    rows = np.concatenate([rank, np.arange(n, size)])  # what is added at the end is above all, and turned against nothing
    count, width = 0, 1
    while width < size:
        blocks = rows.reshape(-1, 2 * width)
        left, right = np.sort(blocks[:, :width], axis=1), blocks[:, width:]
        lift = np.arange(len(blocks))[:, None] * (size + 1)
        below = np.searchsorted((left + lift).ravel(), (right + lift).ravel()) - np.repeat(np.arange(len(blocks)) * width, width)
        count += int((width - below).sum())
        rows = np.sort(blocks, axis=1).ravel()
        width *= 2
    return count


def _kth(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """The k-th smallest slope (from 1) of all pairs; x ascends strictly."""
    steps = np.diff(y) / np.diff(x)  # every slope lies between the least and the greatest step
    low, high = float(steps.min()), float(steps.max())
    if turned(y - low * x) >= k:
        return low
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (low, middle) if turned(y - middle * x) >= k else (middle, high)
    return high


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Median of the slopes of all pairs of points with different x; nan with fewer than two. Equal x share the mean of nothing: pairs among them are left out."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    if len(x) < 2 or x[0] == x[-1]:
        return float("nan")
    if (np.diff(x) == 0).any():  # few such series: pairs one row at a time
        slopes = np.concatenate([((y[i + 1 :] - y[i]) / (x[i + 1 :] - x[i]))[x[i + 1 :] > x[i]] for i in range(len(x) - 1)])
        return float(np.median(slopes))
    pairs = len(x) * (len(x) - 1) // 2
    if pairs % 2:
        return _kth(x, y, pairs // 2 + 1)
    return (_kth(x, y, pairs // 2) + _kth(x, y, pairs // 2 + 1)) / 2


def theil_sen(df: DataFrame, series: list[str], x: str, y: str) -> DataFrame:
    """(series, n, slope, intercept, tau): median slope of all pairs, median of what it leaves, and Kendall's share of rising less falling pairs.

    Rows without both values are left out; slope, intercept and tau are null where fewer than two x differ.
    """
    keys = ", ".join(f"`{s}` {df.schema[s].dataType.simpleString()}" for s in series)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y"], kind="stable")
        a, b = g["x"].to_numpy(float), g["y"].to_numpy(float)
        slope = median_slope(a, b)
        known = np.isfinite(slope)
        falls = turned(b)
        ties = _ties(b)
        pairs = len(b) * (len(b) - 1) // 2
        tau = (pairs - falls - (falls - ties)) / pairs if pairs else None  # rising less falling
        return g[series].head(1).assign(n=len(a), slope=slope if known else None, intercept=float(np.median(b - slope * a)) if known else None, tau=tau if known else None)

    rows = df.select(*series, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    return rows.groupBy(*series).applyInPandas(run, f"{keys}, n long, slope double, intercept double, tau double")


def _ties(values: np.ndarray) -> int:
    """Pairs of equal values."""
    n = np.unique(values, return_counts=True)[1].astype(np.int64)
    return int((n * (n - 1) // 2).sum())


def rate_drift(shifts: DataFrame, machine: list[str], order: str, rate: str, threshold: float = 0.1, run: str | None = None, scheduled: str | None = None) -> DataFrame:
    """Machines whose rate falls steadily from shift to shift: (machine, n, first, last, change, tau, drifting).

    Shifts count 0, 1, 2, ... by ``order``; those that ran under 0.3 of their schedule (``run`` and ``scheduled``, if given) or
    without a rate are left out. A drift is a fall of the fitted line by ``threshold`` or more, with at least three of four
    pairs falling, a later half below the earlier by half the threshold, and four shifts or an unbroken fall.
    """
    from pyspark.sql import Window

    rows = shifts.where(F.col(rate).isNotNull())
    if run and scheduled:
        rows = rows.where(F.col(run) >= 0.3 * F.col(scheduled))
    by = Window.partitionBy(*machine).orderBy(order)
    placed = rows.withColumn("place", (F.row_number().over(by) - 1).cast("double")).withColumn("rise", F.col(rate) >= F.lag(rate).over(by))
    whole = Window.partitionBy(*machine)
    placed = placed.withColumn("half", F.floor(F.count(F.lit(1)).over(whole) / 2)).withColumn("of", F.count(F.lit(1)).over(whole))
    sides = placed.groupBy(*machine).agg(
        F.percentile(F.when(F.col("place") < F.col("half"), F.col(rate)), 0.5).alias("early"), F.percentile(F.when(F.col("place") >= F.col("of") - F.col("half"), F.col(rate)), 0.5).alias("late"),
        F.bool_or("rise").alias("rises"),
    )
    fit = theil_sen(placed, machine, "place", rate).join(sides, machine).where("n >= 3")
    first, last = F.col("intercept"), F.col("intercept") + F.col("slope") * (F.col("n") - 1)
    out = fit.withColumn("first", first).withColumn("last", last).withColumn("change", F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first")))
    steady = (F.col("n") >= 4) | ~F.coalesce("rises", F.lit(False))
    hit = (F.col("change") <= -threshold) & (F.col("tau") <= -0.5) & (F.col("late") <= F.col("early") * (1 - threshold / 2)) & steady
    return out.select(*machine, "n", "first", "last", "change", "tau", F.coalesce(hit, F.lit(False)).alias("drifting"))
