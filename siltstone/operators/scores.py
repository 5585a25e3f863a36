"""Scores of predictions against actual values, and fills and centred windows of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of sorted scores that are summed up apart.
RANGES = 256


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, mae, rmse and r2 of the rows where both are finite; r2 is null where actual values do not vary."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    ok = ~F.isnan(a) & ~F.isnan(p) & (F.abs(a) != float("inf")) & (F.abs(p) != float("inf"))
    both = df.where(ok).select(a.alias("a"), (a - p).alias("e"))
    out = both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("square"), F.var_pop("a").alias("v"))
    return out.select("n", "mae", F.sqrt("square").alias("rmse"), F.when(F.col("v") > 0, 1 - F.col("square") / F.col("v")).alias("r2"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row per class that is actual or predicted somewhere: class, support, precision, recall and f1; rows without both are left out.

    A score whose denominator is 0 is 0.
    """
    pairs = df.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).dropna().groupBy("a", "p").agg(F.count(F.lit(1)).alias("n"))
    # Each cell of the confusion matrix counts for its row and for its column.
    none, hits = F.lit(0).cast("long"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    rows = pairs.select(F.col("a").alias("class"), F.col("n").alias("own"), none.alias("given"), hits.alias("hit"))
    columns = pairs.select(F.col("p").alias("class"), none.alias("own"), F.col("n").alias("given"), none.alias("hit"))
    sums = rows.unionByName(columns).groupBy("class").agg(F.sum("own").alias("support"), F.sum("given").alias("told"), F.sum("hit").alias("hits"))
    precision = F.when(F.col("told") > 0, F.col("hits") / F.col("told")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return sums.select("class", "support", precision.alias("precision"), recall.alias("recall"), (2 * F.col("hits") / (F.col("support") + F.col("told"))).alias("f1"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n and accuracy of the rows that have both."""
    both = df.select(F.col(actual).alias("a"), F.col(predicted).alias("p")).dropna()
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("p")).cast("double")).alias("accuracy"))


def binary_curve_area(df: DataFrame, actual: str, score: str) -> DataFrame:
    """One row: n and auc, the share of pairs (positive, negative) in which the positive has the higher score; ties count half.

    Rows without both are left out; null where a class has no row. Counts of each score are summed up in two steps, within
    ranges of the sorted scores and over the few ranges, so that no task holds them all.
    """
    rows = df.select(F.col(actual).cast("int").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    counts = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # Any bounds give right results, so approximate quantiles of the distinct scores do; there are RANGES at most.
    bounds = counts.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    ranged = counts.withColumn("part", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda x: x < F.col("s"))))
    totals = ranged.groupBy("part").agg(F.sum("neg").alias("all_neg"))
    before = F.coalesce(F.sum("all_neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("start"))  # at most RANGES rows
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("below", below).join(F.broadcast(starts), "part")
    wins = F.sum(F.col("pos") * (F.col("start") + F.col("below") + F.col("neg") / 2))
    out = placed.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), wins.alias("w"))
    return out.select(F.coalesce(F.col("p") + F.col("q"), F.lit(0)).alias("n"), F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"))


def average_precision(df: DataFrame, actual: str, score: str) -> DataFrame:
    """One row: n and ap, the mean over positives of the share of positives among the rows of their score or higher.

    Rows without both are left out; null without a positive. Rows of one score count together.
    """
    from siltstone.operators.splits import running

    rows = df.select(F.col(actual).cast("int").alias("y"), (-F.col(score).cast("double")).alias("s")).dropna()
    counts = rows.groupBy("s").agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("all"))
    above = running(running(counts, [], "s", "pos").withColumnRenamed("upto", "hits"), [], "s", "all")
    out = above.agg(F.sum("all").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("hits") / F.col("upto")).alias("w"))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("p") > 0, F.col("w") / F.col("p")).alias("ap"))


def _order(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def filled(df: DataFrame, keys: list[str], order: list[str], column: str, back: bool = False) -> Column:
    """The last value before (``back``: the next after) a row, or its own, within its series."""
    w = _order(keys, order)
    if back:
        return F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def centred_median(keys: list[str], order: list[str], column: str, width: int) -> Column:
    """Median of the ``width`` rows around a row, fewer at both ends; of an even width, one more row lies before than after."""
    # Spark's median takes no frame; collect_list leaves nulls out and holds ``width`` values at most.
    near = F.sort_array(F.collect_list(F.col(column).cast("double")).over(_order(keys, order).rowsBetween(-(width // 2), width - width // 2 - 1)))
    n = F.size(near)
    return F.when(n > 0, (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2)


def midpoint_share(df: DataFrame, keys: list[str], order: list[str], column: str, bounds: dict[str, float]) -> DataFrame:
    """Allots each row to the first part whose bound, a share of its group's total, its midpoint on the running total lies below.

    Rows without a value, and groups whose total is 0, have no part.
    """
    w = _order(keys, order)
    run, total = F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(column).over(Window.partitionBy(*keys))
    middle = F.when(total > 0, (run - F.col(column) / 2) / total)
    part = F.lit(None).cast("string")
    for name, bound in sorted(bounds.items(), key=lambda x: -x[1]):
        part = F.when(middle < bound, F.lit(name)).otherwise(part)
    return df.withColumn("part", part)
