"""Drift between a reference and a current table: PSI, Kolmogorov-Smirnov, chi-square, schema changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares are clipped here before logarithms.
CLIP = 1e-4


def numeric_edges(reference: DataFrame, column: str) -> list[float]:
    """Inner bin edges: midpoints of up to ten distinct values, else the distinct deciles. A bounded list."""
    values = reference.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    few = [r["v"] for r in values.distinct().limit(11).collect()]
    if len(few) <= 10:
        few.sort()
        return [(a + b) / 2 for a, b in zip(few, few[1:])]
    deciles = values.agg(F.percentile("v", F.array(*[F.lit(i / 10) for i in range(1, 10)]))).first()[0]
    return sorted(set(deciles))


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of edges below a value; missing values are bin -1."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > e).cast("int")
    return F.when(value.isNull(), F.lit(-1)).otherwise(out)


def _shares(reference: DataFrame, current: DataFrame, key: Column) -> DataFrame:
    both = reference.select(key.alias("bin"), F.lit(0).alias("side")).unionByName(current.select(key.alias("bin"), F.lit(1).alias("side")))
    counts = both.groupBy("bin").agg(F.count(F.when(F.col("side") == 0, 1)).alias("r"), F.count(F.when(F.col("side") == 1, 1)).alias("c"))
    total = counts.agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    return counts.join(F.broadcast(total))  # one row of totals


def _psi(shares: DataFrame) -> DataFrame:
    r, c = F.greatest(F.col("r") / F.col("rn"), F.lit(CLIP)), F.greatest(F.col("c") / F.col("cn"), F.lit(CLIP))
    return shares.agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def psi_numeric(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Population stability index over the reference's bins, missing values as a bin of their own."""
    edges = numeric_edges(reference, column)
    return _psi(_shares(reference, current, bin_of(F.col(column), edges)))


def psi_categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Population stability index over categories."""
    return _psi(_shares(reference, current, F.coalesce(F.col(column).cast("string"), F.lit("\0missing"))))


def smoothed_psi(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """The monitors' variant: half a row is added to every category on both sides."""
    s = _shares(reference, current, F.col(column).cast("string")).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    r = (F.col("r") + 0.5) / (F.col("rn") + 0.5 * F.col("k"))
    c = (F.col("c") + 0.5) / (F.col("cn") + 0.5 * F.col("k"))
    return s.agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def ks_statistic(reference: DataFrame, current: DataFrame, column: str, slices: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the sizes of both samples.

    Counts of distinct values are cut into ranges, each range is summed on its own, and the few ranges' totals are
    carried over, so that no window goes over all values in one task.
    """
    both = reference.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("side")).unionByName(
        current.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("side"))
    ).where(F.col("v").isNotNull())
    counts = both.groupBy("v").agg(F.count(F.when(F.col("side") == 0, 1)).alias("r"), F.count(F.when(F.col("side") == 1, 1)).alias("c"))
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return counts.select(F.lit(0.0).alias("ks"), F.lit(0).cast("long").alias("n_r"), F.lit(0).cast("long").alias("n_c")).limit(0)
    width = max((hi - lo) / slices, 1e-300)
    sliced = counts.withColumn("s", F.least(F.floor((F.col("v") - lo) / width), F.lit(slices - 1)).cast("int"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("s").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc")).select(
        "s", F.coalesce(F.sum("sr").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("sc").over(before), F.lit(0)).alias("c0")
    )  # one row a slice
    total = counts.agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    inside = Window.partitionBy("s").orderBy("v")
    gaps = sliced.join(F.broadcast(starts), "s").join(F.broadcast(total)).select(
        F.abs((F.sum("r").over(inside) + F.col("r0")) / F.col("n_r") - (F.sum("c").over(inside) + F.col("c0")) / F.col("n_c")).alias("gap"), "n_r", "n_c"
    )
    return gaps.agg(F.max("gap").alias("ks"), F.max("n_r").alias("n_r"), F.max("n_c").alias("n_c"))


def ks_pvalue(ks: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample statistic (Kolmogorov's series with Stephens' correction)."""
    if not n or not m:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * ks
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def chi2_statistic(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Chi-square of the 2 x k table of categories, with its degrees of freedom."""
    s = _shares(reference, current, F.col(column).cast("string")).where("bin is not null")
    both = F.col("r") + F.col("c")
    n = F.col("rn") + F.col("cn")
    er, ec = both * F.col("rn") / n, both * F.col("cn") / n
    return s.agg(
        F.sum((F.col("r") - er) * (F.col("r") - er) / er + (F.col("c") - ec) * (F.col("c") - ec) / ec).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df")
    )


def chi2_pvalue(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by series or fraction."""
    if df <= 0 or x <= 0:
        return 1.0
    a, half = df / 2, x / 2
    front = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= half / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = half + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def family(kind: T.DataType) -> str:
    """number, datetime or category."""
    if isinstance(kind, T.BooleanType):
        return "category"
    if isinstance(kind, T.NumericType):
        return "number"
    return "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "category"


def schema_drift(reference: DataFrame, current: DataFrame) -> list[tuple[str, str]]:
    """(column, change): missing, new or family changed."""
    old, new = {f.name: family(f.dataType) for f in reference.schema}, {f.name: family(f.dataType) for f in current.schema}
    out = [(c, "missing") for c in old if c not in new] + [(c, "new") for c in new if c not in old]
    return out + [(c, f"{old[c]} -> {new[c]}") for c in old if c in new and old[c] != new[c]]


def detect(reference: DataFrame, current: DataFrame, columns: list[str], p: float = 0.05, psi: float = 0.2) -> DataFrame:
    """One row per column: family, statistic, p-value, PSI and whether it drifted (p below, or PSI above, its limit)."""
    rows = []
    for c in columns:
        kind = family(reference.schema[c].dataType)
        if kind == "number":
            k = ks_statistic(reference, current, c).first()
            stat, pv = (k["ks"], ks_pvalue(k["ks"], k["n_r"], k["n_c"])) if k else (None, 1.0)
            index = psi_numeric(reference, current, c).first()[0]
        else:
            k = chi2_statistic(reference, current, c).first()
            stat, pv = k["chi2"], chi2_pvalue(k["chi2"] or 0.0, k["df"])
            index = psi_categorical(reference, current, c).first()[0]
        rows.append((c, kind, stat, pv, index, bool(pv < p or (index or 0) > psi)))
    return reference.sparkSession.createDataFrame(rows, "column string, family string, statistic double, p_value double, psi double, drifted boolean")
