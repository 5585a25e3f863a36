"""Anomalies in series: robust scores per series, runs, steps, smoothing, seasonality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard deviation of a normal sample per median absolute deviation, and per interquartile range.
MAD_SIGMA, IQR_SIGMA = 1.4826, 1 / 1.349


def _scored(df: DataFrame, value: str, expected: Column, sigma: Column, sensitivity: float) -> DataFrame:
    score = F.when(sigma > 0, F.abs(F.col(value) - expected) / sigma)
    out = df.withColumn("expected", expected).withColumn("score", score)
    confidence = F.when(F.col("score") > sensitivity, 1 - sensitivity / F.col("score")).otherwise(F.lit(0.0))
    return out.withColumn("anomaly", F.coalesce(F.col("score") > sensitivity, F.lit(False))).withColumn("confidence", confidence)


def zscore(df: DataFrame, series: list[str], value: str, sensitivity: float = 3.0) -> DataFrame:
    """expected, score, anomaly, confidence: distance from the series' median in robust deviations (MAD; else standard deviation).

    Two aggregations and two joins on the series, so that a long series is not held in one task.
    """
    known = df.where(F.col(value).isNotNull())
    level = known.groupBy(*series).agg(F.percentile(value, 0.5).alias("_m"), F.stddev_pop(value).alias("_sd"))
    spread = known.join(level, series).groupBy(*series).agg((MAD_SIGMA * F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5)).alias("_mad"))
    both = df.join(level, series, "left").join(spread, series, "left")
    sigma = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd"))
    return _scored(both, value, F.col("_m"), sigma, sensitivity).drop("_m", "_sd", "_mad")


def iqr(df: DataFrame, series: list[str], value: str, sensitivity: float = 3.0) -> DataFrame:
    """As zscore(), with the interquartile range as the spread."""
    q = df.where(F.col(value).isNotNull()).groupBy(*series).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    both = df.join(q, series, "left")
    return _scored(both, value, F.col("_q")[1], (F.col("_q")[2] - F.col("_q")[0]) * IQR_SIGMA, sensitivity).drop("_q")


def rolling(df: DataFrame, series: list[str], order: list[str], value: str, reach: int = 5, sensitivity: float = 3.0) -> DataFrame:
    """Distance from the mean of the medians of the ``reach`` values before and after, in robust deviations of that residual."""
    by = Window.partitionBy(*series).orderBy(*order)
    before, after = by.rowsBetween(-reach, -1), by.rowsBetween(1, reach)
    a, b = F.percentile(value, 0.5).over(before), F.percentile(value, 0.5).over(after)
    around = df.withColumn("_e", F.coalesce((a + b) / 2, a, b)).withColumn("_r", F.col(value) - F.col("_e"))
    level = around.groupBy(*series).agg(F.percentile("_r", 0.5).alias("_m"))
    spread = around.join(level, series).groupBy(*series).agg((MAD_SIGMA * F.percentile(F.abs(F.col("_r") - F.col("_m")), 0.5)).alias("_s"))
    return _scored(around.join(spread, series), value, F.col("_e"), F.col("_s"), sensitivity).drop("_e", "_r", "_s")


def ewma(df: DataFrame, series: list[str], order: list[str], value: str, alpha: float = 0.3, sensitivity: float = 3.0) -> DataFrame:
    """Distance from the exponentially weighted mean of the values before; a recursion, so one series is one group."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        v = g[value].astype(float)
        guard = v.rolling(3, center=True, min_periods=1).median()
        mean = guard.ewm(alpha=alpha, adjust=False).mean().shift(1)
        resid = (v - mean).abs()
        sigma = MAD_SIGMA * resid.median()
        score = resid / sigma if sigma > 0 else resid * float("nan")
        return g.assign(expected=mean, score=score, anomaly=(score > sensitivity).fillna(False))

    return df.groupBy(*series).applyInPandas(run, f"{fields}, expected double, score double, anomaly boolean")


def seasonal(df: DataFrame, phase: list[Column], value: str, sensitivity: float = 3.0) -> DataFrame:
    """Distance from the median of the same phase (such as hour of week) in robust deviations over all phases."""
    names = [f"_p{i}" for i in range(len(phase))]
    rows = df.select("*", *[p.alias(n) for p, n in zip(phase, names)])
    medians = rows.groupBy(*names).agg(F.percentile(value, 0.5).alias("_m"))
    near = rows.join(medians, names).withColumn("_r", F.abs(F.col(value) - F.col("_m")))
    sigma = near.agg((MAD_SIGMA * F.percentile("_r", 0.5)).alias("_s"))
    return _scored(near.join(F.broadcast(sigma)), value, F.col("_m"), F.col("_s"), sensitivity).drop("_m", "_r", "_s", *names)  # one row


def vote(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, votes, anomaly: a strict majority of methods."""
    out = frames[0].select(*keys, F.col("anomaly").cast("int").alias("votes"))
    for f in frames[1:]:
        out = out.join(f.select(*keys, F.col("anomaly").cast("int").alias("_v")), keys).select(*keys, (F.col("votes") + F.col("_v")).alias("votes"))
    return out.withColumn("anomaly", F.col("votes") * 2 > len(frames))


def runs(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: series, value, first and last order key, length."""
    by = Window.partitionBy(*series).orderBy(*order)
    fresh = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = df.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(by))
    return numbered.groupBy(*series, "_run", value).agg(
        F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")
    ).drop("_run")


def longest_run(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Length of each series' longest run."""
    return runs(df, series, order, value).groupBy(*series).agg(F.max("length").alias("longest"))


def steps(df: DataFrame, series: list[str], order: list[str], value: str, reach: int = 10, sensitivity: float = 4.0) -> DataFrame:
    """Rows where the median of the ``reach`` values from here differs from that before by ``sensitivity`` robust deviations or more."""
    by = Window.partitionBy(*series).orderBy(*order)
    a, b = F.percentile(value, 0.5).over(by.rowsBetween(-reach, -1)), F.percentile(value, 0.5).over(by.rowsBetween(0, reach - 1))
    full = F.count(value).over(by.rowsBetween(-reach, -1)) == reach
    rows = df.withColumn("jump", F.when(full, b - a)).withColumn("_d", F.abs(F.col(value) - F.lag(value).over(by)))
    noise = rows.groupBy(*series).agg((MAD_SIGMA * F.percentile("_d", 0.5) / F.sqrt(F.lit(2.0))).alias("_s"))
    return rows.join(noise, series).where((F.col("_s") > 0) & (F.abs("jump") >= sensitivity * F.col("_s"))).drop("_d", "_s")


def trend(df: DataFrame, series: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per series: slope, intercept, r2."""
    return df.groupBy(*series).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def dominant_period(df: DataFrame, series: list[str], order: list[str], value: str, least: float = 0.3) -> DataFrame:
    """First local peak over ``least`` of each series' autocorrelation (by FFT); null if there is none."""
    import numpy as np

    keys = ", ".join(f"`{s}` {df.schema[s].dataType.simpleString()}" for s in series)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order, kind="stable")[value].astype(float).interpolate().dropna().to_numpy()
        period = None
        if len(v) >= 8 and v.std() > 0:
            v = v - v.mean()
            f = np.fft.rfft(v, 2 * len(v))
            ac = np.fft.irfft(f * np.conj(f))[: len(v) // 2]
            ac = ac / ac[0]
            for k in range(2, len(ac) - 1):
                if ac[k] > least and ac[k] >= ac[k - 1] and ac[k] >= ac[k + 1]:
                    period = k
                    break
        return g[series].head(1).assign(period=pd.array([period], "Int64"))

    return df.groupBy(*series).applyInPandas(run, f"{keys}, period long")


def joint(df: DataFrame, channels: list[str], sensitivity: float = 3.0) -> DataFrame:
    """df with disagreement: the largest residual of a channel given all others, in deviations, from the inverse covariance.

    One aggregation gives means and the k x k covariance (k: channels, a few), whose pseudo-inverse is taken on the driver.
    """
    import numpy as np

    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    one = df.dropna(subset=channels).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(channels)],
        *[F.corr(channels[i], channels[j]).alias(f"r{i}_{j}") for i, j in pairs],
    ).first()
    r = np.eye(len(channels))
    for i, j in pairs:
        r[i, j] = r[j, i] = 1.0 if i == j else (one[f"r{i}_{j}"] or 0.0)
    p = np.linalg.pinv(r + 1e-6 * np.eye(len(channels)))
    z = [(F.col(c) - F.lit(one[f"m{i}"])) / F.lit(one[f"s{i}"] or 1.0) for i, c in enumerate(channels)]
    parts = []
    for i in range(len(channels)):
        term = F.lit(0.0)
        for j in range(len(channels)):
            term = term + z[j] * F.lit(float(p[j, i]))
        parts.append(F.abs(term / F.lit(float(np.sqrt(p[i, i])))))
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn("disagreement", worst).withColumn("anomaly", F.coalesce(F.col("disagreement") >= sensitivity, F.lit(False)))


def faults(df: DataFrame, series: list[str], order: list[str], value: str, least: int = 5) -> DataFrame:
    """Faulty runs of a channel: flatline or stuck_at_zero (equal values), railed (at the extreme), missing_burst; with their length."""
    r = runs(df, series, order, value).where(F.col("length") >= least)
    ends = df.groupBy(*series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    kind = (
        F.when(F.col(value).isNull(), "missing_burst")
        .when(F.col(value) == 0, "stuck_at_zero")
        .when((F.col(value) == F.col("_lo")) | (F.col(value) == F.col("_hi")), "railed")
        .otherwise("flatline")
    )
    return r.join(ends, series).select(*series, kind.alias("fault"), value, "first", "last", "length")
