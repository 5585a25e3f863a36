"""Checks of a window of predictions: one row per monitor, with status, value and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.anomaly import longest_run
from siltstone.operators.drift import smoothed_psi

#: Limits of the monitors.
LIMITS = {"prediction_drift": 0.2, "feature_drift": 0.2, "accuracy_drop": 0.1, "latency_p95": 500.0, "null_rate": 0.05, "constant_output": 50.0, "volume_ratio": 0.5}


def last_records(df: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """The last n records; a top-n, taken without a full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def _row(df: DataFrame, name: str, value: Column, limit: float, over: bool = True) -> DataFrame:
    failed = value > limit if over else value < limit
    status = F.when(value.isNull(), "inactive").when(failed, "failed").otherwise("ok")
    return df.select(F.lit(name).alias("monitor"), status.alias("status"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"))


def null_rate(df: DataFrame, column: str, limit: float = LIMITS["null_rate"]) -> DataFrame:
    """Share of missing values."""
    return _row(df.agg(F.avg(F.col(column).isNull().cast("double")).alias("v")), f"null_rate:{column}", F.col("v"), limit)


def latency(df: DataFrame, column: str, limit: float = LIMITS["latency_p95"]) -> DataFrame:
    """95th percentile."""
    return _row(df.agg(F.percentile(column, 0.95).alias("v")), "latency_p95", F.col("v"), limit)


def volume(df: DataFrame, time: str, expected_per_hour: float, limit: float = LIMITS["volume_ratio"]) -> DataFrame:
    """Records an hour over what is expected; unknown for a span under a minute."""
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    one = df.agg((F.max(t) - F.min(t)).alias("s"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("s") >= 60, F.col("n") / (F.col("s") / 3600) / expected_per_hour)
    return _row(one, "volume_ratio", value, limit, over=False)


def accuracy_drop(df: DataFrame, prediction: str, actual: str, reference: float, limit: float = LIMITS["accuracy_drop"]) -> DataFrame:
    """Reference accuracy less that of the records whose outcome is known."""
    known = F.when(F.col(actual).isNotNull(), (F.col(prediction) == F.col(actual)).cast("double"))
    return _row(df.agg((reference - F.avg(known)).alias("v")), "accuracy_drop", F.col("v"), limit)


def constant_output(df: DataFrame, order: list[str], prediction: str, limit: float = LIMITS["constant_output"]) -> DataFrame:
    """Longest run of one prediction; the window of records is bounded, so it is one group."""
    one = longest_run(df.withColumn("_all", F.lit(1)), ["_all"], order, prediction)
    return _row(one, "constant_output", F.col("longest"), limit)


def drift(reference: DataFrame, df: DataFrame, column: str, name: str = "feature_drift", limit: float = LIMITS["feature_drift"]) -> DataFrame:
    """Smoothed population stability index of a column."""
    return _row(smoothed_psi(reference, df, column), f"{name}:{column}", F.col("psi"), limit)


def run_all(reference: DataFrame, window: DataFrame, prediction: str, time: str, order: list[str], features: list[str], per_hour: float, accuracy: float | None = None, actual: str | None = None, latency_column: str | None = None) -> DataFrame:
    """All monitors that the given columns allow."""
    out = drift(reference, window, prediction, "prediction_drift", LIMITS["prediction_drift"])
    for f in features:
        out = out.unionByName(drift(reference, window, f)).unionByName(null_rate(window, f))
    out = out.unionByName(constant_output(window, order, prediction)).unionByName(volume(window, time, per_hour))
    if actual and accuracy is not None:
        out = out.unionByName(accuracy_drop(window, prediction, actual, accuracy))
    if latency_column:
        out = out.unionByName(latency(window, latency_column))
    return out
