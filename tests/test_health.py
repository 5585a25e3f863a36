"""Health findings: one profile for all of them, quartiles of many values."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import health


def test_a_table_is_profiled_once(spark, monkeypatch):
    calls, profile = [], health.profile_columns
    monkeypatch.setattr(health, "profile_columns", lambda *a: calls.append(1) or profile(*a))
    df = spark.range(40).select("id", F.lit("x").alias("one"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("gaps"), F.when(F.col("id") < 4, 1000.0).otherwise(F.col("id") % 3).alias("far"))
    found = {(r["kind"], r["column"]) for r in health.findings(df).collect()}
    assert {("constant", "one"), ("missing", "gaps"), ("id_like", "id"), ("outliers", "far")} <= found and len(calls) == 1


def test_quartiles_of_many_values(spark):
    rows = 90_001
    df = spark.range(0, rows, 1, 5).select(F.pmod(F.col("id") * 7919, F.lit(rows)).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"), F.when(F.col("id") < 6, F.col("id") * 1.5).alias("c"), F.lit(None).cast("int").alias("d"))
    got = health.quartiles(df, ["a", "b", "c", "d"])
    a, b = np.arange(rows) * 7919 % rows, [k % 5 for k in range(rows) if k % 3 > 0]
    for name, values in (("a", a), ("b", b), ("c", np.arange(6) * 1.5)):
        assert np.allclose(got[name], np.percentile(values, [25, 75]), rtol=1e-12)
    assert got["d"] == (None, None)
    out = {r["column"]: r for r in health.iqr_outliers(df, ["a", "b", "c", "d"]).collect()}
    assert out["a"]["n_outliers"] == 0 and out["d"]["share"] is None
