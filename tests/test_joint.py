"""Cross-channel disagreement: clean tables stay quiet, faults are what is flagged, residuals are those of regressions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import joint


def plant(n=6000, k=10, seed=3):
    """Channels that follow one common load, nearly collinear."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    return pd.DataFrame({"row": np.arange(n)} | {f"s{i:02d}": 10 * (i + 1) + (i % 4 + 1) * base + rng.normal(0, 0.3, n) for i in range(k)})


@pytest.mark.parametrize("k", [3, 20])
def test_clean_tables_stay_quiet(spark, k):
    df = plant(4000, k)
    names = list(df.columns[1:])
    assert joint.detect(spark.createDataFrame(df), names).where("anomaly").count() == 0
    rng = np.random.default_rng(5)
    apart = pd.DataFrame({c: rng.normal(i, 1.0, 4000) for i, c in enumerate(names)})
    assert joint.detect(spark.createDataFrame(apart), names).where("anomaly").count() == 0


@pytest.mark.parametrize("fault,least", [("dead", 0.7), ("mirrored", 0.4)])
def test_a_fault_is_what_is_flagged(spark, fault, least):
    """81 of 6000 rows are at fault and 60 may be flagged. A mirrored channel reads normally but against the load; where the load is near its mean, nothing can tell."""
    df = plant()
    df.loc[3000:3080, "s03"] = 0.0 if fault == "dead" else 2 * df["s03"].median() - df.loc[3000:3080, "s03"]
    found = joint.detect(spark.createDataFrame(df), list(df.columns[1:])).where("anomaly").collect()
    inside = [r for r in found if 3000 <= r["row"] <= 3080]
    assert len(inside) >= 0.9 * len(found) and len(inside) >= least * 81
    assert {r["channel"] for r in inside} == {"s03"} and all(r["severity"] >= 1 for r in found)


def test_residuals_are_those_of_regressions(spark):
    df = plant(800, 4)
    names = list(df.columns[1:])
    got = joint.detect(spark.createDataFrame(df), names).orderBy("row").collect()
    parts = []
    for c in names:
        others = np.column_stack([np.ones(len(df)), df[[x for x in names if x != c]]])
        e = df[c] - others @ np.linalg.lstsq(others, df[c], rcond=None)[0]
        e = e / e.std(ddof=1)
        parts.append(np.abs(e) / max(1.0, 1.4826 * np.median(np.abs(e - np.median(e)))))
    want = np.max(parts, axis=0)
    assert np.allclose([r["disagreement"] for r in got], want, rtol=2e-2)


def test_fitted_once_for_batches_and_gaps(spark):
    df = plant(3000, 5)
    df.loc[::7, "s01"] = np.nan
    names = list(df.columns[1:])
    made = joint.fit(spark.createDataFrame(df), names)
    assert any("median" in n for n in made.notes)
    fresh = plant(300, 5, seed=9)
    fresh.loc[5, "s02"] += 4
    out = made.apply(spark.createDataFrame(fresh)).where("anomaly").collect()
    assert [r["row"] for r in out] == [5] and out[0]["channel"] == "s02"
    assert made.apply(spark.createDataFrame(fresh).limit(0)).count() == 0


def test_cut_follows_the_table():
    small, large = joint.cut(6_000, 3.0), joint.cut(2_000_000, 3.0)
    assert 4.5 < small < large < 7.0 and joint.cut(2_000_000, 5.0) > large and joint.cut(1, 4.0) == 4.0


def test_other_ways(spark):
    df = spark.createDataFrame(plant(2000, 4)).withColumn("flat", F.lit(1.0))
    names = ["s00", "s01", "s02", "s03", "flat"]
    assert any("flat" in n for n in joint.fit(df, names).notes)
    share = joint.detect(df, names, contamination=0.05).where("anomaly").count()
    assert 80 <= share <= 120
    few = plant(30, 3)
    few.loc[7, "s01"] += 40
    found = joint.detect(spark.createDataFrame(few), ["s00", "s01", "s02"]).where("anomaly").orderBy(F.desc("severity")).collect()
    assert found[0]["row"] == 7 and len(found) < 6
    assert joint.fit(df, ["s00", "flat"]).method == "none" and joint.detect(df, ["s00", "flat"]).where("anomaly").count() == 0
    wild = df.withColumn("s00", F.when(F.col("row") % 20 == 0, F.col("s00") * 3).otherwise(F.col("s00")))
    assert joint.detect(wild, names).where("anomaly").count() <= 25
    for how in ({"sensitivity": 0}, {"contamination": 1.0}):
        with pytest.raises(ValueError):
            joint.fit(df, names, **how)
    with pytest.raises(ValueError):
        joint.fit(df, ["gone"])
