"""Feature checks: each kind of finding on planted columns, and trees and sums against plain computations."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import features, linear


def kinds(report, column):
    return {f.kind for f in report.features[column]}


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(pd.DataFrame(columns)).select(*[f"`{c}`" for c in names])


@pytest.fixture(scope="module")
def quick(spark):
    return frame(spark, row_id=list(range(60)), age=[23, 34, 45, 31, 29] * 12, age_in_years=[23, 34, 45, 31, 29] * 12, country=["IN"] * 60, signed_up=["2024-01-05", "2024-02-11", "2024-03-18"] * 20, churn_flag=[0, 1] * 30, churned=[0, 1] * 30)


def test_a_table_with_each_fault(quick):
    report = features.check(quick, "churned")
    assert report.n_rows == 60 and list(report.features) == [c for c in quick.columns if c != "churned"]
    assert "id_like" in kinds(report, "row_id") and "suspicious_name" in kinds(report, "row_id") and "duplicate_of" in kinds(report, "age_in_years")
    assert kinds(report, "country") == {"constant"} and "date_as_string" in kinds(report, "signed_up")
    leak = [f for f in report.features["churn_flag"] if f.kind == "leakage_suspect"][0]
    assert leak.detail["score"] == 1.0 and leak.detail["baseline"] == 0.5
    assert set(report.drop) == {"row_id", "age_in_years", "country", "churn_flag"} and report.keep == ["age", "signed_up"]


def test_missing_and_constant(spark):
    rows = [(1.0 if k < 15 else None, None, "v" if k < 199 else "w", k if k < 60 else None, k if k < 4 else None, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "once double, blank double, nearly string, some long, few long, full double")
    report = features.check(df)
    assert kinds(report, "once") == kinds(report, "blank") == {"constant"} and kinds(report, "nearly") == {"near_constant"}
    assert {f.kind: f.severity for f in report.features["some"]}["high_missing"] == "medium" and {f.kind: f.severity for f in report.features["few"]}["high_missing"] == "high"
    assert report.features["full"] == [] or kinds(report, "full") == {"highly_correlated_with", "id_like"} or kinds(report, "full") <= {"id_like", "highly_correlated_with"}
    one = features.check(df.limit(1))
    assert any("for want of rows" in n for n in one.notes)
    assert any("no rows" in n for n in features.check(df.limit(0)).notes)


def test_identifiers(spark):
    day = datetime.datetime(2024, 1, 1)
    df = frame(spark, text=[f"u-{k}" for k in range(80)], number=list(range(80)), level=list(np.random.default_rng(0).normal(size=80)), at=[day + datetime.timedelta(hours=k) for k in range(80)])
    report = features.check(df)
    assert {f.severity for f in report.features["text"] if f.kind == "id_like"} == {"high"} and {f.severity for f in report.features["at"] if f.kind == "id_like"} == {"medium"}
    assert "id_like" in kinds(report, "number") and "id_like" not in kinds(report, "level")
    assert "id_like" not in kinds(features.check(df.limit(10)), "text")


def test_redundant_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    gappy = pd.Series(x * 2 + 1).where(rng.random(300) > 0.3)
    city = rng.choice(list("abcd"), 300)
    df = frame(spark, gappy=gappy, x=x, other=rng.normal(size=300), city=city, town=[{"a": "A", "b": "B", "c": "C", "d": "D"}[c] for c in city], colour=rng.choice(list("rg"), 300))
    report = features.check(df)
    hit = [f for f in report.features["gappy"] if f.kind == "highly_correlated_with"][0]
    assert hit.detail["other"] == "x" and hit.detail["corr"] > 0.999 and report.features["x"] == []
    assert [f.detail["other"] for f in report.features["town"] if f.kind == "highly_correlated_with"] == ["city"]
    assert report.features["colour"] == report.features["other"] == []
    few = df.withColumn("thin", F.when(F.col("x") > 2.2, F.col("x")))
    assert "highly_correlated_with" not in kinds(features.check(few), "thin")


def test_leaks(spark):
    price = np.linspace(0, 1, 80)
    report = features.check(frame(spark, shadow=3.2 * price + 0.7, curved=np.exp(5 * price), noise=[0.3, -0.2, 0.9, 0.1] * 20, band=[f"b{int(v * 8)}" for v in price], price=price), "price")
    assert "leakage_suspect" in kinds(report, "shadow") and "leakage_suspect" in kinds(report, "curved") and "leakage_suspect" not in kinds(report, "noise") | kinds(report, "band")
    report = features.check(frame(spark, plan=["free", "paid"] * 40, region=["north", "south", "east", "west", "central"] * 16, uuid_col=[f"u-{k}" for k in range(80)], paying=[0, 1] * 40), "paying")
    assert "leakage_suspect" in kinds(report, "plan") and "leakage_suspect" not in kinds(report, "region") | kinds(report, "uuid_col")
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 3, 2000)
    df = frame(spark, x=x, y=[["low", "mid", "high"][int(v)] for v in x])
    assert "leakage_suspect" in kinds(features.check(df, "y"), "x")
    flag = frame(spark, x=x, y=[bool(v > 1) for v in x])
    assert "leakage_suspect" in kinds(features.check(flag, "y"), "x")
    group = rng.integers(0, 8, 400)
    assert "leakage_suspect" in kinds(features.check(frame(spark, g=[f"g{v}" for v in group], y=group * 10 + rng.normal(size=400) * 0.1), "y"), "g")


def test_useless_columns(spark):
    rng = np.random.default_rng(0)
    label = np.tile([0, 1], 200)
    report = features.check(frame(spark, signal=label * 4.0 + rng.normal(size=400), junk=rng.normal(size=400), label=label), "label")
    assert "zero_importance" in kinds(report, "junk") and "zero_importance" not in kinds(report, "signal") and report.keep == ["signal", "junk"]
    y = rng.normal(size=400)
    report = features.check(frame(spark, signal=y + rng.normal(size=400) * 0.5, junk=rng.normal(size=400), y=y), "y")
    assert "zero_importance" in kinds(report, "junk") and "zero_importance" not in kinds(report, "signal")


def test_names():
    said = {"user_id": "id", "userId": "id", "customerid": "id", "session_uuid": "uuid", "Index": "index", "primary key": "key", "event timestamp": "timestamp", "row_number": "row", "Unnamed: 0": "unnamed", "humidity": None, "city": None, "valid": None}
    assert {c: features.suspicious_name(c) for c in said} == said


def test_trees_against_plain_search():
    rng = random.Random(3)

    def gini(rows):
        n = sum(map(sum, rows))
        return n - sum(sum(r[c] for r in rows) ** 2 for c in range(len(rows[0]))) / n if n else 0

    for _ in range(30):
        counts = [[rng.randrange(4) for _ in range(3)] for _ in range(7)]
        said = features.tree_predictions(np.array(counts, float), 1)
        cuts = [k for k in range(1, 7) if sum(map(sum, counts[:k])) and sum(map(sum, counts[k:]))]
        best = min(gini(counts[:k]) + gini(counts[k:]) for k in cuts)
        change = [k for k in range(1, 7) if said[k] != said[k - 1]]
        assert len(change) <= 1 and (not change or abs(gini(counts[: change[0]]) + gini(counts[change[0] :]) - best) < 1e-9)
    assert features.tree_means(np.array([2.0, 2, 2, 2]), np.array([0.0, 0, 10, 30])).tolist() == [0, 0, 5, 15]


def test_sums_of_products(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.normal(size=(500, 4)) + 1e6, columns=list("abcd"))
    data["b"] = data["a"] * 2 + rng.normal(size=500)
    data = data.mask(rng.random(data.shape) < 0.1)
    df = spark.createDataFrame(data).repartition(5)
    got = linear.gram(df, [F.col(c) for c in "abcd"])
    assert np.allclose(got.correlations(), data.corr().to_numpy(), atol=1e-9)
    assert np.array_equal(got.n, data.notna().astype(int).T @ data.notna().astype(int))
    assert linear.gram(df, [F.col(c) for c in "abcd"], complete=True).n[0, 0] == len(data.dropna())


def test_wrong_parameters(quick):
    for how in ({"correlation": 0}, {"missing": 1.5}, {"leak_score": True}):
        with pytest.raises(ValueError):
            features.FeatureChecker(**how)
    with pytest.raises(ValueError):
        features.check(quick, "gone")
