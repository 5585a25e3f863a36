"""Boosted models on planted signals: scores, importance, explanations, settings, failures ahead."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import models, scores


@pytest.fixture(scope="module")
def runs(spark):
    """Pass only within windows of temperature and pressure; speed, operator and a blank column say nothing."""
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        t, p, s = rng.uniform(180, 240), rng.uniform(8, 16), rng.uniform(50, 70)
        good = 195 <= t <= 225 and p > 10.5
        rows.append((t if rng.random() > 0.03 else None, p, s, rng.choice(["line-1", "line-2"]), rng.choice(["ana", "bo", None]), None, "pass" if good else "fail"))
    return spark.createDataFrame(rows, "temperature double, pressure double, speed double, machine string, operator string, blank double, quality string").cache()


@pytest.fixture(scope="module")
def fitted(runs):
    return models.QualityModel(trees=15).fit(runs, "quality")


def test_quality_scores_and_importance(fitted, runs):
    assert fitted.task == "classification" and fitted.good == "pass" and fitted.classes == ["fail", "pass"]
    assert set(fitted.metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert fitted.metrics["accuracy"] > 0.85 and fitted.metrics["roc_auc"] > 0.9
    assert list(fitted.importance)[:2] == ["temperature", "pressure"] and abs(sum(fitted.importance.values()) - 1) < 1e-9
    assert fitted.importance["blank"] == 0 and any("blank" in n for n in fitted.notes)
    loss = {r["feature"]: r["loss"] for r in fitted.permutation_importance(runs).collect()}
    assert min(loss["temperature"], loss["pressure"]) > 5 * max(abs(loss["speed"]), abs(loss["operator"]), abs(loss["machine"]))
    out = fitted.predict(runs.limit(50)).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["prediction"] == fitted.classes[r["probabilities"].index(max(r["probabilities"]))] for r in out)


def test_explanations_and_settings(fitted):
    row = {"temperature": 210.0, "pressure": 13.0, "speed": 60.0, "machine": "line-1", "operator": "never seen"}
    good, bad = fitted.explain(row), fitted.explain(row | {"temperature": 182.0})
    assert good["contributions"]["temperature"] > 0.05 > abs(good["contributions"]["speed"]) and bad["contributions"]["temperature"] < 0
    assert bad["score"] < good["baseline"] < good["score"]
    ranges = fitted.optimal_ranges()
    assert 190 <= ranges["temperature"][0] <= 200 and 220 <= ranges["temperature"][1] <= 230
    assert 9.5 <= ranges["pressure"][0] <= 11.5 and ranges["pressure"][1] > 15
    assert fitted.uninformative == ["speed"] and list(ranges)[:2] == ["temperature", "pressure"]
    with pytest.raises(ValueError):
        fitted.explain({"temperature": 1})


def test_a_number_as_outcome(spark):
    rng = random.Random(2)
    rows = [(x := rng.uniform(-3, 3), rng.choice("abc"), rng.random(), x * x + rng.gauss(0, 0.2)) for _ in range(500)]
    model = models.QualityModel(trees=15).fit(spark.createDataFrame(rows, "x double, c string, z double, defects double"), "defects", higher_is_better=False)
    assert model.task == "regression" and model.metrics["r2"] > 0.85 and model.metrics["mae"] <= model.metrics["rmse"]
    low, high = model.optimal_ranges()["x"]
    assert -2 < low < 0 < high < 2 and next(iter(model.importance)) == "x" and "z" in model.uninformative


def test_more_than_two_classes(spark):
    rng = random.Random(3)
    rows = [(x := rng.uniform(0, 3), "abc"[int(x)]) for _ in range(300)]
    model = models.QualityModel(trees=8).fit(spark.createDataFrame(rows, "x double, grade string"), "grade")
    assert model.classes == ["a", "b", "c"] and model.good == "a" and model.metrics["accuracy"] > 0.9 and model.metrics["roc_auc"] is None


def test_good_classes_and_errors(spark):
    assert models.good_class(["FAILED", "Passed"]) == ("Passed", True) and models.good_class(["scrap", "x"]) == ("x", True)
    assert models.good_class(["x", "y"]) == ("y", False) and models.good_class(["不合格", "合格"]) == ("合格", True)
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, None)], "x double, y string")
    for call in (lambda: models.QualityModel("other"), lambda: models.QualityModel().fit(df, "y"), lambda: models.QualityModel().fit(df, "gone"), lambda: models.QualityModel().fit(df, "y", test=1.0), lambda: models.QualityModel().predict(df), lambda: models.QualityModel("regression").fit(df, "y")):
        with pytest.raises(ValueError):
            call()


def labelled(spark, seed, machines=4, n=150, event=60):
    """A vibration that rises over the 12 rows before each failure."""
    rng = random.Random(seed)
    rows = []
    for m in range(machines):
        for t in range(n):
            left = event - 1 - t % event
            rows.append((m, t, 20 + rng.gauss(0, 1), rng.gauss(0, 0.3) + (3 * (12 - left) / 12 if left < 12 else 0), left == 0))
    return spark.createDataFrame(rows, "machine long, t long, temp double, vibration double, failed boolean")


def test_failures_ahead(spark):
    model = models.MaintenanceModel(width=5, trees=12).fit(labelled(spark, 1), ["machine"], "t", "failed", ["temp", "vibration"], horizon=10)
    fresh = labelled(spark, 2)
    found = model.evaluate(fresh)
    assert found["roc_auc"] > 0.95 and found["average_precision"] > 0.85 and found["f1"] > 0.8 and found["n_rows"] == 600
    assert next(iter(model.importance)).startswith("vibration")
    out = model.predict(fresh.drop("failed"))
    assert out.columns == ["machine", "t", "temp", "vibration", "probability", "risk"]
    by = {r["t"]: r for r in out.where("machine = 0").collect()}
    assert by[58]["risk"] == "high" and by[30]["risk"] == "low"
    healthy = fresh.withColumn("failed", F.lit(False))
    assert model.evaluate(healthy)["roc_auc"] is None
    with pytest.raises(ValueError, match="no failures"):
        models.MaintenanceModel().fit(healthy, ["machine"], "t", "failed", ["temp"])
    with pytest.raises(ValueError, match="every row"):
        models.MaintenanceModel().fit(fresh.withColumn("failed", F.lit(True)), ["machine"], "t", "failed", ["temp"])
    with pytest.raises(ValueError):
        models.MaintenanceModel().fit(fresh, ["machine"], "t", "failed", ["temp"], horizon=0)


def test_average_precision(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.3, rng.choice([0.1, 0.2, 0.5, 0.7, rng.random()])) for _ in range(200)] + [(None, 0.5), (True, None)]
    known = [r for r in rows if None not in r]
    want = sum(sum(y for y, s in known if s >= t) / sum(s >= t for _, s in known) for y, t in known if y) / sum(y for y, _ in known)
    df = spark.createDataFrame(rows, "y boolean, s double")
    got = scores.average_precision(df, "y", "s").first()
    assert got["n"] == 200 and math.isclose(got["ap"], want)
    assert scores.average_precision(df.where("not y"), "y", "s").first()["ap"] is None
