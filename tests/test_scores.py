"""Scores and windows on small tables: nulls, ties, empty tables."""

import itertools
import random

from siltstone.operators import scores


def test_auc(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, rng.choice([rng.random(), 0.5, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    pos, neg = ([s for y, s in rows if s is not None and y == want] for want in (True, False))
    wins = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg))
    got = scores.binary_curve_area(df, "y", "s").first()
    assert got["n"] == len(pos) + len(neg) and abs(got["auc"] - wins / len(pos) / len(neg)) < 1e-12
    assert tuple(scores.binary_curve_area(df.where("false"), "y", "s").first()) == (0, None)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (2.0, float("nan"))], "a double, p double")
    assert tuple(scores.regression_scores(df, "a", "p").first()) == (2, 0.5, 0.5**0.5, 0.5)
    assert scores.regression_scores(df.where("a = 1"), "a", "p").first()["r2"] is None


def test_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), (None, "a")], "y string, p string")
    got = {r["class"]: (r["support"], r["precision"], r["recall"]) for r in scores.class_scores(df, "y", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (0, 0.0, 0.0), "c": (1, 0.0, 0.0)}
    assert tuple(scores.accuracy(df, "y", "p").first()) == (3, 1 / 3)


def test_fills(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 1, None)], "k long, t long, x double")
    out = df.select("k", "t", scores.filled(df, ["k"], ["t"], "x").alias("f"), scores.filled(df, ["k"], ["t"], "x", True).alias("b"))
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 1, None, 5.0), (1, 2, 5.0, 5.0), (1, 3, 5.0, None), (2, 1, None, None)]
