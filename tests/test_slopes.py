"""Median slopes against all pairs; drifts of rates over shifts."""

import random

import numpy as np

from siltstone.operators import slopes


def plain(x, y):
    s = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] != x[j]]
    return float(np.median(s)) if s else None


def test_counts():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        v = np.array([rng.choice([1.0, 2.0, 3.0, rng.random()]) for _ in range(n)])
        assert slopes.turned(v) == sum(v[i] >= v[j] for i in range(n) for j in range(i + 1, n))


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for g in range(40):
        n = rng.choice([1, 2, 3, 10, 41, 80])
        for k in range(n):
            x = float(k) if g % 3 else float(rng.randrange(n))
            rows.append((g, x, rng.choice([0.5 * x + rng.gauss(0, 1), float(rng.randrange(4)), 1000.0 * rng.random()])))
    rows += [(99, None, 1.0), (99, 1.0, None), (98, 1.0, 5.0), (98, 1.0, 7.0)]
    got = {r["g"]: r for r in slopes.theil_sen(spark.createDataFrame(rows, "g long, x double, y double"), ["g"], "x", "y").collect()}
    for g in sorted({r[0] for r in rows if None not in r}):
        x, y = zip(*[(a, b) for h, a, b in sorted(r for r in rows if None not in r) if h == g])
        want = plain(x, y)
        if want is None:
            assert got[g]["slope"] is None and got[g]["n"] == len(x)
            continue
        assert abs(got[g]["slope"] - want) <= 1e-9 * max(1, abs(want))
        assert abs(got[g]["intercept"] - float(np.median(np.array(y) - want * np.array(x)))) < 1e-6
    assert 99 not in got


def test_a_long_series_needs_no_list_of_pairs():
    rng = np.random.default_rng(3)
    x = np.arange(20_000.0)
    y = 3 * x + rng.normal(size=len(x)) + np.where(rng.random(len(x)) < 0.2, 1e6, 0)
    assert abs(slopes.median_slope(x, y) - 3) < 0.01


def test_rate_drift(spark):
    rng = random.Random(4)
    rows = []
    for k in range(20):
        rows += [("worn", k, 100 - 1.5 * k + rng.gauss(0, 1), 400, 480), ("steady", k, 100 + rng.gauss(0, 2), 400, 480), ("idle", k, 100 - 1.5 * k, 10, 480)]
    rows += [("new", 0, 100.0, 400, 480), ("new", 1, 50.0, 400, 480)]
    out = {r["m"]: r for r in slopes.rate_drift(spark.createDataFrame(rows, "m string, k long, rate double, run long, due long"), ["m"], "k", "rate", run="run", scheduled="due").collect()}
    assert set(out) == {"worn", "steady"} and out["worn"]["drifting"] and not out["steady"]["drifting"]
    assert -0.35 < out["worn"]["change"] < -0.2 and out["worn"]["tau"] < -0.8
