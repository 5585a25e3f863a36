"""Baselines learnt once: spikes of later batches, frozen levels, phases, streams, flat and unknown series."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators.baseline import Detector

HISTORY = [10.0, 10.2, 9.8, 10.1, 9.9, 10.0, 10.3, 9.7, 10.1, 9.9] * 5
START = datetime.datetime(2026, 1, 1)


def series(spark, values, name="a", start=0):
    return spark.createDataFrame([(name, start + k, v) for k, v in enumerate(values)], "s string, k long, v double")


def hits(out):
    return [r["k"] for r in out.where("anomaly").orderBy("k").collect()]


@pytest.mark.parametrize("method", ["auto", "zscore", "iqr", "rolling", "ewma"])
def test_a_later_spike(spark, method):
    made = Detector(["s"], "k", "v", method).fit(series(spark, HISTORY))
    out = made.score(series(spark, [10.0, 10.1, 25.0, 9.9], start=50))
    assert hits(out) == [52] and out.columns == ["s", "k", "v", "expected", "score", "anomaly", "confidence"]
    base = made.table.first()
    assert abs(base["level"] - 10) < 0.3 and base["scale_kind"] == ("iqr" if method == "iqr" else "mad") and base["n"] == 50
    assert {r["expected"] for r in out.collect()} == {base["level"]}
    assert base["method"] == ("rolling" if method == "auto" else method)
    prefix = {r["k"]: r["score"] for r in made.score(series(spark, [10.0, 25.0])).collect()}
    longer = {r["k"]: r["score"] for r in made.score(series(spark, [10.0, 25.0, 30.0, 10.0, 25.0])).collect()}
    assert all(longer[k] == v for k, v in prefix.items())


def test_levels_against_plain_computation(spark):
    rng = random.Random(1)
    values = [20 + rng.gauss(0, 1) for _ in range(301)]
    data = series(spark, values)
    middle = sorted(values)[150]
    mad = sorted(abs(v - middle) for v in values)[150]
    base = Detector(["s"], "k", "v", "zscore").fit(data).table.first()
    assert base["level"] == middle and math.isclose(base["scale"], 1.4826 * mad)
    assert Detector(["s"], "k", "v", "rolling").fit(data).table.first()["level"] == sorted(values[-15:])[7]
    guard = [sorted(values[max(0, k - 1) : k + 2]) for k in range(len(values))]
    guard = [(g[(len(g) - 1) // 2] + g[len(g) // 2]) / 2 for g in guard]
    mean = guard[0]
    for g in guard[1:]:
        mean = 0.7 * mean + 0.3 * g
    assert math.isclose(Detector(["s"], "k", "v", "ewma").fit(data).table.first()["level"], mean, rel_tol=1e-9)


def test_quantiles_of_many_values(spark):
    rows = 240_007
    v = F.pmod(F.col("id") * 7919, F.lit(rows)).cast("double")
    data = spark.range(0, rows, 1, 6).select((F.col("id") % 2).alias("s"), F.col("id").alias("k"), v.alias("v"))
    made = {r["s"]: r for r in Detector(["s"], "k", "v", "iqr").fit(data).table.collect()}
    for s in (0, 1):
        values = sorted(k * 7919 % rows for k in range(s, rows, 2))
        low, middle, high = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.5, 0.75))
        assert made[s]["level"] == middle and made[s]["scale"] == (high - low) / 1.349


def test_a_season_keeps_its_phase(spark):
    rng = random.Random(0)
    wave = [20 + 5 * math.sin(2 * math.pi * k / 24) + rng.gauss(0, 0.2) for k in range(96 + 7)]
    made = Detector(["s"], "k", "v", "seasonal", seasonality=24).fit(series(spark, wave))
    later = [20 + 5 * math.sin(2 * math.pi * k / 24) for k in range(103, 151)]
    later[10] = 21.0 if abs(later[10] - 21) > 2 else 29.0
    assert hits(made.score(series(spark, later, start=103))) == [113]
    by_time = lambda values, first: spark.createDataFrame([("a", START + datetime.timedelta(hours=first + k), v) for k, v in enumerate(values)], "s string, k timestamp, v double")
    timed = Detector(["s"], "k", "v", "seasonal", seasonality=24, step=3600).fit(by_time(wave, 0))
    got = timed.score(by_time(later, 103).where("v > 0").orderBy(F.rand(1)))
    assert [r["k"] for r in got.where("anomaly").collect()] == [START + datetime.timedelta(hours=113)]


def test_several_series_and_gaps(spark):
    data = series(spark, HISTORY).unionByName(series(spark, [7.0] * 40, "flat")).unionByName(series(spark, [100.0, 101.0, 99.0, None, float("nan")], "short"))
    made = Detector(["s"], "k", "v").fit(data)
    assert any("1 series do not vary" in w for w in made.warnings)
    rows = {r["s"]: r for r in made.table.collect()}
    assert rows["flat"]["scale"] is None and rows["short"]["method"] == "zscore" and rows["short"]["n"] == 3
    batch = spark.createDataFrame([("a", 1, 50.0), ("flat", 2, 100.0), ("new", 3, 1.0), ("a", 4, None), ("short", 5, 140.0), (None, 6, 1.0)], "s string, k long, v double")
    out = {r["k"]: r for r in made.score(batch).collect()}
    assert [k for k in sorted(out) if out[k]["anomaly"]] == [1, 5] and out[2]["score"] == 0
    assert out[3]["expected"] is None and out[3]["score"] is None and out[4]["score"] is None and len(out) == 6
    assert made.score(batch.limit(0)).count() == 0


def test_a_stream_is_held_against_the_table(spark, tmp_path):
    made = Detector(["s"], "k", "v", "zscore").fit(series(spark, HISTORY))
    for n, values in enumerate(([10.0, 30.0], [9.9, 10.1, -5.0])):
        series(spark, values, start=100 * n).write.mode("append").parquet(f"{tmp_path}/in")
    stream = made.score(spark.readStream.schema("s string, k long, v double").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert hits(spark.read.parquet(f"{tmp_path}/out")) == [1, 102]


def test_errors(spark):
    with pytest.raises(ValueError, match="not fitted"):
        Detector(["s"], "k", "v").score(series(spark, [1.0]))
    with pytest.raises(ValueError, match="empty"):
        Detector(["s"], "k", "v").fit(series(spark, []))
    for how in ({"method": "magic"}, {"method": "seasonal"}, {"sensitivity": 0}, {"seasonality": 1}):
        with pytest.raises(ValueError):
            Detector(["s"], "k", "v", **how)
    assert any("vote" in w for w in Detector(["s"], "k", "v", "all").fit(series(spark, HISTORY)).warnings)
