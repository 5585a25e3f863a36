"""Splits: exact sizes, whole groups, balance, time, repair of empty parts; every configuration loses and leaks nothing."""

import datetime
import itertools
import random

import pytest

from siltstone.operators import splits

START = datetime.datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sizes(s):
    return {r[0]: r[1] for r in s.rows.groupBy("split").count().collect()}


def test_exact_sizes_and_balance(spark):
    rng = random.Random(0)
    df = frame(spark, [(k, rng.choices("abc", [6, 3, 1])[0]) for k in range(1000)], "x long, y string")
    s = splits.split(df, target="y")
    r = s.report()
    assert s.strategy["method"] == "stratified" and s.strategy["target_kind"] == "categorical" and s.strategy["n_strata"] == 3
    assert r["sizes"] == {"train": 700, "val": 100, "test": 200} and r["ok"]
    assert r["balance_max_deviation"] < 0.005
    assert s.train.count() == 700 and s.test.columns == ["x", "y"]
    assert {x["x"] for x in splits.split(df.repartition(7), target="y").test.collect()} == {x["x"] for x in s.test.collect()}
    assert {x["x"] for x in splits.split(df, target="y", seed=1).test.collect()} != {x["x"] for x in s.test.collect()}


def test_numeric_target_in_bins(spark):
    rng = random.Random(1)
    df = frame(spark, [(k, rng.expovariate(1)) for k in range(300)], "x long, y double")
    s = splits.split(df, target="y")
    assert s.strategy["target_kind"] == "numeric" and s.strategy["n_strata"] == 10
    assert s.report()["balance_max_deviation"] < 0.03 and sizes(s) == {"train": 210, "val": 30, "test": 60}
    assert splits.split(df.selectExpr("x", "x % 5 AS y"), target="y").strategy["target_kind"] == "categorical"


def test_rare_classes(spark):
    s = splits.split(frame(spark, [(k, y) for k, y in enumerate("a" * 10 + "b" * 10 + "c")], "x long, y string"), target="y")
    assert s.strategy["stratified"] and any("pooled" in w for w in s.warnings) and sum(sizes(s).values()) == 21
    s = splits.split(frame(spark, list(enumerate("abcdefghij")), "x long, y string"), target="y")
    assert s.strategy["method"] == "random" and sizes(s) == {"train": 7, "val": 1, "test": 2}
    s = splits.split(frame(spark, list(enumerate("ab" * 5)), "x long, y string"), target="y")
    assert s.strategy["method"] == "stratified" and sizes(s) == {"train": 7, "val": 1, "test": 2}
    assert sorted(r["y"] for r in s.test.collect()) == ["a", "b"]
    s = splits.split(frame(spark, [(k, "ab"[k % 2] if k < 60 else None) for k in range(70)], "x long, y string"), target="y")
    assert any("missing" in w for w in s.warnings) and s.report()["ok"]
    s = splits.split(frame(spark, [(k, "one") for k in range(30)], "x long, y string"), target="y")
    assert s.strategy["method"] == "random" and any("single class" in w for w in s.warnings)


def test_groups_stay_whole(spark):
    rng = random.Random(2)
    df = frame(spark, [(rng.randrange(400), rng.choice("pn"), k) for k in range(4000)], "g long, y string, x long")
    s = splits.split(df, target="y", group="g")
    r = s.report()
    assert r["overlapping_groups"] == 0 and r["ok"] and r["balance_max_deviation"] < 0.05
    assert abs(r["sizes"]["test"] - 800) <= 12 and abs(r["sizes"]["val"] - 400) <= 12  # half a group, of about ten rows
    two = splits.split(frame(spark, [(k // 25, k // 5 % 5, k) for k in range(100)], "a long, b long, x long"), group=["a", "b"])
    assert two.strategy["group_mode"] == "composite" and two.report()["groups"] == 20 and two.report()["ok"]
    some = splits.split(frame(spark, [(rng.random() if k % 2 else None, k) for k in range(200)], "customer_id double, x long"), group="customer_id")
    test = some.test.collect()
    assert any(t["customer_id"] is None for t in test) and any(t["customer_id"] is not None for t in test) and sizes(some)["test"] == 40


def test_few_units(spark):
    one = splits.split(frame(spark, [("same", k) for k in range(30)], "g string, x long"), group="g")
    assert sizes(one) == {"train": 30} and any("test is empty" in w for w in one.warnings) and one.report()["ok"]
    three = splits.split(frame(spark, [(k // 200, k) for k in range(600)], "g long, x long"), group="g")
    assert sizes(three) == {"train": 200, "val": 200, "test": 200} and three.report()["ok"]


def test_detected_and_linked_ids(spark):
    df = frame(spark, [(k // 5, k, k % 2, k, 7, k % 2) for k in range(100)], "customer_id long, width long, valid long, row_id long, site_id long, y long")
    assert splits.id_columns(df, ["y"]) == ["customer_id"]
    assert splits.split(df, group="auto", target="y").strategy["group"] == ["customer_id"]
    rows = list(zip([1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], [10, 20, 20, 30, 40, 40, 50, 50, 60, 60, 70, 70], range(12)))
    s = splits.split(frame(spark, rows, "customer_id long, device_id long, x long"), group="auto", val=0, test=0.4)
    assert s.strategy["group_mode"] == "linked" and s.report()["overlapping_groups"] == 0 and s.val is None
    assert len({r["split"] for r in s.rows.where("customer_id < 3").collect()}) == 1
    assert any("identifier" in w for w in splits.split(frame(spark, [(k, k % 2) for k in range(50)], "x long, y long"), group="auto").warnings)
    for name in ("customer_id", "userId", "session_uuid", "patient_no", "customer", "ID", "account_number", "uuid", "customerid"):
        assert splits.is_id_like(name), name
    for name in ("width", "valid", "paid", "grid", "price", "session_length", "x", 3, "phone_number"):
        assert not splits.is_id_like(name), name


def test_time(spark):
    rows = [(START + datetime.timedelta(hours=k), k // 4, k) for k in range(100)]
    random.Random(5).shuffle(rows)
    s = splits.split(frame(spark, rows, "ts timestamp, customer_id long, x long"), time="ts")
    assert sizes(s) == {"train": 70, "val": 10, "test": 20} and s.report()["ordered"] and s.strategy["method"] == "chronological"
    assert sorted(r["x"] for r in s.test.collect()) == list(range(80, 100))
    late = [(datetime.datetime(2024, 6, 1) if g == 5 else t, g, x) for t, g, x in rows]
    s = splits.split(frame(spark, late, "ts timestamp, customer_id long, x long"), time="ts", group="customer_id")
    assert 5 in {r["customer_id"] for r in s.test.collect()} and s.report()["ok"] and s.report()["ordered"]
    with pytest.raises(ValueError, match="missing"):
        splits.split(frame(spark, [(None, 1), (START, 2)], "ts timestamp, x long"), time="ts")


def test_copies_stay_together(spark):
    df = frame(spark, [(k % 40, "v") for k in range(400)], "x long, y string")
    assert splits.split(df).report()["leaked_rows"] == 0
    s = splits.split(df, dedupe=False)
    assert sizes(s) == {"train": 280, "val": 40, "test": 80} and s.report()["leaked_rows"] > 0


CASES = list(itertools.product([0, 1, 11, 80], [None, "y", "score"], [None, "customer_id", "auto"], [None, "ts"]))


@pytest.mark.parametrize("n,target,group,time", random.Random(4).sample(CASES, 14))
def test_nothing_is_lost(spark, n, target, group, time):
    rng = random.Random(n)
    rows = [(rng.randrange(max(1, n // 3)), START + datetime.timedelta(hours=rng.randrange(1000)), rng.choices("abc", [6, 3, 1])[0], rng.gauss(0, 1), k) for k in range(n)]
    rows += rows[: n // 5]
    s = splits.split(frame(spark, rows, "customer_id long, ts timestamp, y string, score double, x long"), target=target, group=group, time=time, val=0 if n % 2 else 0.1)
    r = s.report()
    assert r["ok"] and sorted(tuple(x)[:5] for x in s.rows.collect()) == sorted(rows)


def test_wrong_parameters(spark):
    for how in ({"test": 1.0}, {"test": 0.6, "val": 0.5}, {"test": -1}, {"group": []}, {"target": "x", "time": "x"}, {"stratify": "yes"}):
        with pytest.raises(ValueError):
            splits.Splitter(**how)
    with pytest.raises(TypeError):
        splits.Splitter(test="a")
    df = frame(spark, [(1,), (2,)], "x long")
    for how in ({"target": "gone"}, {"test": 5}, {"column": "X"}):
        with pytest.raises(ValueError):
            splits.split(df, **how)


def test_many_strata_are_ranked_by_ranges(spark, monkeypatch):
    df = frame(spark, [(k % 37, k) for k in range(800)], "y long, x long").selectExpr("string(y) AS y", "x")
    want = sorted(map(tuple, splits.split(df, target="y").rows.collect()))
    monkeypatch.setattr(splits, "FEW_STRATA", 5)
    assert sorted(map(tuple, splits.split(df, target="y").rows.collect())) == want
