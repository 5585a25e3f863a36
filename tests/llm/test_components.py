"""Connected components against a union-find, the rounds they take, and what the driver lets go of meanwhile."""

import random

import pytest

from siltstone.llm import _components as C
from siltstone.llm import packing as P


def by_hand(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {x: top(x) for x in root}


def graph(kind):
    draw = random.Random(5)
    ids = [draw.randrange(-(1 << 62), 1 << 62) for _ in range(200)]
    if kind == "chain":
        return list(zip(ids, ids[1:]))
    if kind == "hub in the middle":
        return [(sorted(ids)[100], x) for x in ids]  # with a loop
    if kind == "random":
        return [tuple(draw.choices(ids, k=2)) for _ in range(170)]
    if kind == "twice, both ways":
        return [(5, 3), (3, 5), (5, 3), (7, 5), (9, 9)]
    return []


@pytest.fixture
def counted(monkeypatch):
    """Names of what is written, and how often driver memory is let go of."""
    told = {"written": [], "released": 0}

    def stash(df, name, keep=C.stash):
        told["written"].append(name)
        return keep(df, name)

    def release(spark):
        told["released"] += 1

    for module in (C, P):
        monkeypatch.setattr(module, "stash", stash)
        monkeypatch.setattr(module, "release", release, raising=False)
    return told


@pytest.mark.parametrize("kind", ["chain", "hub in the middle", "random", "twice, both ways", "none"])
def test_components(spark, counted, kind):
    edges = graph(kind)
    found = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == by_hand(edges)
    assert counted["released"] == len(counted["written"]) - 1  # once a round


def test_stars_need_no_round(spark, counted):
    edges = [(1, x) for x in range(2, 40)] + [(x, 50) for x in range(60, 70)]
    assert {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()} == by_hand(edges)
    assert counted["written"] == ["edges"]


def test_a_round_that_ends_in_stars_is_the_last(spark, counted):
    C.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert counted["written"] == ["edges", "edges"]


def test_packing_lets_go_after_each_turn(spark, counted):
    pieces = spark.createDataFrame([(i, 1 + i * 37 % 100) for i in range(60)], "row long, length long")
    assert P.assign(pieces, 100, "row").count() == 60
    turns = sum(x.startswith("swept") for x in counted["written"])
    assert turns and counted["released"] == turns
