"""Ranked search against a plain ranking and against DuckDB."""

import collections
import math
import re

import pytest
from oracle import difference

from siltstone.llm import lexical_rank, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(lexical_rank.UPPER, lexical_rank.LOWER)


def ranked(docs, items, top=50):
    bags = [(i, collections.Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(x for _, b in bags for x in b)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, terms in asked.items():
        found = []
        for (doc, bag), size in zip(bags, sizes):
            m = 100 - 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 20 * m)) for x in terms if bag[x])
            if score > 0:
                found.append((-score, doc is not None, doc if doc is not None else 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_query_against_sql(spark, sf):
    assert difference(queries.op13_lexical_rank(spark, sf), sf, queries.ORACLES["op13_lexical_rank"]) == ""


@pytest.mark.parametrize("wanted", [200_000, 0])
def test_plain_ranking(spark, sf, wanted, monkeypatch):
    """The broadcast and the shuffled way give the same rows as a plain ranking."""
    monkeypatch.setattr(lexical_rank, "WANTED", wanted)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(lexical_rank.rank(docs, items, top=7))
    assert got == ranked(docs.select("doc_id", "text").collect(), items.collect(), 7)
    assert max(r[1] for r in got) == 7


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Shared LINE, shared tail"), (1, "one"), (2, None), (3, ""), (4, "../--"), (None, "ünïcödé word1x1"), (5, "Ünïcödé a"), (6, "nowhere")], "item_id long, text string")
    got = rows(lexical_rank.rank(odd_docs, items))
    assert got == ranked(odd_docs.select("doc_id", "text").collect(), items.collect())
    assert [r[2] for r in got if r[0] == 5] and not [r for r in got if r[0] in (2, 3, 4, 6)]
    assert rows(lexical_rank.rank(no_docs, items)) == rows(lexical_rank.rank(odd_docs, items.limit(0))) == []


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "blue hen"), ("d", None)], "name string, body string")
    items = spark.createDataFrame([("q", "fox")], "key string, body string")
    got = rows(lexical_rank.rank(docs, items, "name", "body", "key", "body"))
    assert [r[:3] for r in got] == [("q", 1, "a"), ("q", 2, "b")]
