"""Benchmark passages: recall of exact and near copies, agreement with brute force, odd rows."""

import re
from collections import Counter

from siltstone.llm import decontaminate as D


def words(text):
    drop = {c: None for c in D._DROPPED}
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(drop).translate({c: c + 32 for c in range(65, 91)}))


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def brute(docs, items):
    out = set()
    for d, text in docs:
        g = grams(words(text))
        for i, item in items:
            h = grams(words(item))
            n = min(len(g), len(h))
            if n and any(D.similarity(Counter(g[k : k + n]), Counter(h)) >= 0.8 for k in range(len(g) - n + 1)):
                out.add((d, i))
    return out


ITEM = " ".join(f"item{i}" for i in range(60))


def test_finds_exact_and_near_passages(spark, as_rows):
    w = ITEM.split()
    texts = {
        1: "before it " + ITEM + " after it",
        2: "noise " * 30 + " ".join(w[:30] + ["changed"] + w[31:]) + " more",
        3: "no such thing",
        4: " ".join(w[:40]),
        5: ITEM.upper() + "!!",
        6: " ".join(w[5:]) + " and then",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in as_rows(D.hits(docs, bench))}
    assert got == brute(texts.items(), [(7, ITEM), (8, "short one")])
    assert {(1, 7), (2, 7), (5, 7)} <= got and (3, 7) not in got
    assert {r["doc_id"] for r in as_rows(D.clean(docs, bench))} == set(texts) - {d for d, _ in got}


def test_table_agrees_with_brute_force(spark, sf, as_rows):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in as_rows(D.hits(docs, bench))} == want


def test_blocks_of_the_benchmark(spark, sf, as_rows, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, as_rows(D.hits(docs, bench))))
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    assert sorted(map(str, as_rows(D.hits(docs, bench)))) == whole


def test_hamming_index_misses_nothing():
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(200)]
    index = D.HammingIndex(base, 20)
    for p in base[:50]:
        q = p
        for b in rng.sample(range(64), 20):
            q ^= 1 << b
        assert [i for i, x in enumerate(base) if (x ^ q).bit_count() <= 20] == sorted(index.near(q))


def test_odd_rows(spark, odd_docs, no_docs, as_rows):
    bench = spark.createDataFrame([(1, "shared line of several words here"), (2, None)], "item_id long, text string")
    assert {r["doc_id"] for r in as_rows(D.hits(odd_docs, bench))} == {1, 2}
    assert as_rows(D.hits(no_docs, bench)) == [] and as_rows(D.hits(odd_docs, bench.limit(0))) == []
    assert D.clean(odd_docs, bench).columns == odd_docs.columns
    assert len(as_rows(D.clean(odd_docs, bench))) == odd_docs.count() - 2
