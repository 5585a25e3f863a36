"""Nearest vectors and ranked search against plain computation."""

import math
import random

import numpy as np

from siltstone.operators import retrieve


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(6)]) for k in range(200)] + [(200, [0.0] * 6), (201, None), (202, [1.0])]
    rows += [(300 + k, rows[k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, v array<float>").repartition(3)
    asked = df.where("k % 20 = 0 and k < 200")

    def score(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    known = {k: v for k, v in ((r["k"], r["v"]) for r in df.collect()) if v is not None and len(v) == 6}
    want = [(q, k, i + 1) for q in range(0, 200, 20) for i, (_, k) in enumerate(sorted((-score(known[q], v), k) for k, v in known.items() if k != q)[:4])]
    for block, blocks in ((2048, 32), (3, 32), (3, 1)):
        monkeypatch.setattr(retrieve, "BLOCK", block)
        monkeypatch.setattr(retrieve, "BLOCKS", blocks)
        got = retrieve.nearest(df, asked, "k", "v", 4).collect()
        assert sorted((r["query"], r["id"], r["rank"]) for r in got) == sorted(want)
    assert retrieve.nearest(df, asked.limit(0), "k", "v", 4).count() == 0


def test_search_with_many_terms(spark, sf, monkeypatch):
    from siltstone.functions import text as X

    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    few = retrieve.bm25(docs, items, "doc_id", "item_id", X.ascii_words).collect()
    monkeypatch.setattr(retrieve, "FEW_TERMS", 1)
    assert sorted(retrieve.bm25(docs, items, "doc_id", "item_id", X.ascii_words).collect()) == sorted(few)


def test_metrics_of_an_item_without_good_documents(spark, tmp_path):
    from oracle import difference

    from siltstone import plans
    from siltstone.plans import catalog  # noqa: F401

    made = {
        "documents": spark.createDataFrame([(1, "red apple"), (2, "blue sky today"), (3, "red sky")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(1, "red apple"), (2, "today")], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"),
    }
    for name, df in made.items():
        df.toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    out = plans.QUERIES["rag_metrics"](spark, f"file://{tmp_path}")
    assert {r["query"]: r["ndcg"] for r in out.collect()}[2] == 0.0
    assert difference(out, str(tmp_path), plans.ORACLES["rag_metrics"]) == ""


def test_search_against_plain_scores(spark):
    import types

    import pyarrow as pa

    from siltstone.functions import text as X

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    docs = {k: None if k % 40 == 7 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(30)], k=rng.randint(0, 25))) for k in range(400)}
    items = {1: "w0 w3 w3 W9", 2: "none", 3: "w1", 4: " ".join(words)}
    bags = {k: (t or "").split() for k, t in docs.items()}
    mean = sum(map(len, bags.values())) / sum(t is not None for t in docs.values())
    df = {w: sum(w in b for b in bags.values()) for w in words}
    want = []
    for q, text in items.items():
        scores = {}
        for k, b in bags.items():
            hit = [w for w in set(text.lower().split()) if w in b]
            if hit:
                parts = (math.log(1 + (400 - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for w in hit)
                scores[k] = round(sum(parts), 6)
        want += [(q, k, i + 1) for i, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k))[:6])]
    frame = spark.createDataFrame(list(docs.items()), "d long, text string").repartition(3)
    got = retrieve.bm25(frame, spark.createDataFrame(list(items.items()), "q long, text string"), "d", "q", X.ascii_words, 6)
    assert sorted((r["query"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
    # A task hands on little more than the best of each query, however many documents match.
    shared = types.SimpleNamespace(value=(["a"], [[0]], np.array([1.0]), 4.0, [9]))
    batch = pa.record_batch([pa.array(range(5000)), pa.array([["a"] + ["b"] * (k % 50) for k in range(5000)])], ["id", "t"])
    rows = [b.num_rows for b in retrieve._scorer(shared, 5)(iter([batch]))]
    assert 5 <= sum(rows) <= 200
