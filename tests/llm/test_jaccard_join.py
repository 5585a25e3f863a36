"""Exact Jaccard join against all pairs, with regions of every kind."""

import random
import re

import pytest

from siltstone.llm import jaccard_join as J


def brute(docs):
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: docs[k][0])] = min(a, b, key=lambda k: docs[k][0])
    return {d: (len(sets[i]), docs[find(i)][0]) for i, (d, _) in enumerate(docs)}


def copies(n=9):
    """A chain of copies, each a little further from the first, a star of near copies, and documents that share a passage."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs, own = [], list(base)
    for k in range(n):
        docs.append((k, " ".join(own)))
        own = own[:1] + own[2:] + [f"new{k}"]
    for k in range(n):
        own = [f"s{i}" for i in range(200)]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = f"e{k}x{rng.randrange(9)}"
        docs.append((1000 + k, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(2000 + k, passage + " " + " ".join(f"q{k}n{i}" for i in range(rng.randint(1, 40)))) for k in range(n)]
    docs += [(3000, None), (3001, ""), (3002, "one two"), (3003, "ONE Two"), (3004, "  "), (3005, docs[0][1].upper()), (3006, docs[5][1])]
    return docs


@pytest.mark.parametrize("pivots", [8, 1])
def test_agrees_with_all_pairs(spark, as_rows, monkeypatch, pivots):
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "WHOLE", 2048 if pivots > 1 else 2)
    docs = copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in as_rows(J.join(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute(docs)


@pytest.mark.parametrize("hub", [10, 12])
def test_hub_whose_variants_are_not_linked(spark, as_rows, hub):
    base = " ".join(f"h{i}" for i in range(hub))
    docs = [(0, base)] + [(1 + k, f"{base} v{k}" if k % 2 else f"v{k} {base}") for k in range(300)]
    docs += [(1000 + k, f"v{k} {base} v{k}" + " u" * (k % 3)) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in as_rows(J.join(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute(docs)
    assert sum(c == 0 for _, c in got.values()) > 300


def test_documents(spark, sf, as_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in as_rows(J.join(docs))}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs, as_rows):
    got = {r["doc_id"]: r["component_id"] for r in as_rows(J.join(odd_docs))}
    assert got[8] == got[9] == 8 and got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4 and got[None] is None
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in as_rows(kept)) == [0, 1, 3, 4, 5, 6, 6, 7, 8]
    assert as_rows(J.join(no_docs)) == []


def test_nothing_linked(spark, as_rows):
    docs = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(5)] + [(9, "one")]
    assert {r["doc_id"]: r["component_id"] for r in as_rows(J.join(spark.createDataFrame(docs, "doc_id long, text string")))} == {k: k for k, _ in docs}
