"""Periodic runs against a plain search for every period; the query against the same over whole texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def runs(w, exponent=4):
    """All (start, length, period): every period by itself, stretches of equal words q apart."""
    out = {}
    n = len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, exponent * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def looped(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = looped(doc_id, text)
    found = runs(w)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_runs_of_random_words(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 60))]
            if rng.random() < 0.5:
                unit = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
                w += unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit))] + [rng.randrange(3) for _ in range(rng.randrange(9))]
            texts.append(w)
        bounds = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), bounds)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in runs(w)]


def test_wrong_hashes_are_noticed(monkeypatch):
    """With a base of zero every hash is that of the first word: the words themselves show it, and the next base is taken."""
    codes = np.array([1, 2, 1, 3] * 5 + [7, 7, 7, 7, 7, 7, 9], np.int64)
    monkeypatch.setattr(periodic_runs, "BASES", [0, *periodic_runs.BASES])
    assert [tuple(r[1:]) for r in periodic_runs.runs_of(codes, np.array([0, len(codes)])).tolist()] == runs(codes.tolist())


def test_query(spark, sf, as_rows):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(tuple(r[c] for c in names) for r in as_rows(queries.op12_periodic_runs(spark, sf)))
    assert got == sorted(expected(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) >= 3


def test_long_text_of_one_word(spark, as_rows):
    row = as_rows(periodic_runs.find_runs(spark.createDataFrame([("same " * 200_000,)], "text string")))[0]
    assert row["runs"] == [{"start": 0, "length": 200_000, "period": 1}] and row["collapsed"] == "same" and row["n_words"] == 200_000


def test_odd_rows(spark, odd_docs, no_docs, as_rows):
    docs = odd_docs.withColumnRenamed("shard", "runs").withColumnRenamed("offset", "N_WORDS")
    out = periodic_runs.find_runs(docs)
    assert out.columns == [*docs.columns, "n_words_", "runs_", "collapsed"]
    got = as_rows(out)
    assert len(got) == docs.count()
    for r in got:
        w = WORD.findall(r["text"] or "")
        assert r["n_words_"] == len(w) and [tuple(x.values()) for x in r["runs_"]] == (runs(w) if len(w) < 2000 else [])
        assert r["collapsed"] == " ".join(w)
    assert as_rows(periodic_runs.find_runs(no_docs)) == []
    every = as_rows(periodic_runs.looped(odd_docs.withColumnRenamed("shard", "w")))
    assert sorted(map(repr, (" ".join(WORD.findall(r["text"] or "")) for r in every))) == sorted(repr(" ".join(looped(r["doc_id"], r["text"]))) for r in as_rows(odd_docs))
