"""Conditional random field: the maths against enumeration, accuracy on held-out rows, mixed texts, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language as L
from siltstone.llm import queries


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=(3, 3))
    chance, pairs = L.posteriors(scores, moves, np.array([0]), np.array([4]), pairs=True)
    want, joint, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
        for a, b in zip(path, path[1:]):
            joint[a, b] += p
    assert np.allclose(chance, want / total, atol=1e-5) and np.allclose(pairs, joint / total, atol=1e-4)


@pytest.fixture(scope="module")
def field(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(~L.held_out(F.col("doc_id")))
    return L.fit(docs)


def test_held_out_accuracy(spark, sf, as_rows):
    rows = {r["doc_id"]: r for r in as_rows(queries.op8_language(spark, sf))}
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if rows[r["doc_id"]]["held_out"] and r["lang"]]
    assert len(docs) > 20
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs) / len(docs) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_words_of_a_mixed_text(spark, sf, field):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(L.held_out(F.col("doc_id")))
    one = {lang: " ".join(docs.where(F.col("lang") == lang).first()["text"].split()[:25]) for lang in ("en", "fr")}
    tagged = L.label_words([one["en"] + " " + one["fr"]], field)[0]
    right = sum(t == "en" for _, t in tagged[:25]) + sum(t == "fr" for _, t in tagged[25:])
    assert right / len(tagged) > 0.8


def test_odd_rows(odd_docs, no_docs, field, as_rows):
    out = L.predict(odd_docs, field)
    assert out.columns == [*odd_docs.columns, "lang_pred", "score"]
    rows = as_rows(out)
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert as_rows(L.predict(no_docs, field)) == []
    assert {r["lang_pred"] for r in as_rows(L.predict(odd_docs, L.fit(no_docs)))} == {"und"}


def test_training_reads_all_parts_of_texts(spark):
    rows = spark.createDataFrame([("en", "".join(str(k) * 100 for k in range(10)) + f"x{i}") for i in range(200)] + [("de", "")], "lang string, text string")
    texts, langs = L.sample(rows, 1000, 100)
    assert langs.count("en") == 200 and langs.count("de") == 1 and max(map(len, texts)) <= 100
    assert {t[0] for t in texts if t} == {*"0123456789", "x"}
