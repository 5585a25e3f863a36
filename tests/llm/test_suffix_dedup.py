"""Repeated byte strings against a plain scan."""

import hashlib
import random

from siltstone.llm import suffix_dedup as S


def brute(docs, span=100):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def check(spark, docs, as_rows):
    rows = as_rows(S.digest(S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute(docs)


def test_planted_repeats(spark, as_rows):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (99, 100, 101, 130, 400)]
    docs = [(i, noise(rng.randint(0, 150)) + rng.choice(passages) + noise(rng.randint(0, 150)) + rng.choice(passages)) for i in range(120)]
    docs += [(200, "a" * 700), (201, "a" * 120), (202, "ab" * 300), (203, None), (204, ""), (205, passages[4] * 3), (206, docs[0][1]), (207, docs[0][1][3:])]
    check(spark, docs, as_rows)


def test_documents(spark, sf, as_rows):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], as_rows)


def test_odd_rows(odd_docs, no_docs, as_rows):
    rows = as_rows(S.digest(S.remove_repeats(odd_docs)))
    assert len(rows) == odd_docs.count()
    assert len({r["kept_sha256"] for r in rows if r["doc_id"] == 6}) == 1
    assert as_rows(S.digest(S.remove_repeats(no_docs))) == []
