"""Counts against a plain count; thresholds that follow the groups; odd rows."""

import collections
import re

from siltstone.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_counts(spark, sf, as_rows):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in as_rows(queries.op7_quality(spark, sf)):
        own = counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == own
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r["base_failed"] and r["kept"])


def test_thresholds_follow_the_group(spark, as_rows):
    word = lambda i, n: "abcdefghij"[i % 10] * n
    text = lambda i, n: " ".join(word(i + j, n) + str(j) for j in range(30))
    rows = [(i, text(i, 4 + i % 2), "en", "s") for i in range(300)] + [(1000 + i, text(i, 14 + i % 2), "xx", "s") for i in range(300)]
    rows += [(5000, text(1, 16), "en", "s"), (5001, text(1, 3), "xx", "s")]
    kept = {r["doc_id"]: r["kept"] for r in as_rows(quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert not kept[5000] and not kept[5001]
    assert all(v for k, v in kept.items() if k < 5000)


def test_symbols_are_rejected(spark, as_rows):
    clean = [(i, " ".join(f"word{i}n{j}" for j in range(40)), None, None) for i in range(250)]
    junk = [(999, " ".join(f"word{j}###" for j in range(40)), None, None)]
    kept = {r["doc_id"]: r["kept"] for r in as_rows(quality.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")))}
    assert not kept[999] and all(kept[i] for i in range(250))


def test_outliers_of_each_metric_and_side(spark, as_rows):
    def text(i, n=60, size=4, lines=10):
        w = ["abcdefghijklmnopqrstuvwxyz"[(i * 7 + j * 3) % 26] * (size - 1 + (i + j) % 3) + f"{i % 10}{j % 10}" for j in range(n)]
        return "\n".join(" ".join(w[k::lines]) for k in range(lines))

    rows = [(i, text(i, 40 + i % 40)) for i in range(400)]
    plain = text(3)
    planted = {
        "short words": " ".join("abcdefghijklmnopqrstuvwxyz"[j * 5 % 26] for j in range(26)) + " " + " ".join("ab"[j % 2] + "cdefghijklm"[j % 11] for j in range(22)),
        "long words": text(3, size=9),
        "symbols": plain + " ########",
        "repeated lines": plain + ("\nab1 cd2" * 4),
        "repeated words": plain + " a1 b2 c3 d4 e5 f6 and a1 b2 c3 d4 e5 f6",
        "many words": "\n".join(text(i, 60) for i in range(40)),
        "few words": text(3, 12, lines=2),
    }
    rows += [(1000 + k, x) for k, x in enumerate(planted.values())]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in as_rows(quality.quality(docs))}
    assert [name for k, name in enumerate(planted) if got[1000 + k]["kept"] or got[1000 + k]["base_failed"]] == []
    assert all(got[i]["kept"] for i in range(400))


def test_odd_rows(odd_docs, no_docs, as_rows):
    out = quality.quality(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns)
    rows = as_rows(out)
    assert len(rows) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if not (r["text"] or "").strip())
    assert as_rows(quality.quality(no_docs)) == []


def test_clashing_columns(spark, as_rows):
    docs = spark.createDataFrame([(k, "a line of some words that is long enough to be kept here " * 2, "en", "a", 1.0, "x") for k in range(20)], "doc_id long, text string, lang string, source string, low_mean_word double, g_lang string")
    out = quality.quality(docs)
    assert {"low_mean_word", "g_lang"} <= set(out.columns) and len(as_rows(out)) == 20
