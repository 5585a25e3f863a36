"""Kernels that SQL can't express, against plain Python or invariants."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import pii
from siltstone.functions import text as X
from siltstone.operators import chunks, drift, media, prepare


def test_chunks_tile_the_text():
    text = "# Head\n\nFirst paragraph. It has two sentences.\n\n" + "word " * 400 + "\n\nLast."
    got = chunks.chunks_of(text, 120, 20)
    assert "".join(text[c["core_start"] : (got[i + 1]["core_start"] if i + 1 < len(got) else len(text))] for i, c in enumerate(got)) == text
    assert all(c["end"] - c["core_start"] <= 120 for c in got)


def test_pvalues():
    assert abs(drift.chi2_pvalue(3.841, 1) - 0.05) < 1e-3 and abs(drift.chi2_pvalue(18.307, 10) - 0.05) < 1e-3
    assert drift.ks_pvalue(0.0, 100, 100) == 1.0 and drift.ks_pvalue(0.5, 200, 200) < 1e-6


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", True), ("4111111111111112", False), (None, False)], "v string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(pii.luhn_valid(F.col("v")), "ok").collect())
    v = spark.createDataFrame([("2363", True), ("2364", False)], "v string, ok boolean")
    assert all(r[0] == r[1] for r in v.select(pii.verhoeff_valid(F.col("v")), "ok").collect())


def test_numbers_and_names(spark):
    df = spark.createDataFrame([("1,234",), ("$12.50",), ("(300)",), ("45%",), ("007",), ("x",)], "v string")
    assert [r[0] for r in df.select(prepare.parse_number(F.col("v"))).collect()] == [1234.0, 12.5, -300.0, 0.45, None, None]
    assert prepare.clean_names([" A b ", "a B", "c"]) == ["a_b", "a_b_2", "c"]


def test_text_kernels():
    assert X.sentences_of("Dr. Smith came. He left!") == ["Dr. Smith came.", "He left!"]
    assert X.syllables_of("banana") == 3 and X.syllables_of("make") == 1
    assert X.transliterate_of("Привет") == "Privet" and X.detect_of("the cat and the dog are in the house")[0] == "en"


def test_pictures_and_sound():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (64, 64)).astype(float)
    assert media.dhash(image) == media.dhash(image) and bin((media.phash(image) ^ media.phash(image + 1)) & (2**64 - 1)).count("1") <= 2
    spots = np.zeros((60, 60))
    for y, x in ((10, 10), (30, 40), (50, 15)):
        spots[y - 3 : y + 3, x - 3 : x + 3] = 200
    assert media.count_blobs(spots) == 3
    rate = 8000
    sound = np.concatenate([np.zeros(rate), 0.5 * np.sin(np.arange(rate) * 0.3), np.zeros(rate)]) + rng.normal(0, 1e-4, 3 * rate)
    back, r = media.read_wav(media.write_wav(sound, rate))
    assert r == rate and np.abs(back - sound).max() < 1e-3
    spans = media.speech_spans(sound, rate)
    assert len(spans) == 1 and abs(spans[0][0] - 1) < 0.1 and abs(spans[0][1] - 2) < 0.1
    assert media.frames_events([image] * 6)["frozen"] == 1


def test_schema_and_cleaner(spark):
    df = spark.createDataFrame([("1", "yes", 1.0), ("2", "no", None), ("n/a", "yes", 3.0)], "a string, b string, c double")
    out = prepare.Cleaner.fit(df).apply(df)
    assert dict(out.dtypes) == {"a": "double", "b": "boolean", "c": "double"} and out.where("a is null or c is null").count() == 0
    rules = prepare.Schema.infer(df)
    assert rules.validate(df).count() == 0 and prepare.Schema.from_json(rules.to_json()).columns.keys() == rules.columns.keys()
