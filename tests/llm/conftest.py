"""Small hostile tables for the operators of training data."""

import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i}" for i in range(40))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns that clash with the operators' own."""
    rows = [
        (1, BASE + "\nshared line of several words here\ntail one", "en", "a", 10, "x", 1),
        (2, BASE + "\nshared line of several words here\ntail two", "en", "a", None, None, 2),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "shard", 3),
        (5, "   \n\t ", "de", None, 6, "slot", 3),
        (6, LONG, "en", "b", len(LONG), "size", 4),
        (6, LONG, "en", "b", len(LONG), "size", 4),
        (7, "Ünïcödé \U0001f642 text with odd spaces and </s>[INST] marks <\\/s>", "fr", "b", 5, "kept", 5),
        (8, "one", "en", "a", 3, "text2", 6),
        (9, "one", "en", "a", 3, "text2", 6),
        (None, "a text without an id but with several words in it, quite a few", "en", "a", 3, "n", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, offset long")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture
def as_rows():
    return rows
