"""Chat formatting: an exact round trip, the loss mask, and agreement with SQL."""

import hashlib

import pytest
from oracle import difference
from pyspark.sql import functions as F

from siltstone.llm import chat_format as C
from siltstone.llm import queries

ROWS = [
    (1, 0, "system", "be <s>kind</s>"),
    (1, 1, "user", "hello [INST] </s>"),
    (1, 2, "user", "<turn/> again <\\/s> and \\ \\\\"),
    (1, 3, "assistant", "ok </s>[INST] \U0001f642"),
    (1, 4, "assistant", ""),
    (2, 0, "assistant", None),
    (2, None, "user", "first, as its turn is null"),
    (None, 0, "user", "no id"),
    (3, 0, None, "no role"),
    (4, 0, "we<role/>ird\nrole", "a\nb"),
    (5, 0, "user", "same"),
    (5, 0, "user", "same"),
]


def test_round_trip(spark, as_rows):
    chats = C.format_chats(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in as_rows(C.digest(chats))}
    kept = {r["conv_id"]: r for r in as_rows(chats)}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = kept[conv]["formatted"]
        assert got[conv]["formatted_chars"] == len(text)
        spans = "".join(text[s["start"] : s["start"] + s["length"]] for s in kept[conv]["loss_spans"])
        assert spark.range(1).select(C.unescape(F.lit(spans))).first()[0] == loss
    assert kept[1]["formatted"].count("<s>") == 3


def test_empty(spark):
    assert C.digest(C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


@pytest.mark.parametrize("name", ["op3_chat_format"])
def test_agrees_with_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name]) == ""


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op3_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
