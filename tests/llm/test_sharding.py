"""Histogram sort: sizes near equal, slots gapless, hot groups split, odd rows."""

import collections
import zlib

from siltstone.llm import queries, sharding


def held(rows, shards, slack):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= slack * mean + max((r["size"] for r in rows), default=0)


def test_documents(spark, sf, as_rows):
    rows = as_rows(queries.op5_sharding(spark, sf))
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(v) + 8, zlib.crc32(v)) for k, v in docs.items()}
    held(rows, 24, 0.002)


def test_hot_group_is_split(spark, as_rows):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    rows = as_rows(sharding.shard_rows(docs, 6))
    held(rows, 6, 0.01)
    assert len({r["shard"] for r in rows if r["text"] == "the same text"}) >= 2


def test_repeated_rows_are_parted(spark, as_rows):
    rows = [(7, "x" * 100_000)] * 8 + [(None, "y" * 5_000)] * 40 + [(k, "small") for k in range(40)]
    held(as_rows(sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4)), 4, 0.01)


def test_slices(spark, as_rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_SLICE", 50)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    held(as_rows(sharding.shard_rows(docs, 4)), 4, 0.01)


def test_odd_rows(odd_docs, no_docs, as_rows):
    out = sharding.shard_rows(odd_docs, 3)
    assert [c for c in out.columns if c not in ("size", "shard", "slot")] == [c for c in odd_docs.columns if c != "shard"]
    rows = as_rows(out)
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["text"] is None} == {8}
    held(rows, 3, 0.01)
    assert as_rows(sharding.shard_rows(no_docs, 3)) == []
