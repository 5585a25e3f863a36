"""Ranked lexical search: postings in term buckets, joined with the items' terms, scored in integers, summed, ranked.

Documents are parted into terms in Python workers, Arrow batch by Arrow batch, and leave as
postings: term, its bucket, document, occurrences, length of the document. Postings are
written once, sorted by bucket and term within each task's share of the documents; the
counts over the corpus, the terms' weights and the scores are then joins and groupings over
them. A document's postings stay in one share, so that its scores for an item are summed
before anything is exchanged; what is exchanged grows with the pairs of item and document
that have a term in common, not with the postings that match (on the tables of the tests
there are a sixth as many). A term that every document has is spread over all shares.

The items are the stated query set. While their terms are few (WANTED), only these terms get
postings and the joined sides are broadcast; with more, every term gets postings and the
joins are shuffled, frequent terms parted by a salt. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import _shingles as S
from siltstone.llm._common import python_ready, stash, unstash
from siltstone.llm._tokens import TERM_BYTES, encoded
from siltstone.llm.decontaminate import pa_type

#: A term: characters that are not ASCII punctuation, space or control characters; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of an item.
TOP = 50
#: Buckets of terms; salts of a shuffled join.
BUCKETS, SALTS = 64, 16
#: Most pairs of item and term that are broadcast (at most about 100 bytes each; longer terms are not broadcast), and bytes of a term.
WANTED, TERM_MOST = 200_000, 64


def bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the terms of each item once; items of one id are one item with the terms of all its rows."""
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(terms).alias("term")).distinct()


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(bucket, term, row, doc_id, tf, n), written and sorted by bucket and term in each share of the documents.

    ``row`` tells documents apart, whatever their ids; ``n`` is a document's number of terms with repeats. Every document
    also has one row without a term (term, tf and bucket are null). terms: only these get postings.
    """
    python_ready(docs.sparkSession)
    kind = pa_type(docs, doc_id)
    wanted = docs.sparkSession.sparkContext.broadcast(terms)  # at most WANTED terms of TERM_MOST bytes, see rank()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        known = None if wanted.value is None else pa.array(wanted.value, pa.large_string()).cast(pa.large_binary())
        for batch in batches:
            for part in S.slices(batch, 1):
                codes, words, bounds = encoded(part.column(1), TERM_BYTES, lower=True)
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                if known is not None:
                    keep = pc.is_in(words, known).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
                    codes, owner = codes[keep], owner[keep]
                keys, tf = np.unique(codes * part.num_rows + owner, return_counts=True)
                term, at = np.divmod(keys, part.num_rows)
                at, ids = np.concatenate([at, np.arange(part.num_rows)]), part.column(0).cast(kind)
                none = pa.nulls(part.num_rows, pa.string())
                names = words.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())
                counts = pa.concat_arrays([pa.array(tf.astype(np.int64)), pa.nulls(part.num_rows, pa.int64())])
                arrays = [pa.concat_arrays([names, none]), pa.array(row + at), ids.take(pa.array(at)), counts, pa.array(sizes[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "row", "doc_id", "tf", "n"])
                row += part.num_rows

    schema = f"term string, row long, doc_id {docs.schema[doc_id].dataType.simpleString()}, tf long, n long"
    rows = docs.select(doc_id, text).mapInArrow(run, schema)
    return stash(rows.select(F.when(F.col("term").isNotNull(), bucket()).alias("bucket"), "*").sortWithinPartitions("bucket", "term"), "postings")


def weights(posts: DataFrame, terms: DataFrame, documents: int, few: bool) -> DataFrame:
    """(item_id, bucket, term, w): each item's terms that some document has, with their weights above 0."""
    counts = posts.where("term is not null").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = terms.withColumn("bucket", bucket())
    if few:
        counts = counts.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")  # at most WANTED rows
    w = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(counts, ["bucket", "term"]).select("item_id", "bucket", "term", w.alias("w")).where("w > 0")


def scores(posts: DataFrame, weighted: DataFrame, documents: int, total: int, few: bool) -> DataFrame:
    """(item_id, row, doc_id, score): every pair of an item and a document with a score above 0."""
    m = F.expr(f"100 - 50 + ((50 * n * {documents}L) div {max(1, total)}L)")
    # A posting's own share of the score is worked out once, not for each item that has the term.
    part = posts.where("term is not null").withColumn("m", m).withColumn("t", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)"))
    part = part.select("bucket", "term", "row", "doc_id", "t")
    if few:
        met = part.join(F.broadcast(weighted), ["bucket", "term"])  # at most WANTED rows
    else:
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
        met = part.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(weighted.select("*", salts), ["bucket", "term", "salt"])
    return met.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("t")).alias("score")).where("score > 0")


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score; of equal scores the smaller id first.

    With N documents that have a term, L terms in all, n in the document, df documents with the term and tf occurrences:
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N div L), and a score is the sum over an item's terms of
    w ((10^9 tf) div (1000 tf + 20 m)), in 64-bit integers. Null and empty texts have no terms. Each row of ``docs`` is a
    document, also where ids repeat (their order among equal scores and ids is open) or are null (before all others);
    items of one id are one item, items without a term or a match give no row. Other columns are left out.
    """
    terms = stash(item_terms(items, item_id, item_text), "item-terms")
    many, longest = terms.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("term")), F.lit(0))).first()
    few = many <= WANTED and longest <= TERM_MOST
    wanted = [r[0] for r in terms.select("term").distinct().collect()] if few else None  # at most WANTED
    posts = postings(docs, doc_id, text, wanted)
    documents, total = posts.where("term is null").agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weighted = stash(weights(posts, terms, documents, few), "weights")
    unstash(terms)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = scores(posts, weighted, documents, total, few).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
