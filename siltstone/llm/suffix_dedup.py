"""Exact removal of repeated byte strings by bucket-pointer refinement.

A suffix array would put suffixes that share their first ``span`` bytes into one bucket.
Buckets are refined as in Schuermann and Stoye's algorithm: q-gram buckets first, then
by the bucket identifiers of later offsets, reusing what earlier rounds have settled. An
identifier here is a 64-bit hash of the bucket's common string, so the identifier at any
offset is known where the text is, without an exchange, and a bucket of any size is
never gathered: it is known by its identifier, its number of members and its first one.

Round 0. Every string of ``span`` bytes is filed under its minimal q-gram (by hash, the
leftmost), a function of the string alone. Runs of neighbouring strings with one minimal
q-gram form a segment. q-grams that occur once are settled: none of their strings repeats.
Round 1. Segments of the other q-grams: a segment equal to an earlier one (same bytes,
same place of the q-gram) is a repeat as a whole. A q-gram with one segment is settled.
Round 2. What is left is parted by the offset of the q-gram into cells of 8 strings; a
cell equal to an earlier one repeats as a whole; a cell's core (what its strings share)
with one continuation only is settled.
Round 3. Single strings of the cells that are left.

The first occurrence is by document, then by place, and is found by an aggregation with
partial sums on the map side. What is found to be a repeat is settled and takes no part
in later rounds: whatever equals it equals its first occurrence too. Between rounds only
bitmaps of a fixed size go to the workers, of open buckets and of first occurrences;
their false hits cost rows, never results.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _shingles as S
from siltstone.llm._common import python_ready, stash, unstash
from siltstone.llm.line_dedup import bit_table, maybe_in

SPAN, GRAM, CELL = 100, 32, 8
#: log2 of the bits of a bitmap of buckets, and bytes of text handled at a time.
BITS, SLICE_BYTES = 25, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Slice:
    """Segments of some texts laid end to end: arrays lo, hi (starts of strings, inclusive), anchor, row."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, texts: pa.Array, span: int = SPAN, gram: int = GRAM) -> None:
        self.span, self.gram = span, gram
        data, self.bounds = S.text_bytes(texts)
        self.data, n = data, len(data)
        if len(Slice.powers) <= n:
            one = np.ones(1, np.uint64)
            Slice.powers = np.cumprod(np.concatenate([one, np.full(n, _BASE)]), dtype=np.uint64)
            Slice.inverses = np.cumprod(np.concatenate([one, np.full(n, _INVERSE)]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Slice.powers[:n], out=self.sums[1:])
        wide = span - gram + 1
        m = n - span + 1
        if m <= 0:
            self.lo = self.hi = self.anchor = self.row = np.zeros(0, np.int64)
            return
        order = S.mixed((self.sums[gram:] - self.sums[:-gram]) * Slice.inverses[: n - gram + 1])
        low = np.uint64((1 << max(26, n.bit_length())) - 1)  # the place breaks ties: the leftmost is least
        key = (order & ~low) | np.arange(len(order), dtype=np.uint64)
        pad = np.full(-(-len(key) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        pad[: len(key)] = key
        square = pad.reshape(-1, wide)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:m], ahead[wide - 1 : wide - 1 + m]) & low
        row = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))[:m]
        whole = np.arange(m) + span <= self.bounds[1:][row]
        new = np.ones(m, bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], m) - 1
        ok = whole[starts]
        self.lo, self.hi = starts[ok], ends[ok]
        self.anchor, self.row = least[self.lo].astype(np.int64), row[self.lo].astype(np.int64)

    def ids(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """Bucket identifiers of the strings [start, end)."""
        plain = (self.sums[ends] - self.sums[starts]) * Slice.inverses[starts]
        more = np.asarray(ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.asarray(salt).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        return S.mixed(plain + more)

    def grams(self) -> np.ndarray:
        """Identifiers of the segments' q-grams."""
        return self.ids(self.anchor, self.anchor + self.gram)

    def segments(self, keep: np.ndarray):
        """(core, full, first string, strings) of segments."""
        lo, hi, anchor = self.lo[keep], self.hi[keep], self.anchor[keep]
        return self.grams()[keep], self.ids(lo, hi + self.span, (anchor - lo) << 8 | (hi - lo)), lo, hi - lo + 1, self.row[keep]

    def cells(self, keep: np.ndarray):
        """(core, full, first string, strings) of the cells of segments; a cell beyond its text has a full id of its own."""
        lo, hi, anchor, row = (x[keep] for x in (self.lo, self.hi, self.anchor, self.row))
        low, high = (anchor - hi) // CELL, (anchor - lo) // CELL
        many = high - low + 1
        of = np.repeat(np.arange(len(lo)), many)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        a, b = anchor[of] - cell * CELL - (CELL - 1), anchor[of] - cell * CELL  # starts of the cell's strings, inclusive
        begin, end = self.bounds[row[of]], self.bounds[row[of] + 1]
        core = self.ids(b, a + self.span, cell + 1)
        inside = (a >= begin) & (b + self.span <= end)
        full = self.ids(np.maximum(a, begin), np.minimum(b + self.span, end), cell + 1)
        first, last = np.maximum(a, lo[of]), np.minimum(b, hi[of])
        full = np.where(inside, full, full ^ np.uint64(0x5555555555555555))
        return core, full, first, last - first + 1, row[of]

    def strings(self, first: np.ndarray, many: np.ndarray, row: np.ndarray):
        """(id, id, start, 1) of the single strings of cells."""
        start = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        ids = self.ids(start, start + self.span)
        return ids, ids, start, np.ones(len(start), np.int64), np.repeat(row, many)


class Bitmap:
    """A set of identifiers, somewhat larger than it should be."""

    def __init__(self, rows: list) -> None:
        self.words = np.zeros(1 << (BITS - 6), np.uint64)
        if rows:
            self.words[np.array([r[0] for r in rows])] = np.array([r[1] for r in rows], np.int64).view(np.uint64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = ids >> np.uint64(64 - BITS)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(ids: DataFrame, column: str) -> Bitmap:
    """Bitmap of a column of identifiers; at most 2^(BITS - 6) words reach the driver, whatever the input."""
    spread = F.shiftrightunsigned(F.col(column), 64 - BITS)
    found = ids.select(F.shiftright(spread, 6).alias("slot"), spread.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    return Bitmap(found.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect())


def _rows(docs: DataFrame, stage: int, maps: list[Bitmap]) -> DataFrame:
    """Rows of a round: in round 0 (gram, n); later (core, full, d, p, n, o).

    p holds a checksum of the text and the start, o identifies the occurrence. maps: open q-grams; then open buckets and
    first occurrences of round 1, and of round 2.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, 1, SLICE_BYTES):
                s = Slice(part.column(1))
                grams = s.grams()
                if stage == 0:
                    ids, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], ["core", "n"])
                    continue
                have = shared.value
                keep = np.flatnonzero(have[0].has(grams) if stage == 1 else have[1].has(grams))
                sums, docs_ = np.zeros(part.num_rows, np.int64), part.column(0).to_numpy(zero_copy_only=False)
                for i in np.unique(s.row[keep]).tolist():
                    sums[i] = zlib.crc32(s.data[s.bounds[i] : s.bounds[i + 1]]) >> 1

                def occurrence(full, start, row):
                    place = sums[row] << 32 | (start - s.bounds[row])
                    return place, S.mixed(full + S.mixed(place.astype(np.uint64)) + docs_[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

                core, full, start, many, row = s.segments(keep)
                place, o = occurrence(full, start, row)
                if stage > 1:
                    keep = keep[have[2].has(o)]
                    core, full, start, many, row = s.cells(keep)
                    place, o = occurrence(full, start, row)
                if stage > 2:
                    ok = have[3].has(core) & have[4].has(o)
                    core, full, start, many, row = s.strings(start[ok], many[ok], row[ok])
                    place, o = occurrence(full, start, row)
                columns = [core.view(np.int64), full.view(np.int64), docs_[row], place, many, o.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["core", "full", "d", "p", "n", "o"])

    return docs.mapInArrow(run, "core long, n long" if stage == 0 else "core long, full long, d long, p long, n long, o long")


def _release(spark) -> None:
    """Lets Spark's cleaner delete the shuffle files of rounds that are over."""
    gc.collect()
    spark._jvm.System.gc()


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, p, n): runs of n strings of SPAN bytes that also start earlier; p is a checksum of the text << 32 | first start."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.col(text).alias("t"))
    grams = _rows(docs, 0, []).groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    maps = [bitmap(grams, "core")]
    found = []
    for stage in (1, 2, 3):
        _release(spark)
        rows = stash(_rows(docs, stage, maps), f"round-{stage}")
        firsts = rows.groupBy("core", "full").agg(F.min(F.struct("d", "p", "o")).alias("first"), F.count(F.lit(1)).alias("m"))
        firsts = stash(firsts, f"firsts-{stage}")
        many = firsts.where(F.col("m") > 1).select(F.col("full").alias("id"), "first.d", "first.p").toDF("id", "d1", "p1")
        repeat = (F.col("d") != F.col("d1")) | (F.col("p") != F.col("p1"))
        mine = maybe_in(rows, "full", bit_table(many, "id")).join(many, F.col("full") == F.col("id")).where(repeat)
        found.append(stash(mine.select("d", "p", "n"), f"repeats-{stage}"))
        if stage < 3:
            split = firsts.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
            maps.append(bitmap(split, "core"))
            maps.append(bitmap(firsts.join(split, "core").select("first.o"), "o"))
        unstash(rows)
        unstash(firsts)
    out = found[0].unionByName(found[1]).unionByName(found[2])
    _release(spark)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (null: empty), spans (array of struct<start, end>, bytes, removed) and kept (binary).

    Every byte is removed that lies in a string of SPAN bytes which also starts earlier: in a smaller document, or in
    the same one at an earlier byte. Overlaps count; all is judged on the input. Shorter texts have no such string. Null
    ids come first. Rows of one id and one text are one document (neither is earlier); of one id and several texts,
    ordered by a checksum. Other columns are left out; an empty table gives no row. Strings are compared by 64-bit ids.
    """
    gone = repeats(docs, doc_id, text).groupBy("d", F.shiftright("p", 32).alias("v")).agg(
        F.collect_list(F.shiftleft(F.col("p").bitwiseAND(F.lit((1 << 32) - 1)), 8).bitwiseOR(F.col("n"))).alias("runs")
    )
    gone = stash(gone, "gone")
    marked = bitmap(gone.select(F.xxhash64("d").alias("x")), "x")
    shared = docs.sparkSession.sparkContext.broadcast(marked)  # of a fixed size
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d")
    ).withColumn("x", F.xxhash64("d"))

    def part(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.filter(pa.array(shared.value.has(x) == hit))

        return base.mapInArrow(run, f"id {kind}, t string, d long, x long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            runs = batch.column(2)
            bounds, values = np.asarray(runs.offsets), runs.values.to_numpy(zero_copy_only=False)
            for i, t in enumerate(batch.column(1)):
                raw = t.as_buffer()
                own = np.sort(values[bounds[i] : bounds[i + 1]])
                starts = own >> 8
                ends = np.maximum.accumulate(starts + (own & 255) - 1 + SPAN) if len(own) else own
                fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(own) else own
                low, high = starts[fresh], ends[np.append(fresh[1:], len(own)) - 1] if len(own) else own
                spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, of), pa.array(kept, pa.binary())], [doc_id, "text", "spans", "kept"])

    shape = f"`{doc_id}` {kind}, text string, spans array<struct<start:long,end:long>>, kept binary"
    touched = part(True).withColumn("v", F.shiftright(F.crc32(F.encode("t", "UTF-8")), 1))
    joined = touched.join(gone, ["d", "v"], "left").select("id", "t", F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs")).mapInArrow(cut, shape)
    alone = part(False).select(
        F.col("id").alias(doc_id), F.col("t").alias("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.encode("t", "UTF-8").alias("kept")
    )
    return joined.unionByName(alone)


def digest(cleaned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Sizes, spans and a hash of what is kept."""
    return cleaned.select(
        doc_id,
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
