"""Periodic runs of words: a harmonic grid of (period, place) pairs, whose extensions are searched all at once.

A run of period q is a longest stretch of words in which words q apart are the same. In one
of exponent 4 or more, at least 3q neighbouring words equal the word q further on, so one of
the places 0, 3q, 6q, ... is among them: over all periods these are about n/3 (1 + 1/2 + 1/3 +
...) pairs, not n^2. Pairs whose two words differ are out. For the others, how far the text and
itself moved by q agree to the right and to the left is found by binary search on prefix
hashes, for all pairs of many texts together. Each run's words are then compared themselves; a
hash that said too much is noticed there, and the texts are searched again by another base (a
hash never says too little). A stretch that several periods reach is one run, of the smallest.

Texts stay where they are: no shuffle. A text is searched by one task, with about 150 bytes a
word beside it; pairs are built PAIRS at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _shingles as S
from siltstone.llm._common import free_name, python_ready
from siltstone.llm._tokens import WORD_BYTES, encoded

#: Least exponent, and least number of words, of a run.
EXPONENT, LEAST = 4, 6
#: Pairs that are searched together, and bytes of text.
PAIRS, SLICE_BYTES = 1 << 20, 1 << 20
#: Odd numbers as bases of the prefix hashes; beyond the first only after a hash was wrong.
BASES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Prefixes:
    """Hashes of all stretches of a sequence of numbers, modulo 2^64."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        n = len(codes)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(S.mixed(codes.astype(np.uint64) + np.uint64(base & 0xFFFF)) * self.powers[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` numbers from a on seem to equal those from a + q on."""
        left, right = self.sums[a + size] - self.sums[a], self.sums[a + q + size] - self.sums[a + q]
        return left * self.powers[q] == right

    def right(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers from a on equal those q further on, ``most`` at the most."""
        return _longest(lambda at, size: self.same(a[at], q[at], size), most)

    def left(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before a equal those q further on."""
        return _longest(lambda at, size: self.same(a[at] - size, q[at], size), most)


def _longest(holds, most: np.ndarray) -> np.ndarray:
    """The largest size up to ``most`` for which a condition holds that holds for all smaller ones, for each element."""
    low, high = np.zeros_like(most), most.copy()
    at = np.flatnonzero(low < high)
    while len(at):
        mid = (low[at] + high[at] + 1) // 2
        ok = holds(at, mid)
        low[at[ok]] = mid[ok]
        high[at[~ok]] = mid[~ok] - 1
        at = at[low[at] < high[at]]
    return low


def _grid(bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the pairs of all texts, about PAIRS at a time."""
    sizes = np.diff(bounds)
    many = np.where(sizes >= LEAST, sizes // least, 0)
    step = least - 1
    # Texts are taken together until their periods are PAIRS; a longer text's periods are all listed, which are fewer than its words.
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, max(1, many.sum()), PAIRS), side="left")
    for first, last in zip(cuts, [*cuts[1:], len(many)]):
        own = many[first:last]
        text = np.repeat(np.arange(first, last), own)
        if not len(text):
            continue
        period = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + 1
        places = (sizes[text] - 1 - period) // (step * period) + 1
        ends = np.cumsum(places)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            p = places[at:to]
            number = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            t, q = np.repeat(text[at:to], p), np.repeat(period[at:to], p)
            yield t, bounds[t] + number * step * q, q
            at = to


def runs_of(codes: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of all texts, by text, start and period; codes: the texts' words as numbers."""
    for base in BASES:
        found = _search(codes, bounds, exponent, Prefixes(codes, base))
        begin = bounds[found[:, 0]] + found[:, 1]
        if all(np.array_equal(codes[b : b + n - q], codes[b + q : b + n]) for b, n, q in zip(begin.tolist(), found[:, 2].tolist(), found[:, 3].tolist())):
            return found
    raise ArithmeticError("prefix hashes of four bases were wrong")


def _search(codes: np.ndarray, bounds: np.ndarray, exponent: int, prefixes: Prefixes) -> np.ndarray:
    got = []
    for text, place, q in _grid(bounds, exponent):
        like = np.flatnonzero(codes[place] == codes[place + q])
        text, place, q = text[like], place[like], q[like]
        right = prefixes.right(place, q, bounds[text + 1] - place - q)
        left = prefixes.left(place, q, place - bounds[text])
        length = left + right + q
        good = length >= np.maximum(LEAST, exponent * q)
        start = place - left - bounds[text]
        got.append(np.unique(np.stack([x[good] for x in (text, start, length, q)], axis=1), axis=0))
    rows = np.concatenate(got) if got else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]  # by text, start, length, period
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _without(text: str, n: int, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text, joined by one space, without those that a run holds beyond its first period."""
    parts = text.encode().split()  # at space and the bytes 9 to 13
    if runs:
        gone = np.zeros(n + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        parts = [w for w, g in zip(parts, np.cumsum(gone).tolist()) if not g]
    return b" ".join(parts).decode()


def find_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT) -> DataFrame:
    """docs with n_words, runs (start, length and period of each, in words, by start and period) and collapsed.

    A run is a stretch of words whose smallest period is q, in which words q apart are the same, of at least ``exponent``
    times q and at least 6 words, that no neighbouring word extends. ``collapsed`` has the words, joined by one space,
    without those that some run holds after its first q words. A null or empty text has no words, no runs and an empty
    ``collapsed``. Rows are on their own: repeated rows each get theirs, an empty table gives no row. Columns of the input
    keep their names; a new column whose name is taken gets underscores.
    """
    names = []
    for name in ("n_words", "runs", "collapsed"):
        names.append(free_name([*docs.columns, *names], name))
    python_ready(docs.sparkSession)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, at, SLICE_BYTES):
                codes, _, bounds = encoded(part.column(at), WORD_BYTES)
                found = runs_of(codes, bounds, exponent)
                cuts = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
                triples = [list(map(tuple, found[a:b, 1:].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
                sizes = np.diff(bounds)
                left = [_without(t or "", n, r) for t, n, r in zip(part.column(at).to_pylist(), sizes.tolist(), triples)]
                values = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values).cast(kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), lists, pa.array(left, pa.string())], [*part.schema.names, *names])

    added = {names[0]: "bigint", names[1]: RUNS, names[2]: "string"}
    schema = docs.withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    return docs.mapInArrow(run, schema)


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which the words of a tenth of the texts, picked by a hash of the id, go round from some word on.

    With h the crc32 of the decimal id, g = h div 10 and n words: where h is divisible by 10 and n > 0, words from
    a = g mod n on repeat with period 1 + (n - a) div (3 + g mod 8). Other texts, and those without an id, stay as they are.
    """
    from siltstone.llm._common import words

    names: list[str] = []
    for name in ("w", "n", "g", "a", "p"):
        names.append(free_name([*docs.columns, *names], name))
    w, n, g, a, p = map(F.col, names)
    h = F.crc32(F.col(doc_id).cast("string"))
    # Only picked texts are parted into words; `slice` and `array_repeat` build the rest without a function for each word.
    out = docs.withColumn(names[0], F.when(h % 10 == 0, words(F.col(text))))
    out = out.withColumn(names[1], F.size(names[0]).cast("long")).withColumn(names[2], F.floor(h / 10))
    out = out.withColumn(names[3], F.when(n > 0, g % n).cast("int"))
    out = out.withColumn(names[4], (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    round_ = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(round_, F.lit(1), (n - a).cast("int"))), " ")
    return out.withColumn(text, F.when(n > 0, made).otherwise(F.col(text))).drop(*names)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Number, longest run and digests of the rows of find_runs()."""
    first = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),  # runs come by start and period
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("longest", first).select(
        doc_id,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
