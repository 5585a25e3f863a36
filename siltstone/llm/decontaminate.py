"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

An item of s word shingles is sought in windows of s shingles. A window and an item of
one size can only reach the similarity t if they share 2ts/(1+t) shingles (counted with
multiplicity), so windows with fewer shingles of the benchmark in them are passed over;
that loses none. The other windows get a 64-bit SimHash of their weighted shingles. The
fingerprints of the items of that size are indexed by radius + 1 blocks of bits: two
fingerprints within the radius agree in one block at least, so the lookup finds every
item within the radius. Those are verified by the weighted Jaccard similarity of their
shingle multisets. Windows slide by one word over the whole text.

The benchmark is the stated query set. It is parted into blocks of a bounded number of
words; each block is broadcast and met by all documents, so neither side's size matters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _shingles as S
from siltstone.llm._common import python_ready

#: Words of a shingle, least similarity, and Hamming radius (at similarity 0.8, 10 bits are expected to differ, deviation 3).
K, SIMILARITY, RADIUS = 5, 0.8, 20
#: Bytes of benchmark text that one broadcast holds.
BLOCK_BYTES = 16 << 20
#: ASCII characters that don't count: all but letters, digits and white space.
_DROPPED = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def fingerprint(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """64-bit SimHash of shingles, each as often as it occurs or by its weight."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    votes = (2 * bits - 1) if weights is None else (2 * bits - 1) * weights[:, None]
    return int.from_bytes(np.packbits(votes.sum(axis=0) > 0, bitorder="little").tobytes(), "little")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingIndex:
    """Fingerprints by blocks of bits; near() finds all within the radius."""

    def __init__(self, prints: list[int], radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = [{} for _ in self.blocks]
        for i, p in enumerate(prints):
            for table, (shift, mask) in zip(self.tables, self.blocks):
                table.setdefault(p >> shift & mask, []).append(i)

    def near(self, p: int) -> list[int]:
        """Numbers of the fingerprints that differ from p in at most ``radius`` bits."""
        found: set[int] = set()
        for table, (shift, mask) in zip(self.tables, self.blocks):
            found.update(table.get(p >> shift & mask, ()))
        return [i for i in found if (self.prints[i] ^ p).bit_count() <= self.radius]


class Scanner:
    """Finds the items of one benchmark block in texts."""

    def __init__(self, ids: list, texts: list[str | None], k: int = K, least: float = SIMILARITY, radius: int = RADIUS) -> None:
        self.k, self.least = k, least
        self.hasher = S.Hasher(_DROPPED)
        hashes, bounds = S.shingles(*self.hasher.words(pa.array(texts, pa.string())), k)
        self.ids, self.bags, self.sizes = [], [], []
        pairs = []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                bag = Counter(hashes[a:b].tolist())
                pairs += [(h, len(self.ids)) for h in bag]
                self.ids.append(ids[i])
                self.bags.append(bag)
                self.sizes.append(int(b - a))
        pairs.sort()
        self.keys = np.unique(np.array([h for h, _ in pairs], np.uint64))
        self.firsts = np.searchsorted(np.array([h for h, _ in pairs], np.uint64), self.keys)
        self.firsts = np.append(self.firsts, len(pairs))
        self.owners = [i for _, i in pairs]
        bits = max(16, min(26, 4 + len(pairs).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True
        self.by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sizes):
            self.by_size.setdefault(s, []).append(i)
        self.indexes = {
            s: HammingIndex([fingerprint(*_arrays(self.bags[i])) for i in items], radius) for s, items in self.by_size.items()
        }

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item number, first shingle, shingles, similarity): the best window of each item in each text."""
        hashes, bounds = S.shingles(*self.hasher.words(texts), self.k)
        marked = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        if not len(marked) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, hashes[marked]), len(self.keys) - 1)
        real = self.keys[at] == hashes[marked]
        marked, at = marked[real], at[real]
        rows = np.searchsorted(bounds, marked, side="right") - 1
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
            row = int(rows[a])
            begin, end = int(bounds[row]), int(bounds[row + 1])
            places: dict[int, list[int]] = {}
            for place, key in zip((marked[a:b] - begin).tolist(), at[a:b].tolist()):
                for item in self.owners[self.firsts[key] : self.firsts[key + 1]]:
                    places.setdefault(item, []).append(place)
            done: dict[tuple[int, int], dict[int, float]] = {}
            for item, hits in sorted(places.items()):
                found = self._best(hashes[begin:end], item, hits, done)
                if found:
                    yield row, item, *found

    def _best(self, own: np.ndarray, item: int, hits: list[int], done: dict) -> tuple[int, int, float] | None:
        """The first of the most similar windows of an item's size, or None."""
        size = self.sizes[item]
        width = min(size, len(own))
        need = int(np.ceil(self.least * (size + width) / (1 + self.least) - 1e-9))
        if len(hits) < need:
            return None
        places = np.array(hits)
        low, high = max(0, places[0] - (width - need)), min(len(own) - width, places[-1])
        if low > high:
            return None
        starts = np.arange(low, high + 1)
        inside = np.searchsorted(places, starts + width) - np.searchsorted(places, starts)
        best = None
        group, index = self.by_size[size], self.indexes[size]
        for start in starts[inside >= need].tolist():
            near = done.get((size, start))
            if near is None:  # one lookup for all items of this size
                window = own[start : start + width]
                bag = Counter(window.tolist())
                near = done[size, start] = {group[i]: similarity(bag, self.bags[group[i]]) for i in index.near(fingerprint(*_arrays(bag)))}
            score = near.get(item, 0.0)
            if score >= self.least - 1e-12 and (best is None or score > best[2]):
                best = (start, width, score)
        return best


def _arrays(bag: Counter) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(bag), np.uint64), np.array(list(bag.values()), np.int64)


def blocks(bench: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[str | None]]]:
    """The benchmark's ids and texts, in blocks of about BLOCK_BYTES."""
    total = bench.agg(F.sum(F.octet_length(text))).first()[0] or 0
    many = -(-total // BLOCK_BYTES)
    for number in range(many):
        rows = bench.where(F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(many)) == number).select(item_id, text).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield [r[0] for r in rows], [r[1] for r in rows]


def hits(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_shingles, similarity: the best window of each item found in each document.

    Texts are compared as words in lower case without ASCII punctuation. Null and empty texts and items, and items
    without a word, have no match. A document shorter than an item is one window. Equal items are all reported, repeated
    documents each. Other columns are left out; an empty table gives no row.
    """
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, item_id {bench.schema[item_id].dataType.simpleString()}, first_word long, n_shingles long, similarity double"
    python_ready(docs.sparkSession)
    ids, items = pa_type(docs, doc_id), pa_type(bench, item_id)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(bench, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = None
            for batch in batches:
                scanner = scanner or Scanner(*shared.value)
                for part in S.slices(batch, 1):
                    found = list(scanner.scan(part.column(1)))
                    row, item, start, size, score = zip(*found) if found else ([], [], [], [], [])
                    arrays = [part.column(0).take(pa.array(row, pa.int64())).cast(ids), pa.array([scanner.ids[i] for i in item], items)]
                    arrays += [pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, [doc_id, "item_id", "first_word", "n_shingles", "similarity"])

        out = out.unionByName(docs.select(doc_id, text).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; texts without words stay."""
    python_ready(docs.sparkSession)
    at = docs.columns.index(text)
    for block in blocks(bench, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = None
            for batch in batches:
                scanner = scanner or Scanner(*shared.value)
                for part in S.slices(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, *_ in scanner.scan(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    """Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
