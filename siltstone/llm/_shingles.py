"""Hashes of words and of word shingles for whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
#: Bytes of text hashed at a time.
SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text; one row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        below = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, below + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more at the end); null is empty."""
    import pyarrow.compute as pc

    whole = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    got = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, bounds - bounds[0]


class Hasher:
    """Hashes words: runs of bytes other than space and 9 to 13; A-Z count as a-z; bytes in ``drop`` count as absent."""

    def __init__(self, drop: bytes = b"") -> None:
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.drop = np.zeros(256, bool)
        self.drop[list(drop)] = True
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of all texts, and where each text's words begin (one more at the end)."""
        data, bounds = text_bytes(texts)
        if self.drop.any():
            keep = ~self.drop[data]
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            data = data[keep]
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        if len(self.up) <= n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        fresh = edge[:n].copy()
        fresh[1:] |= ~solid[:-1]
        last = edge[1:].copy()
        last[:-1] |= ~solid[1:]
        starts, ends = np.flatnonzero(solid & fresh), np.flatnonzero(solid & last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.low[data].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts]), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and where each text's begin; a text of 1 to k - 1 words is one shingle."""
    sizes = np.diff(bounds)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * np.uint64(_STEPS[j])
    counts = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    ends = np.cumsum(counts)
    starts = np.concatenate([[0], ends])
    at = np.repeat(bounds[:-1] - starts[:-1], counts) + np.arange(int(ends[-1]) if len(ends) else 0)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    out = full[np.minimum(at, len(full) - 1)] if len(full) else np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in short.tolist():
            own = words[bounds[i] : bounds[i + 1]]
            out[starts[i]] = (own * np.array(_STEPS[: len(own)], np.uint64)).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(out), starts
