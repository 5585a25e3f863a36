"""Tokens of whole Arrow batches as exact numbers: runs of certain bytes, without a Python loop over tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm._shingles import text_bytes

#: Bytes of words: all but space and 9 to 13.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of terms: ASCII letters and digits, and every byte of a character beyond ASCII.
TERM_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encoded(texts: pa.Array, solid: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each token of all texts, the token of each code, where each text's tokens begin and one more at the end).

    Equal tokens have equal codes and others have others: tokens are compared, not hashes of them.
    """
    data, bounds = text_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = solid[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    offsets = np.append(kept[starts], kept[-1])  # a token ends where the next one begins, once other bytes are gone
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = pc.dictionary_encode(tokens)
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, np.searchsorted(starts, bounds)
