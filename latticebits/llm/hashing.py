"""Hashes of words and of runs of values, and exact numbers for byte strings.

Hashes only route, sketch and sample here; where two things count as equal their bytes are compared (`numbered`). The
one exception is near-duplicate shingles, which are told apart by their 64-bit hash: see minhash.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


def of_words(words: pa.Array) -> np.ndarray:
    """A 64-bit SipHash of each string or binary."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def of_runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` hashes in a row: runs of powers of two by doubling, then what is left of size."""
    out, have, power, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - have)
                out = mix(out[: max(n, 0)] * GOLDEN + power[have : have + max(n, 0)])
            have += width
        if have == size:
            return out
        n = max(0, len(power) - width)
        power = mix(power[:n] * GOLDEN + power[width : width + n])
        width *= 2


def least_of(h: np.ndarray, reach: int) -> np.ndarray:
    """Where the least of each `reach` hashes in a row stands: the first such, by their high halves."""
    low = np.uint64(0xFFFFFFFF)
    least, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= reach:
        least = np.minimum(least[: max(0, len(least) - width)], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: max(0, len(least) - (reach - width))], least[reach - width :])
    return (least & low).astype(np.int64)


def numbered(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For byte strings end to end a number each, the same for the same bytes only, rising by first appearance."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def numbered_rows(rows: np.ndarray) -> np.ndarray:
    """The same for the rows of a matrix."""
    if not len(rows):
        return np.zeros(0, np.int64)
    rows = np.ascontiguousarray(rows)
    kind = pa.binary(rows.shape[1] * rows.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(rows)]).dictionary_encode().indices.to_numpy().astype(np.int64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new
