"""Directly addressable codes for token ids.

An id is split into 8-bit chunks, lowest first. Level k holds chunk k of every id that has one, a bitmap with a
bit per entry that tells whether the id goes on, and a directory with the number of set bits before every 512th.
Token i is found by reading level 0 at i and, while the bit there is set, level k+1 at the rank of that bit: no
block is decoded. Layout, little-endian: b"DAC1", uint32 levels, uint64 n; then for each level uint64 entries,
the chunk bytes, the bitmap (bit 0 first), the directory as uint32.

Defined results: no ids give a header without levels; any 32-bit ids, repeated ones too, come back as they were.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

MAGIC = b"DAC1"
STEP = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """ids: unsigned 32-bit. The code of no ids is a header without levels."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[bits], dtype=np.uint64)])
        directory = ones[np.arange(0, len(rest), STEP) // 8].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Reader:
    """A code in memory, or anywhere: `code` may be a function that gives n bytes from an offset on, such as a read at a
    place of a file, and then no access takes more bytes than it needs."""

    def __init__(self, code: bytes | Callable[[int, int], bytes]):
        self.read = code if callable(code) else lambda at, n: code[at : at + n]
        head = self.read(0, 16)
        if head[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        n_levels, self.n = struct.unpack_from("<IQ", head, 4)
        at, self.levels = 16, []  # entries, where chunks, bitmap and directory begin
        for _ in range(n_levels):
            (n,) = struct.unpack("<Q", self.read(at, 8))
            bits = at + 8 + n
            directory = bits + -(-n // 8)
            self.levels.append((n, at + 8, bits, directory))
            at = directory + 4 * -(-n // STEP)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Token i, from one byte, one directory entry and at most STEP bits a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bits, directory) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << (8 * k)
            start = i // STEP
            seen = np.frombuffer(self.read(bits + start * STEP // 8, (i >> 3) - start * STEP // 8 + 1), np.uint8)
            if not seen[-1] >> (i & 7) & 1:
                return value
            (before,) = struct.unpack("<I", self.read(directory + 4 * start, 4))
            i = before + int(_ONES[seen[:-1]].sum()) + int(_ONES[seen[-1] & ((1 << (i & 7)) - 1)])
        return value

    def decode(self) -> np.ndarray:
        """All tokens, as uint32."""
        out = np.zeros(self.n, dtype="<u4")
        at: np.ndarray | None = None
        for k, (n, chunks, bits, directory) in enumerate(self.levels):
            part = np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32) << (8 * k)
            if at is None:
                out |= part
            else:
                out[at] |= part
            more = np.unpackbits(np.frombuffer(self.read(bits, directory - bits), np.uint8), count=n, bitorder="little").astype(bool)
            at = np.flatnonzero(more) if at is None else at[more]
        return out
