"""Hierarchical multi-length packing.

Documents of more than the longest window give full windows first; what is left is routed to the smallest tier that
holds it. Tiers are packed from the longest down: a piece opens a window of its tier, the gap is filled with whole
pieces of shorter tiers, the longest that fits first, and what no whole piece fills is filled by cutting the next
longer piece. Tiers are powers of two, so full windows of every tier need no padding. What stays at the end of a
task is cut into full windows of falling powers of two. Windows go longest first into step groups of equal token counts:
each into the open group whose room fits it best, pool after pool, so that only the last groups of a task can be short.
Each task packs what it reads, in pools of a bounded number of tokens: nothing is shuffled.

Defined results: null text counts as empty (one end id); null doc_id is kept; rows with one doc_id are documents of
their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from latticebits.llm import shared, tokens

TIERS = (256, 512, 1024, 2048, 4096)
POOL_TOKENS = 4 << 20
STEP_TOKENS = 16 * 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

Piece = tuple[int, int, int]  # document in the pool, start, length


def pack_pool(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Windows for documents of these lengths; all but those of the last few leftover tokens are full tiers."""
    longest, windows = tiers[-1], []
    stock: list[list[Piece]] = [[] for _ in range(longest + 1)]  # by length
    filled = 0  # bit n: stock[n] isn't empty

    def put(piece: Piece) -> None:
        nonlocal filled
        stock[piece[2]].append(piece)
        filled |= 1 << piece[2]

    def take(n: int) -> Piece:
        nonlocal filled
        piece = stock[n].pop()
        if not stock[n]:
            filled &= ~(1 << n)
        return piece

    for d in range(len(lengths) - 1, -1, -1):
        n = lengths[d]
        whole = n - n % longest
        windows.extend([(d, s, longest)] for s in range(0, whole, longest))
        if n > whole:
            put((d, whole, n - whole))
    while filled:
        n = filled.bit_length() - 1
        window, gap = [take(n)], tiers[bisect_left(tiers, n)] - n
        while gap:
            fits = filled & ((1 << (gap + 1)) - 1)
            if fits:
                window.append(take(fits.bit_length() - 1))
                gap -= window[-1][2]
            elif filled:
                m = (filled & -filled).bit_length() - 1  # the shortest piece, longer than the gap
                d, s, m = take(m)
                window.append((d, s, gap))
                put((d, s + gap, m - gap))
                gap = 0
            else:
                break
        if gap:
            windows.extend(_powers(window))
        else:
            windows.append(window)
    return windows


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces end to end, cut into windows whose sizes are the powers of two of their sum."""
    left, out = sum(p[2] for p in pieces), []
    todo = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        window = []
        while size:
            d, s, n = todo.pop()
            window.append((d, s, min(n, size)))
            if n > size:
                todo.append((d, s + size, n - size))
            size -= window[-1][2]
        out.append(window)
    return out


class StepGroups:
    """Windows dealt to groups of exactly `tokens` each, but for those still open at the end."""

    def __init__(self, first: int, tokens: int):
        self.next, self.tokens = first, tokens
        self.room: dict[int, int] = {}  # of open groups: a few, as whatever fits one fills it

    def place(self, n: int) -> int:
        fits = [(room, group) for group, room in self.room.items() if room >= n]
        if fits:
            _, group = min(fits)
        else:
            group, self.next = self.next, self.next + 1
            self.room[group] = self.tokens
        self.room[group] -= n
        if not self.room[group]:
            del self.room[group]
        return group


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of each document of docs (doc_id, text)."""
    tokenizer_path = tokenizer_path or tokens.default_tokenizer()
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers) or step_tokens % tiers[-1]:
        raise ValueError("tiers must be rising powers of two, step_tokens a multiple of the longest")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        high = TaskContext.get().partitionId() << 33
        sequence, groups = high, StepGroups(high, step_tokens)
        doc_ids: list[int | None] = []
        coded: list[bytes] = []

        def pool() -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(9)]
            for window in sorted(pack_pool([len(c) // 4 for c in coded], tiers), key=lambda w: -sum(p[2] for p in w)):
                at, total = 0, sum(p[2] for p in window)
                group = groups.place(total)
                for d, s, n in window:
                    for column, value in zip(out, (doc_ids[d], s, n, zlib.crc32(memoryview(coded[d])[4 * s : 4 * (s + n)]), len(coded[d]) // 4, sequence, at, total, group)):
                        column.append(value)
                    at += n
                sequence += 1
            doc_ids.clear()
            coded.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [f.split()[0] for f in SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                got = encoder.encode(piece.column(1))
                doc_ids.extend(piece.column(0).to_pylist())
                coded.extend(got)
                size += sum(map(len, got)) // 4
                if size >= pool_tokens:
                    yield pool()
                    size = 0
        if coded:
            yield pool()

    return shared.columns(docs, "doc_id", "text").mapInArrow(packed, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))
