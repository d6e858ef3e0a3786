"""Substring deduplication by suffix sorting with a difference cover, one suffix bucket at a time.

A byte goes if a string of SIZE bytes over it also starts in a document with a smaller doc_id.

Every start belongs to an anchor: the least hashed K bytes inside its SIZE bytes, which equal strings share. Starts
with one anchor in a row form a span. Pass 1 counts anchors over all chunks of documents and marks those of two or
more documents; starts of others cannot repeat. Pass 2 sends marked spans, equal ones of a chunk once with their least
doc_id, to the bucket of their anchor. A bucket sorts the suffixes of its spans, one block of anchors after another:
by their first BLOCKS words of 8 bytes, and where suffixes tie for longer than the cover's period, by the ranks of
sample suffixes: positions whose index modulo PERIOD is in a difference cover are sorted beforehand, and any two
positions have one distance below PERIOD at which both are samples. Neighbours in that order which share SIZE bytes
get the least doc_id among them, and the bucket answers each span with a bit per start: an earlier document has it.
Pass 3 removes what the bits cover. Memory is bounded by a chunk and a bucket block.

Anchors of more than HOT spans, those at the edges of a passage that very many documents hold, are not kept together:
their starts travel one by one, to the bucket of their own bytes.

Defined results: null texts are empty; null doc_ids count as later than all others, and rows of equal (or null) ids
don't remove from each other; matches end at documents; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from latticebits.llm import chunks, hashing, shared
from latticebits.llm.hashing import runs
from latticebits.llm.windows import counts_of, gather

SIZE, K = 50, 16
HOT = 2048
#: A perfect difference cover: every residue is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCKS = 4
_BLOCK_BYTES = 1 << 20
_SLICE = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _shifts() -> np.ndarray:
    """For residues i and j the least d with i+d and j+d both in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


_SHIFT = _shifts()


def _refined(rank: np.ndarray, key: np.ndarray, tied: np.ndarray) -> None:
    """Split the groups of rank (each the place of its first member) by key, in place, for its members `tied`."""
    order = np.lexsort((key, rank[tied]))
    r, k = rank[tied][order], key[order]
    group = runs(r)
    fresh = group.copy()
    fresh[1:] |= k[1:] != k[:-1]
    place = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(group, place, 0))
    sub = np.maximum.accumulate(np.where(fresh, place, 0))
    rank[tied[order]] = r + sub - begin


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _sorted_by_words(word: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Ranks of positions by their first `words` words of 8 bytes; equal ones share the place of the first."""
    rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(words):
        _refined(rank, word[at[tied] + 8 * k], tied)
        tied = _tied(rank)
        if not len(tied):
            break
    return rank


def equal_starts(text: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A number for each start in a text of bytes, equal for starts of equal `size` bytes and rising in suffix order."""
    if not len(starts):
        return np.zeros(0, np.int64)
    depth = -(-size // 8) * 8
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + PERIOD + 8 * BLOCKS + 8, np.uint8)])
    word = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : len(padded) - 7 + j]
    rank = _sorted_by_words(word, starts, BLOCKS)
    todo = _tied(rank)
    if len(todo):
        samples = np.concatenate([np.arange(c, n + PERIOD, PERIOD) for c in COVER])
        sample_rank = np.zeros(n + 2 * PERIOD, np.int64)
        sample_rank[samples] = _sorted_by_words(word, samples, depth // 8)
    while len(todo):
        # each tied group in three by its first member: the difference cover decides without reading on
        todo = todo[np.argsort(rank[todo], kind="stable")]
        group = runs(rank[todo])
        lead = starts[todo[np.flatnonzero(group)]][np.cumsum(group) - 1]
        own = starts[todo]
        shift = _SHIFT[own % PERIOD, lead % PERIOD]
        side = np.sign(sample_rank[own + shift] - sample_rank[lead + shift])
        _refined(rank, side, todo)
        todo = todo[side != 0]
        if len(todo):
            todo = todo[np.bincount(rank[todo], minlength=len(rank))[rank[todo]] > 1]
    order = np.argsort(rank, kind="stable")
    a, b = starts[order[1:]], starts[order[:-1]]
    same = np.ones(len(a), bool)
    for k in [*range(0, size - 7, 8), size - 8]:
        same &= word[a + k] == word[b + k]
    out = np.empty(len(starts), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)])
    return out


# ---- spans of a chunk


class _Spans:
    """Spans of a chunk: first start, number of starts, key (the anchor's hash), document."""

    def __init__(self, chunk: chunks.Chunk):
        data, n = chunk.data, len(chunk.data)
        stop = np.repeat(chunk.ends.astype(np.int32), chunk.ends + 1 - chunk.begins)
        first, count, key = [], [], []
        for lo in range(0, max(0, n - SIZE + 1), _SLICE):
            grams = gram_hashes(data[lo : lo + _SLICE + SIZE - 1])
            anchor = hashing.least_of(grams, SIZE - K + 1)
            at = np.arange(lo, lo + len(anchor))
            good = at + SIZE <= stop[lo : lo + len(anchor)]
            new = good.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1]
            begin = np.flatnonzero(new)
            upto = np.cumsum(good)
            total = upto[-1] if len(upto) else 0
            before = upto[begin] - 1
            first.append(begin + lo)
            count.append(np.diff(before, append=total))
            key.append(grams[anchor[begin]])  # a minimum: small, so mixed anew below
        empty = np.zeros(0, np.int64)
        self.first, self.count = np.concatenate([empty, *first]), np.concatenate([empty, *count])
        self.key = hashing.mix(np.concatenate([empty.astype(np.uint64), *key]) + hashing.GOLDEN)
        self.order = chunk.order[np.searchsorted(chunk.ends, self.first, side="right")] if len(self.first) else empty

    def take(self, i: np.ndarray) -> _Spans:
        out = object.__new__(_Spans)
        out.first, out.count, out.key, out.order = self.first[i], self.count[i], self.key[i], self.order[i]
        return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K = 16 bytes from each position on that has as many: two words of 8 bytes, mixed."""
    if len(data) < K:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    return hashing.mix(hashing.mix(eight[:-8]) * hashing.GOLDEN + eight[8:])


def start_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the SIZE bytes at each of these places."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, SIZE - 7, 8), SIZE - 8]:
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word |= data[at + k + j].astype(np.uint64) << np.uint64(8 * j)
        out = hashing.mix(out * hashing.GOLDEN + word)
    return out


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def _anchor_cells(s: _Spans, n_buckets: int) -> tuple[np.ndarray, ...]:
    """Spans sorted by cell (bucket, low half of the key), where cells begin, the cells, spans in each (255 at most), whether of several documents."""
    cell = (_bucket(s.key, n_buckets) << np.uint64(32)) | (s.key & _LOW)
    by = np.argsort(cell)
    sorted_cells, order = cell[by], s.order[by]
    first = np.flatnonzero(runs(sorted_cells))
    if not len(first):
        return by, first, sorted_cells, np.zeros(0, np.uint8), np.zeros(0, bool)
    several = np.minimum.reduceat(order, first) != np.maximum.reduceat(order, first)
    return by, first, sorted_cells[first], np.minimum(np.diff(first, append=len(by)), 255).astype(np.uint8), several


def _marked(packed: list[bytes], hot_spans: int = HOT) -> list[bytes]:
    """For each cell of each chunk: 1 if it is of several documents, 2 more if hot."""
    cells, counts, several, sizes = [], [], [], []
    for p in packed:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        cells.append(np.cumsum(chunks.from_planes(memoryview(p)[4 : 4 + 4 * n], np.uint32), dtype=np.uint32))
        counts.append(np.frombuffer(p, np.uint8, n, 4 + 4 * n))
        several.append(np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + 5 * n), count=n))
        sizes.append(n)
    cell = np.concatenate(cells)
    by = np.argsort(cell)
    new = runs(cell[by])
    begin = np.flatnonzero(new)
    shared_by = (np.diff(begin, append=len(by)) > 1) | (np.maximum.reduceat(np.concatenate(several)[by], begin) > 0)
    hot = np.add.reduceat(np.concatenate(counts)[by].astype(np.int64), begin) > hot_spans
    mark = np.empty(len(cell), np.uint8)
    mark[by] = (shared_by + 2 * (shared_by & hot)).astype(np.uint8)[np.cumsum(new) - 1]
    cut = np.cumsum([0, *sizes])
    return [mark[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]


def _candidates(chunk: chunks.Chunk, marks: chunks.Answers, n_buckets: int) -> tuple[_Spans, np.ndarray, np.ndarray]:
    """Spans whose anchors are marked, sorted by key and bytes; where different ones begin; of each the least doc_id."""
    s = _Spans(chunk)
    by, first, cells, _, _ = _anchor_cells(s, n_buckets)
    expected, got = counts_of(cells >> np.uint64(32)), marks.of(chunk.id)
    if expected.keys() != got.keys():
        raise RuntimeError("a chunk misses answers")
    mark = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.uint8)
    each = np.empty(len(by), np.uint8)
    each[by] = np.repeat(mark, np.diff(first, append=len(by)))
    own, hot = s.take(np.flatnonzero(each == 1)), s.take(np.flatnonzero(each == 3))
    # starts of hot anchors one by one, under the hash of their own bytes
    first_of = np.repeat(hot.first, hot.count) + (np.arange(hot.count.sum()) - np.repeat(np.cumsum(hot.count) - hot.count, hot.count))
    own.first, own.count, own.order = np.concatenate([own.first, first_of]), np.concatenate([own.count, np.ones(len(first_of), np.int64)]), np.concatenate([own.order, np.repeat(hot.order, hot.count)])
    # spans of the same bytes, and so of one key, are one group; bytes are compared, not hashes
    length = own.count + SIZE - 1
    group = hashing.numbered(gather(chunk.data, own.first, length), np.cumsum(length))
    own.key = np.concatenate([own.key, start_hashes(chunk.data, own.first[len(own.key) :])])
    sort = np.lexsort((group, own.key))
    own, group = own.take(sort), group[sort]
    new = runs(group)
    least = np.minimum.reduceat(own.order, np.flatnonzero(new)) if len(sort) else own.order
    return own, new, least


def _earlier(packed: list[bytes]) -> list[bytes]:
    """For each span of each chunk 64 bits: which of its starts an earlier document than the span's has."""
    keys, orders, counts, texts, sizes = [], [], [], [], []
    for p in packed:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        keys.append(chunks.from_planes(memoryview(p)[4 : 4 + 8 * n], np.uint64))
        orders.append(chunks.from_planes(memoryview(p)[4 + 8 * n : 4 + 16 * n], np.int64))
        counts.append(np.frombuffer(p, np.uint8, n, 4 + 16 * n))
        texts.append(np.frombuffer(p, np.uint8, offset=4 + 17 * n))
        sizes.append(n)
    key, order, count = np.concatenate(keys), np.concatenate(orders), np.concatenate(counts).astype(np.int64)
    text = np.concatenate(texts)
    length = count + SIZE - 1
    begin = np.cumsum(length) - length
    group = hashing.numbered(text, np.cumsum(length))
    by = np.lexsort((order, group, key))
    new = runs(group[by])
    lead = by[new]  # of each different span the one of the least document
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    # the least document of each start of each different span, at first its own
    n_starts, least = count[lead], np.repeat(order[lead], count[lead])
    start_at = np.cumsum(n_starts) - n_starts
    anchor = runs(key[lead])
    crowd = np.diff(np.flatnonzero(anchor), append=len(lead))
    alone = np.repeat(crowd == 1, crowd)
    todo = np.flatnonzero(~alone)  # spans that share their anchor with others
    if len(todo):
        size = np.cumsum(length[lead[todo]])
        # blocks of whole anchors of about _BLOCK_BYTES
        edges = np.flatnonzero(runs(key[lead[todo]]))
        block = np.searchsorted(edges, np.arange(len(todo)), side="right") - 1
        block = (size[edges] // _BLOCK_BYTES)[block]
        for lo, hi in zip(np.flatnonzero(runs(block)), [*np.flatnonzero(runs(block))[1:], len(todo)]):
            part = todo[lo:hi]
            spans = lead[part]
            own = gather(text, begin[spans], length[spans])
            starts_in = np.cumsum(length[spans]) - length[spans]
            within = np.arange(n_starts[part].sum()) - np.repeat(np.cumsum(n_starts[part]) - n_starts[part], n_starts[part])
            starts = np.repeat(starts_in, n_starts[part]) + within
            same = equal_starts(own, starts)
            where = np.repeat(start_at[part], n_starts[part]) + within
            best = np.full(same.max() + 1, chunks.LAST)
            np.minimum.at(best, same, least[where])
            least[where] = best[same]
    # bits of every sent span
    total = count.sum()
    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    earlier = least[np.repeat(start_at[of], count) + within] < np.repeat(order, count)
    bits = np.bitwise_or.reduceat(earlier.astype(np.uint64) << within.astype(np.uint64), np.cumsum(count) - count)
    cut = np.cumsum([0, *sizes])
    return [chunks.planes(bits[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def remove_repeated(docs: DataFrame, *, with_text: bool = False, hot_spans: int = HOT) -> DataFrame:
    """RESULT for each row of docs (doc_id, text); with_text adds `kept`, the bytes left."""
    with shared.scratch(docs.sparkSession):
        corpus = chunks.stage(docs)
        n_buckets = corpus.n_buckets

        def ask_marks(chunk: chunks.Chunk) -> Iterator[tuple[int, bytes]]:
            _, _, cells, counts, several = _anchor_cells(_Spans(chunk), n_buckets)
            for b, run in chunks.by_bucket(cells >> np.uint64(32), n_buckets):
                own = (cells[run] & _LOW).astype(np.uint32)
                yield b, np.uint32(len(own)).tobytes() + chunks.planes(np.diff(own, prepend=np.uint32(0)).astype(np.uint32)) + counts[run].tobytes() + np.packbits(several[run]).tobytes()

        marks = chunks.Answers(corpus.ask(ask_marks, lambda _, packed: _marked(packed, hot_spans), "suffix-anchors"))

        def ask_spans(chunk: chunks.Chunk) -> Iterator[tuple[int, bytes]]:
            own, new, least = _candidates(chunk, marks, n_buckets)
            lead = own.take(np.flatnonzero(new))
            for b, run in chunks.by_bucket(_bucket(lead.key, n_buckets), n_buckets):
                count = lead.count[run]
                yield b, np.uint32(len(count)).tobytes() + chunks.planes(lead.key[run]) + chunks.planes(least[run]) + count.astype(np.uint8).tobytes() + gather(chunk.data, lead.first[run], count + SIZE - 1).tobytes()

        earlier = chunks.Answers(corpus.ask(ask_spans, lambda _, packed: _earlier(packed), "suffix-starts"))

        def apply(chunk: chunks.Chunk) -> Iterator[pa.RecordBatch]:
            own, new, least = _candidates(chunk, marks, n_buckets)
            got = earlier.of(chunk.id)
            if counts_of(_bucket(own.key[new], n_buckets)).keys() != got.keys():
                raise RuntimeError("a chunk misses answers")
            bits = np.concatenate([np.zeros(0, np.uint64), *(chunks.from_planes(got[b], np.uint64) for b in sorted(got))])
            group = np.cumsum(new) - 1
            later = own.order > least[group]
            within = np.arange(own.count.sum()) - np.repeat(np.cumsum(own.count) - own.count, own.count)
            gone = np.repeat(later, own.count) | ((np.repeat(bits[group], own.count) >> within.astype(np.uint64)) & np.uint64(1)).astype(bool)
            at = (np.repeat(own.first, own.count) + within)[gone]
            n = len(chunk.data)
            cover = np.cumsum(np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + SIZE, minlength=n + 1)[: n + 1])[:n] > 0
            upto = np.concatenate([[0], np.cumsum(cover)])
            opened = np.concatenate([[0], np.cumsum(cover & ~np.concatenate([[False], cover[:-1]]))])
            removed, spans = upto[chunk.ends] - upto[chunk.begins], opened[chunk.ends] - opened[chunk.begins]
            shas, texts = [], []
            for d, (a, b) in enumerate(zip(chunk.begins.tolist(), chunk.ends.tolist())):
                kept = (chunk.data[a:b][~cover[a:b]] if removed[d] else chunk.data[a:b]).tobytes()
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
            columns = [chunk.ids, pa.array(chunk.ends - chunk.begins), pa.array(removed), pa.array(spans), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.binary())] if with_text else []), names + ["kept"] * with_text)

        with chunks.small_batches(corpus.spark):
            return shared.written(corpus.scan(apply, RESULT + (", kept binary" if with_text else "")), "suffix-result", result=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(shared.documents(spark, sf_dir))


#: For small tables: SQL has no way around all windows or pairs.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS doc_id, i, substring(h, 2 * i + 1, 100) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS MATERIALIZED (SELECT DISTINCT rid, i FROM p JOIN f USING (g) WHERE doc_id > least),
b AS (SELECT rid, i, CASE WHEN i - lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) > 50 THEN 1 ELSE 0 END AS opens FROM x),
k AS (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS k FROM b),
runs AS MATERIALIZED (SELECT rid, k, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY rid, k),
t AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, list((a, z) ORDER BY a) AS spans FROM runs GROUP BY rid),
kept AS (SELECT d.rid, string_agg(substring(h, 2 * z0 + 1, 2 * (a - z0)), '' ORDER BY a) AS h FROM d JOIN
  (SELECT rid, a, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS z0 FROM (SELECT rid, a, z FROM runs UNION ALL SELECT rid, len(h) // 2, NULL FROM d)) q ON d.rid = q.rid GROUP BY d.rid)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN t USING (rid)
"""
