"""Repeated word windows: a count-min prefilter, then exact groups of the windows that it estimates repeated.

Pass 1, the sketch: DEPTH rows of counters, each row in stripes (buckets) of WIDTH counters, of which there is one for
each bucket of text. Every chunk of documents counts its windows in all rows; of its sketch it sends the counters above
zero. A bucket adds the sketches of all chunks, counter by counter, in one array of WIDTH, and answers a bit for each
counter that was sent: whether its total is 2 or more. A window is estimated repeated if it is so in every row. Totals
only overestimate: hash collisions add candidates, and no repeated window is lost. One more row counts anchors (below).

Pass 2, exact groups: chunks send the words of windows estimated repeated, each different one of a chunk once with its
first place there. Windows in a row travel together as a span as long as they share an anchor, the least hashed ANCHOR
words inside; equal windows have equal anchors and so meet in one bucket. Windows of anchors that the sketch finds in
more than HOT places travel one by one, to the bucket of their own hash. A bucket numbers its words and compares windows
word for word, a block of whole anchors after another, and answers for each whether it is at the first place of all.
Pass 3: a place is repeated unless it is the first of all, and the words it covers go.

However often a window occurs, a chunk sends it once; a chunk and a bucket are bounded in size. Hashes route and sketch
only: windows count as equal by their bytes.

Defined results: words are the runs of bytes other than blank and tab to carriage return; null texts have none;
places are ordered by (doc_id, start), null doc_ids last; rows of one doc_id are not earlier than each other at the
same start (a wholly repeated row keeps what the first keeps); an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from latticebits.llm import chunks, hashing, shared
from latticebits.llm.hashing import runs

SIZE, ANCHOR = 20, 8
#: Rows of the sketch and counters of each row for a bucket: about six for each of its windows.
DEPTH, WIDTH = 2, 1 << 23
#: Places of an anchor beyond which its windows travel one by one.
HOT = 2048
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_BLOCK_WINDOWS = 1 << 17
_SLICE = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Where words begin and end, the number of each (the same for the same bytes only), and the different words."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begins, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
    return begins, ends, each.indices.to_numpy(), each.dictionary


def _stripe(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


class _Windows:
    """The windows of a chunk: the numbers of their words, hashes, anchors and places."""

    def __init__(self, chunk: chunks.Chunk, size: int):
        self.begins, self.ends, self.word, different = words_of(chunk.data)
        self.doc = np.searchsorted(chunk.ends, self.begins, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(chunk.ends))
        self.at = np.flatnonzero(self.doc[size - 1 :] == self.doc[: max(0, len(self.doc) - size + 1)]) if len(self.begins) >= size else np.zeros(0, np.int64)
        h = hashing.of_words(different)[self.word] if len(self.word) else np.zeros(0, np.uint64)
        self.hash = hashing.of_runs(h, size)[self.at]
        grams, reach = hashing.of_runs(h, min(ANCHOR, size)), size - min(ANCHOR, size) + 1
        anchor = np.zeros(len(self.at), np.int64)
        for lo in range(0, len(grams), _SLICE):
            i, j = np.searchsorted(self.at, [lo, lo + _SLICE])
            anchor[i:j] = lo + hashing.least_of(grams[lo : lo + _SLICE + reach - 1], reach)[self.at[i:j] - lo]
        self.anchor, self.key = anchor, hashing.mix(grams[anchor] + hashing.GOLDEN) if len(anchor) else np.zeros(0, np.uint64)
        # places, as pairs that sort like (doc_id, start)
        self.order = chunk.order[self.doc[self.at]]
        self.start = (self.at - (np.cumsum(self.n_words) - self.n_words)[self.doc[self.at]]).astype(np.uint32)


def bit_answers(n_each: list[int], bits: np.ndarray) -> list[bytes]:
    cut = np.cumsum([0, *n_each])
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]


def bits_of(answers: dict[int, bytes], counts: dict[int, int]) -> np.ndarray:
    """The bits of a chunk's entries, bucket after bucket; an answer must be there for every question."""
    if counts.keys() != answers.keys():
        raise RuntimeError("a chunk misses answers")
    return np.concatenate([np.unpackbits(np.frombuffer(answers[b], np.uint8), count=n).astype(bool) for b, n in sorted(counts.items())] or [np.zeros(0, bool)])


def counts_of(bucket_of: np.ndarray) -> dict[int, int]:
    b, n = np.unique(bucket_of, return_counts=True)
    return dict(zip(b.tolist(), n.tolist()))


# ---- pass 1: the sketch


class _Row:
    """One row of a chunk's sketch: its counters above zero, sorted by stripe and place, and which entry is in which."""

    def __init__(self, h: np.ndarray, row: int, n_buckets: int, width: int):
        stripe = _stripe(h, n_buckets) + np.uint64(row * n_buckets)
        cell = (stripe << np.uint64(32)) | (h & _LOW) % np.uint64(width)
        by = np.argsort(cell)
        new = runs(cell[by])
        first = np.flatnonzero(new)
        self.cells, self.count = cell[by][first], np.minimum(np.diff(first, append=len(by)), 255).astype(np.uint8)
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1


def _rows(w: _Windows, n_buckets: int, depth: int, width: int) -> list[_Row]:
    """The rows of windows, then the row of anchors, counted once for every run of windows that shares one."""
    lead = np.flatnonzero(runs(w.anchor))
    hashes = [hashing.mix(w.hash ^ hashing.mix(np.full(1, k + 1, np.uint64))) for k in range(depth)] + [w.key[lead]]
    return [_Row(h, k, n_buckets, width) for k, h in enumerate(hashes)]


def sketch_messages(rows: list[_Row], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    for row in rows:
        for b, run in chunks.by_bucket(row.cells >> np.uint64(32), len(rows) * n_buckets):
            own = (row.cells[run] & _LOW).astype(np.uint32)
            yield b, np.uint32(len(own)).tobytes() + chunks.planes(np.diff(own, prepend=np.uint32(0)).astype(np.uint32)) + row.count[run].tobytes()


def merged_sketches(packed: list[bytes], width: int, enough: int) -> list[bytes]:
    """For each counter that was sent a bit: the sum of this counter over all sketches is `enough`."""
    total, cells = np.zeros(width, np.uint32), []
    for p in packed:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        cells.append(np.cumsum(chunks.from_planes(memoryview(p)[4 : 4 + 4 * n], np.uint32), dtype=np.uint32))
        total[cells[-1]] += np.frombuffer(p, np.uint8, n, 4 + 4 * n)
    return [np.packbits(total[c] >= enough).tobytes() for c in cells]


def _estimates(w: _Windows, rows: list[_Row], answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: whether it is estimated repeated, whether its anchor is hot."""
    bits = bits_of(answers, counts_of(np.concatenate([r.cells for r in rows]) >> np.uint64(32)))
    cut = np.cumsum([0, *(len(r.cells) for r in rows)])
    each = [bits[a:b][r.of] for a, b, r in zip(cut[:-1], cut[1:], rows)]
    return np.logical_and.reduce(each[:-1]), each[-1][np.cumsum(runs(w.anchor)) - 1] if len(w.at) else np.zeros(0, bool)


# ---- pass 2: exact groups


class _Candidates:
    """Windows estimated repeated; the first place in the chunk of each different one; these as spans by bucket."""

    def __init__(self, w: _Windows, repeated: np.ndarray, hot: np.ndarray, size: int, n_buckets: int):
        self.own = np.flatnonzero(repeated)
        self.group = hashing.numbered_rows(w.word[w.at[self.own][:, None] + np.arange(size)])
        by = np.lexsort((w.start[self.own], w.order[self.own], self.group))
        self.lead = self.own[by[runs(self.group[by])]]  # by group number
        # spans: leads next to each other under one anchor that isn't hot
        i = np.sort(self.lead)
        new = np.ones(len(i), bool)
        if len(i):
            same = (w.at[i[1:]] == w.at[i[:-1]] + 1) & (w.anchor[i[1:]] == w.anchor[i[:-1]]) & (w.doc[w.at[i[1:]]] == w.doc[w.at[i[:-1]]])
            new[1:] = ~same | hot[i[1:]]
        first = np.flatnonzero(new)
        key = np.where(hot[i[first]], w.hash[i[first]], w.key[i[first]])
        order = np.lexsort((first, key, _stripe(key, n_buckets)))
        self.first, self.count, self.key = i[first][order], np.diff(first, append=len(i))[order], key[order]
        self.bucket = _stripe(self.key, n_buckets)

    def windows(self) -> np.ndarray:
        """The leads, span after span."""
        return np.repeat(self.first - (np.cumsum(self.count) - self.count), self.count) + np.arange(self.count.sum())


def gather(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return data[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


_SPAN = ((np.uint64, 8), (np.int64, 8), (np.uint32, 4), (np.uint16, 2))


def _span_messages(c: _Candidates, w: _Windows, chunk: chunks.Chunk, size: int, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    for b, run in chunks.by_bucket(c.bucket, n_buckets):
        i, n = c.first[run], c.count[run]
        begin, end = w.begins[w.at[i]], w.ends[w.at[i] + n + size - 2]
        text = gather(chunk.data, begin, end - begin + 1)
        text[np.cumsum(end - begin + 1) - 1] = 32
        columns = (c.key[run], w.order[i], w.start[i], n)
        yield b, np.uint32(len(i)).tobytes() + b"".join(chunks.planes(x.astype(t)) for x, (t, _) in zip(columns, _SPAN)) + text.tobytes()


def _first_places(packed: list[bytes], size: int) -> list[bytes]:
    """For each window of each span of each chunk a bit: no other place of the same words is earlier."""
    columns: list[list[np.ndarray]] = [[] for _ in _SPAN]
    texts, sizes = [], []
    for p in packed:
        n, at = int(np.frombuffer(p, np.uint32, 1)[0]), 4
        for column, (t, width) in zip(columns, _SPAN):
            column.append(chunks.from_planes(memoryview(p)[at : at + width * n], t))
            at += width * n
        texts.append(np.frombuffer(p, np.uint8, offset=at))
        sizes.append(int(columns[3][-1].sum(dtype=np.int64)))
    key, order, start, count = (np.concatenate(c) for c in columns)
    count = count.astype(np.int64)
    _, _, word, _ = words_of(np.concatenate(texts))
    word_at = np.cumsum(count + size - 1) - (count + size - 1)  # the first word of each span
    out_at = np.cumsum(count) - count
    is_first = np.empty(count.sum(), bool)
    by = np.argsort(key, kind="stable")
    whole = np.cumsum(count[by])
    edges = np.flatnonzero(runs(key[by]))
    block = (whole[edges] // _BLOCK_WINDOWS)[np.searchsorted(edges, np.arange(len(by)), side="right") - 1]
    cut = [*np.flatnonzero(runs(block)).tolist(), len(by)]
    for lo, hi in zip(cut[:-1], cut[1:]):
        span = by[lo:hi]
        within = np.arange(count[span].sum()) - np.repeat(np.cumsum(count[span]) - count[span], count[span])
        spread = lambda x: np.repeat(x[span], count[span])
        group = hashing.numbered_rows(word[(spread(word_at) + within)[:, None] + np.arange(size)])
        o, s = spread(order), spread(start) + within
        sort = np.lexsort((s, o, group))
        lead = sort[runs(group[sort])][group]
        is_first[spread(out_at) + within] = (o == o[lead]) & (s == s[lead])
    return bit_answers(sizes, is_first)


def remove_repeated(docs: DataFrame, size: int = SIZE, *, with_text: bool = False, depth: int = DEPTH, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """RESULT for each row of docs (doc_id, text); with_text adds `kept`, the words left, joined by a blank."""
    with shared.scratch(docs.sparkSession):
        corpus = chunks.stage(docs)
        n_buckets = corpus.n_buckets

        def ask_counts(chunk: chunks.Chunk) -> Iterator[tuple[int, bytes]]:
            yield from sketch_messages(_rows(_Windows(chunk, size), n_buckets, depth, width), n_buckets)

        def add(bucket: int, packed: list[bytes]) -> list[bytes]:
            return merged_sketches(packed, width, 2 if bucket < depth * n_buckets else hot + 1)

        counted = chunks.Answers(corpus.ask(ask_counts, add, "window-counts"))

        def candidates(chunk: chunks.Chunk) -> tuple[_Windows, _Candidates]:
            w = _Windows(chunk, size)
            repeated, hot_anchor = _estimates(w, _rows(w, n_buckets, depth, width), counted.of(chunk.id))
            return w, _Candidates(w, repeated, hot_anchor, size, n_buckets)

        def ask_first(chunk: chunks.Chunk) -> Iterator[tuple[int, bytes]]:
            w, c = candidates(chunk)
            yield from _span_messages(c, w, chunk, size, n_buckets)

        firsts = chunks.Answers(corpus.ask(ask_first, lambda _, packed: _first_places(packed, size), "window-firsts"))

        def apply(chunk: chunks.Chunk) -> Iterator[pa.RecordBatch]:
            w, c = candidates(chunk)
            windows_in = dict.fromkeys(np.unique(c.bucket).tolist(), 0)
            for b, n in zip(c.bucket.tolist(), c.count.tolist()):
                windows_in[b] += n
            first = np.zeros(len(w.at), bool)
            first[c.windows()] = bits_of(firsts.of(chunk.id), windows_in)
            lead = c.lead[c.group]
            kept = first[lead] & (w.order[c.own] == w.order[lead]) & (w.start[c.own] == w.start[lead])
            gone = w.at[c.own[~kept]]
            n = len(w.doc)
            cover = np.cumsum(np.bincount(gone, minlength=n + size + 1)[: n + 1] - np.bincount(gone + size, minlength=n + size + 1)[: n + 1])[:n] > 0
            removed = np.bincount(w.doc[cover], minlength=len(chunk.ends))
            raw = chunk.data.tobytes()
            upto = np.cumsum(w.n_words)
            shas, texts = [], []
            for d, (a, b) in enumerate(zip(chunk.begins.tolist(), chunk.ends.tolist())):
                words = raw[a:b].split()
                if removed[d]:
                    words = compress(words, (~cover[upto[d] - w.n_words[d] : upto[d]]).tolist())
                text = b" ".join(words)
                shas.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            columns = [chunk.ids, pa.array(w.n_words), pa.array(removed), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names + ["kept"] * with_text)

        with chunks.small_batches(corpus.spark):
            return shared.written(corpus.scan(apply, RESULT + (", kept string" if with_text else "")), "window-result", result=True)


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(shared.documents(spark, sf_dir))


#: For small tables: SQL has no way around all windows or pairs.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, s, w[s:s + 19] AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
m AS (SELECT *, min((coalesce(doc_id, 9223372036854775807), s)) OVER (PARTITION BY g) AS first FROM p),
c AS (SELECT rid, list_sort(list_distinct(flatten(list(range(s, s + 20))))) AS gone FROM m WHERE (coalesce(doc_id, 9223372036854775807), s) > first GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_where(w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN c USING (rid)
"""
