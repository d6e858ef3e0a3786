"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The byte-pair encoding of a prefix is the encoding of a shorter prefix and one last token: the one token that ends there
and stands behind the shorter prefix's own last token as a pair that the merges leave alone. So one pass over a word
gives its counts at all places, with a table of token ends, a table of pairs (both held against the library's merges) and
the last token at each place; no prefix is encoded anew. Words are the tokenizer's pre-tokens, found with arrays of
character classes (asked of the library, a page of characters at a time), and a worker keeps the counts of the words it
has seen, keyed by the words themselves. The counts of a text add up those of its words. Three places differ in a prefix
from the whole text and are counted as the prefix has them: behind a run of white space (one word there), inside a
contraction, and inside the special string (plain text until it is whole).

A text's counts are stored as blocks of BLOCK prefixes, a base of 8 bytes and offsets of 2 each, so that `count_at`
reads the count of any prefix with plain column functions, and `truncated` finds the longest prefix within a limit; both
need no tokenizer. Prefixes are counted in code points; the empty prefix has no tokens.

Long texts are gone through in pieces of about PIECE characters, cut where a single blank stands between words.

Defined results: null text counts as empty; null doc_ids stay null; repeated rows count each; bytes that are no UTF-8
are read as U+FFFD (n_bytes counts them as stored); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import chunks, memory, shared, tokens

LIMIT = 1024
BLOCK = 256
PIECE = 1 << 19
_PAGE = 4096
_PAIRS = 1_000_000
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
#: What the tokenizer splits off behind a word as one pre-token.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_CUT = re.compile(r"(?<=[0-9A-Za-z.,;]) (?=[0-9A-Za-z])")
SCHEMA = "doc_id long, n_bytes long, n_chars long, counts binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """Counts at the prefixes of single pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.space = self.bytes.pre_tokenize_str(" ")[0][0]  # other printable ASCII stands for itself
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        own = {text: t for text, t in self.tokenizer.get_vocab(with_added_tokens=False).items() if [x.id for x in self.merge(text)] == [t]}
        #: Every end of a token, with the token that it is (-1 for none that merges can give).
        self.ends = {text[k:]: -1 for text in own for k in range(len(text))} | own
        self.text = {t: text for text, t in own.items()}
        self.pairs: dict[int, bool] = {}
        self.latest: tuple[str, list[int], list[int]] = ("", [0], [-1])
        self.classes, self.pages = np.zeros(0x110000, np.uint8), np.zeros(0x110000 // _PAGE, bool)

    def _stands(self, first: int, second: int) -> bool:
        """Whether merges leave these two tokens alone; answers are kept."""
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        answer = self.pairs[first << 32 | second] = [t.id for t in self.merge(self.text[first] + self.text[second])] == [first, second]
        return answer

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ..., word as pre-tokens of their own."""
        if word in CONTRACTIONS and len(word) > 2:
            return [self.counts(word[0])[0], self.counts(word[0])[0] + self.counts(word[1])[0], self._of(word)[-1]]
        return self._of(word)

    def _of(self, word: str) -> list[int]:
        coded = word.replace(" ", self.space) if word.isascii() and word.isprintable() else self.bytes.pre_tokenize_str(word)[0][0]
        n, ends, known = len(coded), self.ends.get, self.pairs.get
        before, count, last = self.latest
        same = 0
        for x, y in zip(before, coded):
            if x != y:
                break
            same += 1
        del count[same + 1 :], last[same + 1 :]  # what the word before begins with alike needn't be gone through again
        self.latest = coded, count, last
        for i in range(same + 1, n + 1):
            at, t = i - 1, None
            while at >= 0 and (t := ends(coded[at:i])) is not None:
                if t >= 0:
                    if not at:
                        break
                    stands = known(last[at] << 32 | t)
                    if stands or stands is None and self._stands(last[at], t):
                        break
                at -= 1
            if at < 0 or t is None:
                self.latest = "", [0], [-1]
                raise ValueError(f"no token ends at byte {i} of {word!r}")
            count.append(count[at] + 1)
            last.append(t)
        if n == len(word):
            return count[1:]
        out, at = [], 0
        for c in word:
            at += 1 + (c >= "\x80") + (c >= "\u0800") + (c >= "\U00010000")
            out.append(count[at])
        return out

    def _learn(self, page: int) -> None:
        """Classes of a page of characters: which of a letter, a number and another character each joins."""
        chars = [c for c in range(page * _PAGE, (page + 1) * _PAGE) if not 0xD800 <= c < 0xE000]
        kinds = np.full(len(chars), _BLANK, np.uint8)
        for kind, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
            begins = np.zeros(3 * len(chars) + 1, bool)
            begins[[o[0] for _, o in self.tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"\n{probe}{chr(c)}" for c in chars))]] = True
            kinds[~begins[2 : 3 * len(chars) : 3]] = kind
        if chars:
            self.classes[chars] = kinds
        self.pages[page] = True

    def kinds(self, points: np.ndarray) -> np.ndarray:
        used = np.zeros(len(self.pages), bool)
        used[points // _PAGE] = True
        for page in np.flatnonzero(used & ~self.pages):
            self._learn(int(page))
        return self.classes[points]


def _slices(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie anywhere in data."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


class Counter:
    """Prefix counts of texts, with the counts of the words seen last."""

    def __init__(self, path: str):
        self.words = Words(path)
        self._clear()

    def _clear(self) -> None:
        self.table, self.pool, self.used = tokens.WordTable(), np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _numbers(self, strings: pa.Array) -> np.ndarray:
        """The number of each of these different words in the table."""
        texts = strings.to_numpy(zero_copy_only=False)
        number = self.table.find(texts)
        new = np.flatnonzero(number < 0)
        if len(new):
            sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False)
            if self.table.full(len(new), int(sizes[new].sum())):
                self._clear()
                new = np.arange(len(texts))
            counts: list[list[int]] = [[]] * len(new)
            for k in np.argsort(texts[new], kind="stable").tolist():  # neighbours begin alike
                counts[k] = self.words.counts(texts[new[k]])
            number[new] = self.table.add(texts[new], int(sizes[new].sum()))
            self._keep(number[new], counts)
        return number

    def _keep(self, number: np.ndarray, counts: list[list[int]]) -> None:
        lengths = np.array([len(c) for c in counts], np.int64)
        if self.used + lengths.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * int(lengths.sum()), np.int32)])
        if number[-1] >= len(self.start):
            more = np.zeros(number[-1] + len(number) + 1, np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.pool[self.used : self.used + int(lengths.sum())] = np.concatenate([np.array(c, np.int32) for c in counts])
        self.start[number], self.length[number] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += int(lengths.sum())

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Counts at the prefixes of pieces without a special string, from length 1 on."""
        joined = "".join(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        if not joined:
            return [np.zeros(0, np.int64) for _ in pieces]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n, data = len(points), np.frombuffer(joined.encode(), np.uint8)
        byte_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        kind = self.words.kinds(points)
        first = np.zeros(n + 1, bool)
        first[np.cumsum(sizes) - sizes] = True
        first[n] = True
        begins = first.copy()
        begins[1:n] |= kind[1:] != kind[:-1]
        # the last blank of a run goes with the word behind it, or stands alone where it isn't a space
        after = np.flatnonzero((kind[1:] != _BLANK) & (kind[:-1] == _BLANK) & ~first[1:n]) + 1
        run = after[~begins[after - 1]]  # white space of two or more before a word
        begins[after - 1] = True
        begins[after[points[after - 1] == 32]] = False
        for text in CONTRACTIONS:
            at = np.flatnonzero((points == 39) & begins[:n])
            at = at[at + len(text) <= n]
            for k, c in enumerate(text[1:], 1):
                at = at[(points[at + k] == ord(c)) & ~first[at + k]]
            begins[at + 1] = False
            begins[at + len(text)] = True
        starts = np.flatnonzero(begins[:n])
        lengths = np.diff(np.concatenate([starts, [n]]))
        strings = [_slices(data, byte_at[starts], byte_at[starts + lengths])]
        # white-space runs as a prefix that ends with them has them
        if len(run):
            run_begins = np.maximum.accumulate(np.where((kind != _BLANK) | first[:n], np.arange(n), -1))[run - 1]
            run_begins = np.where(kind[run_begins] == _BLANK, run_begins, run_begins + 1)
            strings.append(_slices(data, byte_at[run_begins], byte_at[run]))
        coded = pa.concat_arrays(strings).dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        total = self.pool[self.start[number] + self.length[number] - 1].astype(np.int64)
        own = number[: len(starts)]
        before = np.cumsum(total[: len(starts)]) - total[: len(starts)]
        piece_first = np.searchsorted(starts, np.cumsum(sizes) - sizes)  # of an empty piece: the next one's word, not read
        base = before - np.repeat(before[np.minimum(piece_first, len(starts) - 1)], np.diff(np.concatenate([piece_first, [len(starts)]])))
        out = np.repeat(base, lengths) + self.pool[np.repeat(self.start[own] - starts, lengths) + np.arange(n)]
        if len(run):
            out[run - 1] = base[np.searchsorted(starts, run_begins)] + total[len(starts) :]
        return np.split(out, np.cumsum(sizes)[:-1])

    def _cut(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Pieces of a text: what is counted, how many of its characters the next piece follows, and whether a special
        string stands between."""
        at = 0
        while True:
            found = self.words.special.search(text, at) if self.words.special else None
            end, behind = (found.start(), found.end()) if found else (len(text), len(text))
            while end - at > PIECE and (blank := _CUT.search(text, at + PIECE, end)):
                yield text[at : blank.start()], blank.start() - at, 0
                at = blank.start()
            yield text[at : behind - bool(found)], end - at, int(bool(found))
            if not found:
                return
            at = behind

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each text's prefixes, from the empty one to the whole."""
        cut = [list(self._cut(t)) for t in texts]
        found = iter(self._pieces([p for pieces in cut for p, _, _ in pieces]))
        out = []
        for pieces in cut:
            parts, base = [np.zeros(1, np.int64)], 0
            for _, size, special in pieces:
                own = next(found)
                parts.append(own + base)
                base += (int(own[size - 1]) if size else 0) + special
                if special:
                    parts.append(np.array([base], np.int64))
            out.append(np.concatenate(parts))
        return out


def packed(counts: np.ndarray) -> bytes:
    """Blocks of a base (8 bytes) and BLOCK offsets (2 bytes each), big-endian; the last block is cut."""
    n = len(counts)
    blocks = np.concatenate([counts, np.full(-n % BLOCK, counts[-1])]).reshape(-1, BLOCK)
    base = blocks.min(axis=1)
    out = np.zeros((len(blocks), 8 + 2 * BLOCK), np.uint8)
    out[:, :8] = base.astype(">i8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = (blocks - base[:, None]).astype(">u2").view(np.uint8).reshape(-1, 2 * BLOCK)
    return out.tobytes()[: out.size - 2 * (-n % BLOCK)]


def unpacked(stored: bytes) -> np.ndarray:
    size = 8 + 2 * BLOCK
    rows = np.frombuffer(stored + bytes(-len(stored) % size), np.uint8).reshape(-1, size)
    counts = np.ascontiguousarray(rows[:, :8]).view(">i8").astype(np.int64) + np.ascontiguousarray(rows[:, 8:]).view(">u2").astype(np.int64)
    return counts.ravel()[: counts.size - (-len(stored) % size) // 2]


def _number(stored: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(stored, at, F.lit(size))), 16, 10).cast("long")


def count_at(counts: Column, n_chars: Column) -> Column:
    """Tokens of a text's first n_chars characters, from its stored counts. Column functions only."""
    at = (F.call_function("div", n_chars, F.lit(BLOCK)) * (8 + 2 * BLOCK)).cast("int")
    return _number(counts, at + 1, 8) + _number(counts, (at + 9 + 2 * (n_chars % BLOCK)).cast("int"), 2)


def prefix_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_chars and the stored counts of all prefixes of every text of docs (doc_id, text)."""
    path = tokenizer_path or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = memory.kept(("prefix counts", path), lambda: Counter(path))
        for batch in batches:
            raw = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, lo = np.cumsum(sizes), 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE)))
                found = counter.counts([t.as_py().decode("utf-8", "replace") for t in raw.slice(lo, hi - lo)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi]), pa.array([len(c) - 1 for c in found], pa.int64()), pa.array([packed(c) for c in found], pa.binary())],
                    ["doc_id", "n_bytes", "n_chars", "counts"],
                )
                memory.after(int(sizes[lo:hi].sum()))
                lo = hi

    return shared.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)


def longest_prefix(counts: Column, limit: int) -> Column:
    """The characters of the longest prefix of at most `limit` tokens. Prefix counts may fall as a text goes on."""

    @F.arrow_udf("long")
    def cut(stored: pa.Array) -> pa.Array:
        return pa.array([None if s is None else int(np.flatnonzero(unpacked(s) <= limit)[-1]) for s in stored.to_pylist()], pa.int64())

    return cut(counts)


def truncated(texts: DataFrame, limit: int) -> DataFrame:
    """texts (doc_id, text, counts) cut to at most `limit` tokens each: doc_id, text, n_chars, n_tokens."""
    if limit < 0:
        raise ValueError("a limit can't be negative")
    cut = texts.select("doc_id", "text", "counts", longest_prefix(F.col("counts"), limit).alias("n_chars"))
    return cut.select("doc_id", F.substring("text", F.lit(1), F.col("n_chars").cast("int")).alias("text"), "n_chars", count_at(F.col("counts"), F.col("n_chars")).alias("n_tokens"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(shared.documents(spark, sf_dir))
    n_tokens = count_at(F.col("counts"), F.col("n_chars"))
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
