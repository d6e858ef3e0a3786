"""Token ids of whole texts by the tokenizers library, with a bounded table of words.

White space never joins two pre-tokens, and the normaliser (NFC, white space to a blank, lower case) never acts
across a blank, so the ids of a text are the ids of its blank-separated words one after another. A run of letters
and the punctuation behind it are two pre-tokens, so a word new to the table is encoded in these two parts, ASCII
letters in lower case (letters whose normal or lower-case form may hold a mark are left to the library as they
stand), many in one call with a divider between them. Arrow splits texts and finds a batch's different words; the
table is keyed by the words themselves. Tests hold the ids against whole-text encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from latticebits.llm import memory

END_ID = 2
#: Bounds of a worker's table of words, together about 200 MB. Invented words are many: in 160 MB of the check tool's
#: texts 1.6 million different ones, of which a table of 400,000 encodes each 2.4 times, one of 1,000,000 1.4 times.
WORDS, WORD_BYTES = 1_000_000, 32 << 20
_BATCH_BYTES = 2 << 20
_CALL = 2000
_DIVIDER = "|"
#: ASCII punctuation but for the apostrophe, which can begin a contraction.
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Different words to runs of a pool of values: a dict of the words themselves, so no two words are ever mixed up.

    One table a worker, of about WORDS words (over `share`, where a word's value is large) and WORD_BYTES of text at
    most: a full one starts anew before it takes more words, of no influence on any result."""

    def __init__(self, share: int = 1):
        self.share = share
        self.at: dict[str, int] = {}
        self.text_bytes = 0

    def full(self, n_words: int, n_bytes: int) -> bool:
        return len(self.at) > 0 and (len(self.at) + n_words > WORDS // self.share or self.text_bytes + n_bytes > WORD_BYTES)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is new."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: np.ndarray, n_bytes: int) -> np.ndarray:
        """Numbers for these different new words, rising from the table's size."""
        first = len(self.at)
        number = np.arange(first, first + len(words))
        self.at.update(zip(words, number.tolist()))
        self.text_bytes += n_bytes
        return number


class Encoder:
    """Texts to ids as little-endian uint32 bytes, the end id appended."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self._clear()
        (self.divider,) = self.tokenizer.encode(_DIVIDER, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.table, self.pool, self.used = WordTable(), np.zeros(1 << 16, "<u4"), 0
        self.start, self.length = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, stems: list[str]) -> Iterable[tuple[str, bytes]]:
        """Runs of letters, which never give the divider's id, many in one call."""
        for lo in range(0, len(stems), _CALL):
            part = stems[lo : lo + _CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_DIVIDER} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, cut = ids.tobytes(), 4 * np.flatnonzero(ids == self.divider)
            if len(cut) != len(part) - 1:
                yield from ((s, self._alone(s)) for s in part)
            else:
                yield from zip(part, (raw[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)])))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        parts, stems, suffixes = [], set(), {"": b""}
        for word in words:
            stem = word.rstrip(_PUNCTUATION)
            if stem.isalpha() and (stem.isascii() or "İ" not in stem and is_normalized("NFC", stem)):
                suffix = word[len(stem) :]
                stem = stem.lower() if stem.isascii() else stem
                stems.add(stem)
                if suffix not in suffixes:
                    suffixes[suffix] = self._alone(suffix)
                parts.append((stem, suffix))
            else:
                parts.append((None, word))
        known = dict(self._letters(list(stems)))
        return [known[stem] + suffixes[rest] if stem is not None else self._alone(rest) for stem, rest in parts]

    def _runs(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each of these different words are."""
        texts, n_bytes = words.to_numpy(zero_copy_only=False), pc.binary_length(words)
        number = self.table.find(texts)
        new = np.flatnonzero(number < 0)
        if len(new):
            sizes = n_bytes.to_numpy(zero_copy_only=False)
            if self.table.full(len(new), int(sizes[new].sum())):
                self._clear()
                new = np.arange(len(texts))
            coded = self._encode_words(texts[new].tolist())
            number[new] = self.table.add(texts[new], int(sizes[new].sum()))
            self._keep(number[new], coded)
        return self.start[number].astype(np.int64), self.length[number].astype(np.int64)

    def _keep(self, number: np.ndarray, coded: list[bytes]) -> None:
        ids, lengths = np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], dtype=np.int32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), "<u4")])
        if number[-1] >= len(self.start):
            more = np.zeros(number[-1] + len(number) + 1, np.int32)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[number], self.length[number] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def _flat(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        start, length = self._runs(coded.dictionary)
        index = coded.indices.to_numpy()
        lengths = length[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(start[index] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.pool[at].tobytes(), 4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """One byte string per text; null counts as empty."""
        out: list[bytes] = []
        texts = pc.fill_null(texts.cast(pa.string()), "")
        upto, lo = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while lo < len(texts):
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + _BATCH_BYTES)))
            raw, ends = self._flat(texts.slice(lo, hi - lo))
            out.extend(raw[a:b] + self.end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))
            memory.after(int(upto[hi - 1] - before), 4 * memory.EVERY)
            lo = hi
        return out


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return memory.kept(("encoder", path, end_id), lambda: Encoder(path, end_id))
