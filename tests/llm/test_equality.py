"""Words and windows that a weak hash would mix up, and a sketch so narrow that everything collides."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from latticebits.llm import hashing, language, minhash, packing, suffixes, token_output, tokens, windows


def thue_morse(n, swap=False):
    """Words of two letters whose polynomial hashes modulo powers of two collide."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def pairs():
    return [(thue_morse(n), thue_morse(n, True)) for n in (512, 1024, 2048, 4096, 8192)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_ids_of_colliding_words(library):
    words = [w for p in pairs() for w in p]
    got = tokens.Encoder(tokens.default_tokenizer()).encode(pa.array([" ".join(words), *words]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in [" ".join(words), *words]]


def test_costs_of_colliding_words():
    model = language.Model.fit({"a": ["abba abab"], "b": ["baba bbaa"]})
    words = pa.array([w for p in pairs() for w in p])
    assert language.Scorer(model).costs(words).tolist() == model.word_costs(words).tolist()


def test_hashes_tell_colliding_words_apart():
    words = pa.array([w for p in pairs() for w in p])
    assert len(set(hashing.of_words(words).tolist())) == len(words)


@pytest.fixture(scope="module")
def colliding(spark):
    rows = []
    for k, (a, b) in enumerate(pairs()):
        around = [f"w{k}x{i}" for i in range(30)]
        rows += [(10 * k + 1, " ".join([*around[:15], a, *around[15:]])), (10 * k + 2, " ".join([*around[:15], b, *around[15:]])), (10 * k + 3, " ".join([a] * 6)), (10 * k + 4, " ".join([b] * 6))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def removed_by_brute_force(rows, size):
    seen = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            seen[key] = min(seen.get(key, (i, j)), (i, j))
    out = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] < (i, j):
                gone[j : j + size] = [True] * size
        out[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"width": 1}, {"width": 7, "depth": 3}, {"hot": 0}, {"width": 2, "hot": 0, "depth": 1}])
def test_no_window_is_lost_or_mixed_up(colliding, options):
    rows, docs = colliding
    copies = [(100 + i, t + f" tail{i} " + t) for i, t in rows]
    both = docs.sparkSession.createDataFrame(rows + copies, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in windows.remove_repeated(both, **options).collect()) == removed_by_brute_force(rows + copies, 20)


def test_sketches_add_up_and_never_fall_short():
    draw = np.random.default_rng(1)
    keys = [draw.integers(0, 300, 500).astype(np.uint64) for _ in range(3)]
    rows = [windows._Row(hashing.mix(k), 0, 1, 64) for k in keys]
    packed = [dict(windows.sketch_messages([r], 1))[0] for r in rows]
    answers = [np.unpackbits(np.frombuffer(a, np.uint8), count=len(r.cells)).astype(bool)[r.of] for a, r in zip(windows.merged_sketches(packed, 64, 2), rows)]
    total = Counter(x for k in keys for x in k.tolist())
    assert all(flag for k, bits in zip(keys, answers) for x, flag in zip(k.tolist(), bits.tolist()) if total[x] > 1)


def test_spans_of_colliding_bytes(colliding):
    rows, docs = colliding
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeated(docs).collect()}
    least = {}
    for i, t in rows:
        for j in range(len(t) - 49):
            least[t[j : j + 50]] = min(least.get(t[j : j + 50], i), i)
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if least[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        assert got[i] == sum(gone)


def test_near_duplicates_of_colliding_words(colliding):
    rows, docs = colliding
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert all(got[i] == i for i, _ in rows)


def test_files_and_pieces_of_colliding_words(colliding, library, tmp_path):
    import zlib

    rows, docs = colliding
    crc = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}
    token_output.write_ids(docs, f"file://{tmp_path}/ids")
    assert {r.doc_id: r.ids_crc32 for r in token_output.read_ids(docs.sparkSession, f"file://{tmp_path}/ids").collect()} == crc
    whole = {r.doc_id: r.ids_crc32 for r in packing.pack(docs).where("length = doc_tokens").collect()}
    assert whole and all(crc[i] == c for i, c in whole.items())


def test_hashes_of_runs():
    x = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for size in (1, 2, 3, 8, 16, 20, 25):
        made, seen = hashing.of_runs(x, size), {}
        assert len(made) == 201 - size and len(hashing.of_runs(x[: size - 1], size)) == 0
        assert all(seen.setdefault(tuple(x[i : i + size]), h) == h for i, h in enumerate(made)) and len(set(seen.values())) == len(seen)
    z = hashing.mix(x + np.arange(200, dtype=np.uint64))
    for reach in (1, 5, 13, 18, 35):
        assert hashing.least_of(z, reach).tolist() == [i + int(np.argmin(z[i : i + reach])) for i in range(201 - reach)]
