"""Operators held against brute force on texts with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from latticebits.llm import chunks, dac, decontaminate, minhash, packing, pii, sharding, suffixes, token_output, tokens, topk, windows


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokens.default_tokenizer())
    tokenizer = ids_of.t
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def bag(frame):
    return Counter(tuple(r) for r in frame.collect())


# ---- tokens, codes


def test_cached_words_give_whole_text_ids():
    import pyarrow as pa

    odd = ["don't stop'll", "<|startoftext|> x", "x<|endoftext|>", "été.", "ßİ.", "क़.", "ΑΣ. ΑΣ", "a|b | c|", "\tq\x1cz 1234", " ", "", "ﬁ. ǅ,", "é ́x", "!'s"]
    got = tokens.Encoder(tokens.default_tokenizer()).encode(pa.array([*odd, None]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in [*odd, None]]


def test_full_table_starts_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "WORDS", 50)
    texts = [f"alpha{i} beta{i * 7} gamma." for i in range(200)]
    encoder = tokens.Encoder(tokens.default_tokenizer())
    assert [np.frombuffer(g, "<u4").tolist() for lo in range(0, 200, 20) for g in encoder.encode(pa.array(texts[lo : lo + 20]))] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("top", [1, 255, 256, 70000, 2**32])
def test_codes_round_trip_and_random_access(top):
    ids = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    reader = dac.Reader(dac.encode(ids))
    assert (reader.decode() == ids).all() and [reader[i] for i in range(0, 3000, 37)] == ids[::37].tolist()
    with pytest.raises(IndexError):
        reader[3000]


def test_codes_of_nothing():
    assert len(dac.Reader(dac.encode(np.zeros(0, np.uint32))).decode()) == 0


def test_token_output(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write_ids(docs, path, segment_tokens=500)
    want, start, flat = Counter(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(t)
        want[(i, start, len(ids), crc(ids))] += 1
        start += len(ids)
        flat += ids
    got = bag(token_output.read_ids(spark, path))
    assert got == want
    for p in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_output.token_at(spark, path, p) == flat[p]


def test_token_output_of_nothing(spark, empty, tmp_path):
    token_output.write_ids(empty, f"file://{tmp_path}/ids")
    assert token_output.read_ids(spark, f"file://{tmp_path}/ids").count() == 0


# ---- packing


def test_packing(docs, rows):
    got = packing.pack(docs, pool_tokens=20000).collect()
    pieces, windows_of = defaultdict(list), defaultdict(list)
    for r in got:
        windows_of[r.sequence_id].append(r)
    padded = 0
    for window in windows_of.values():
        window.sort(key=lambda r: r.offset)
        assert [r.offset for r in window] == [sum(x.length for x in window[:k]) for k in range(len(window))]
        n = sum(r.length for r in window)
        assert n <= 4096
        padded += 0 if n & (n - 1) == 0 else 4096 - n
        for r in window:
            pieces[(r.doc_id, r.doc_tokens)].append(r)
    assert padded == 0
    want = Counter()
    for i, t in rows:
        want[(i, len(ids_of(t)))] += 1
    assert {k: sum(p.length for p in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    by_text = {(i, len(ids_of(t))): ids_of(t) for i, t in rows}
    for key, own in pieces.items():
        if want[key] == 1:
            for p in own:
                assert crc(by_text[key][p.start : p.start + p.length]) == p.ids_crc32
            assert sorted(p.start for p in own)[0] == 0


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_step_groups_are_even(docs):
    sums = Counter()
    for r in packing.pack(docs.coalesce(1), step_tokens=8192).collect():
        sums[r.step_group] += r.length
    assert sorted(sums.values())[1:] == [8192] * (len(sums) - 1)


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_and_inverse(n):
    out = [sharding.permute(i, n, 5) for i in range(n)]
    assert sorted(out) == list(range(n))
    assert [sharding.row_of(p % 8, p // 8, 8, n, 5) for p in out] == list(range(n))


def test_sharding(docs, rows):
    got = sharding.shard(docs, 8, seed=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(sharding.permute(r.row_number, len(rows), 5) == r.slot * 8 + r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == sorted((p % 8, p // 8) for p in range(len(rows)))


def test_sharding_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


# ---- windows, suffixes


def test_window_dedup(docs, rows, small_chunks):
    seen, want = {}, Counter()
    last = 2**63 - 1
    places = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places += [((last if i is None else i, j), tuple(w[j : j + 20])) for j in range(len(w) - 19)]
    for place, key in places:
        seen[key] = min(seen.get(key, place), place)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] < (last if i is None else i, j):
                gone[j : j + 20] = [True] * 20
        want[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    assert bag(windows.remove_repeated(docs)) == want


@pytest.mark.parametrize("hot", [2048, 0])
def test_suffix_dedup(docs, rows, small_chunks, hot):
    last, least = 2**63 - 1, {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            least[b[j : j + 50]] = min(least.get(b[j : j + 50], last), last if i is None else i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if least[b[j : j + 50]] < (last if i is None else i):
                gone[j : j + 50] = b"\1" * 50
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    assert bag(suffixes.remove_repeated(docs, hot_spans=hot)) == want


def test_suffix_sql_at_null_ids(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(None, "a " + passage), (5, "b " + passage + " c"), (None, passage), (2, "other text of its own, long enough to hold a string of fifty bytes")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = bag(suffixes.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).select(*names))
    assert got == Counter(con.execute(f"SELECT {', '.join(names)} FROM ({suffixes.ORACLE_SQL})").fetchall()) and sum(k[2] > 0 for k in got) == 2


def test_suffix_order():
    rng = np.random.default_rng(1)
    for trial in range(30):
        text = rng.integers(0, rng.integers(2, 5), rng.integers(60, 2000)).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[: rng.integers(1, 90)], 60)[: len(text)]
        starts = rng.permutation(len(text) - 49)
        number = dict()
        for s, c in zip(starts, suffixes.equal_starts(text, starts)):
            assert number.setdefault(text[s : s + 50].tobytes(), c) == c
        assert [number[k] for k in sorted(number)] == sorted(number.values()) and len(set(number.values())) == len(number)


def test_dedup_of_nothing(empty):
    assert windows.remove_repeated(empty).count() == 0
    assert suffixes.remove_repeated(empty).count() == 0


# ---- near duplicates


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    assert bag(minhash.near_duplicates(docs)) == Counter((i, least[root(k)]) for k, (i, _) in enumerate(rows))
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root(k) for k in range(len(rows))})
    assert {r.doc_id for r in kept.collect()} >= {i for i in least.values() if i is not None}


@pytest.mark.parametrize("times", [5, 10, 50])
def test_repeated_lines_do_not_hide_near_duplicates(spark, times):
    said = [f"w{i}" for i in range(200)]
    line = " ".join(f"line{i}" for i in range(20))
    edited = said[:100] + ["edited"] + said[101:]
    rows = [(1, " ".join([*said, line])), (2, " ".join([*edited, *[line] * times]))]
    a, b = (shingle_set(t) for _, t in rows)
    assert len(a & b) >= 0.8 * len(a | b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(minhash.near_duplicates(docs)) == Counter([(1, 1), (2, 1)])


def test_equal_weighted_shingles_have_one_signature(spark):
    line = " ".join(f"w{i}" for i in range(90))
    variants = [" ".join([line] * n) for n in (2, 3, 30)]
    crowd = [f"other{i} " * 3 + line for i in range(300)]
    alone = [minhash.sign(spark.createDataFrame([(1, t)], "doc_id long, text string"), "doc_id").drop("doc_id").first() for t in variants]
    among = spark.createDataFrame([(i, t) for i, t in enumerate(variants + crowd)], "doc_id long, text string").coalesce(1)
    assert [tuple(map(str, r)) for r in minhash.sign(among, "doc_id").where("doc_id < 3").orderBy("doc_id").drop("doc_id").collect()] == [tuple(map(str, r)) for r in alone]
    # the shingle set is one, and so are the bands that stand for it
    assert len({r.h1 for r in alone}) == 3 and len({tuple(r.bands[minhash.BANDS :]) for r in alone}) == 1 and len(alone[0].bands) == 2 * minhash.BANDS
    assert len(minhash.sign(spark.createDataFrame([(1, line)], "doc_id long, text string"), "doc_id").first().bands) == minhash.BANDS


def by_definition(x, y):
    """Probability Jaccard similarity of two Counters."""
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_similarities_by_definition():
    r = random.Random(2)
    for _ in range(60):
        x, y = (Counter({k: r.choice([1, 1, 2, 9]) for k in r.sample(range(30), r.randint(1, 25))}) for _ in range(2))
        sides = [np.array(list(v)) for z in (x, y) for v in (z.keys(), z.values())]
        assert minhash.similarities(*sides) == pytest.approx((len(x.keys() & y.keys()) / len(x.keys() | y.keys()), by_definition(x, y)))


def test_repeated_shingles_weigh(spark):
    """Much that is repeated on both sides and some rare words that differ: near by counts, not by sets."""
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(k, " ".join([*[line] * 40, *[f"own{k}x{i}" for i in range(40)]])) for k in (4, 9)] + [(11, " ".join([line, *[f"else{i}" for i in range(40)]]))]
    counts = [Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    assert by_definition(counts[0], counts[1]) > 0.85 and len(counts[0].keys() & counts[1].keys()) < 0.5 * len(counts[0].keys() | counts[1].keys())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(minhash.near_duplicates(docs)) == Counter([(4, 4), (9, 4), (11, 11)])


def test_code_and_sql_split_words_alike(spark):
    rows = [(1, "a\x0bb c d e f g h"), (2, "a b c d e f g h"), (3, "a\u2003b c d e f g h"), (4, "one\x1ctwo three four five six"), (None, "A B C D E F G H")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert bag(minhash.near_duplicates(docs)) == Counter(con.execute(minhash.ORACLE_SQL).fetchall()) == Counter([(1, 1), (2, 1), (None, 1), (3, 3), (4, 4)])


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicated(empty).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    ids = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = np.arange(0, 300), np.arange(100, 400)
    wa, wb = rng.integers(1, 5, 400).astype(float), rng.integers(1, 5, 400).astype(float)
    doc = np.concatenate([np.zeros(300, int), np.ones(300, int)])
    won = minhash.registers(doc, np.concatenate([ids[a], ids[b]]), np.concatenate([wa[a], wb[b]]), 2, 4096)
    x, y = np.zeros(400), np.zeros(400)
    x[a], y[b] = wa[a], wb[b]
    exact = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(100, 300))
    assert abs((won[0] == won[1]).mean() - exact) < 0.04


# ---- decontamination, search, personal data


def bench(spark):
    w = [t for _, t in BENCH]
    return spark.createDataFrame([(i, t, "x") for i, t in BENCH], "item_id long, text string, gram string") if w else None


BENCH = [(1, "one TWO three"), (2, None), (3, "---"), (None, "lone item"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (6, "É b c d e f g h i j")]


def test_decontamination(spark):
    rows = [(1, "x One, two three! one two three"), (2, None), (3, ""), (4, "lone-item"), (5, "z a b c d e f g h i j k"), (6, "é b c d e f g h i j k"), (6, "É B C D E F G H I J"), (None, "b c d e f g h i j k l"), (9, "two three one")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    item_windows = set()
    for i, t in BENCH:
        w = split(t)
        item_windows |= {(None if i is None else str(i), tuple(w[j : j + 10])) for j in range(max(1, len(w) - 9)) if w}
    want = Counter()
    for i, t in rows:
        w, hit, items = split(t), set(), set()
        for item, win in item_windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    items |= {item} - {None}
        want[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    assert bag(decontaminate.digest(docs, bench(spark))) == want
    clean = decontaminate.without_contaminated(docs, bench(spark))
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[-1])
    none = bench(spark).where("false")
    assert decontaminate.digest(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.digest(docs, none).count() == len(rows)
    assert decontaminate.digest(docs.where("false"), bench(spark)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(40, rows[3][1]), (900, None), (901, []), (902, [float("nan")] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), (920, [float("inf")] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    from pyspark.sql import functions as F

    vectors = topk.quantised(frame, "vec_id", "embedding", 64.0)
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for k, (q, vq) in enumerate(good):  # each row of a repeated id, without itself alone
        if q % 20 == 0:
            best = sorted((-int(np.dot(vq, v)), i) for j, (i, v) in enumerate(good) if j != k)[:20]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    assert len({k[0] for k in want}) < sum(q % 20 == 0 for q, _ in good)
    for kwargs in ({}, {"block": 3, "probe": 30, "shard_rows": 50}):
        assert bag(topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20, **kwargs)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    assert Counter(con.execute(topk.ORACLE_SQL).fetchall()) == want
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def brute_spans(t):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out)


def test_base_spans(rows):
    odd = ["a@b.c@d.e", "x@@y.z a.b@c", "@a.b", "1.2.3.4.5.6.7.8", "+1 (2", "+1 (555) 555-2485-", "4111-1111 1111 1111 1", "1" * 3000, "é+44 20 7946 0958"]
    for t in [*odd, *(t or "" for _, t in rows)]:
        assert sorted(pii.base_spans(t)) == brute_spans(t)


def test_skip_chain_carries_labels_only_where_they_lead():
    sample = [f"call +1 (55{i % 10}) 555-{1000 + i} or write user{i}@mail.example.com {4111111111111112 + i}" for i in range(200)]
    field = pii.Field.fit(sample)
    text = "Call +1 (988) 555-2485 now. Later: 555-2485. But not 444-1234."
    base, added = pii.find(text, field)
    assert [text[a:b] for _, a, b in base] == ["+1 (988) 555-2485"]
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "555-2485")]
    assert pii.redact_text(text, base + added) == "Call [PHONE] now. Later: [PHONE]. But not 444-1234."
    assert pii.find("Later: 555-2485 and 4111111111111112", field) == ([], [])


def test_numbers_cut_into_other_tokens_and_numbers_beside_others():
    sample = [f"call +1 (55{i % 10}) 555-{1000 + i} or write user{i}@mail.example.com, in {1900 + i} with {i} of {i * 7} 10.0.0.{i}" for i in range(200)]
    field = pii.Field.fit(sample)
    text = "Call +1 555 123 4567 now. Later 555 123 4567 or 5551234567, in 1999 with 555 or 123 of them."
    base, added = pii.find(text, field)
    assert [text[a:b] for _, a, b in base] == ["+1 555 123 4567"]
    assert pii.redact_text(text, base + added).replace("[PHONE] [PHONE] [PHONE]", "[PHONE]") == "Call [PHONE] now. Later [PHONE] or [PHONE], in 1999 with 555 or 123 of them."
    text = "Des +1 (826) 555-4081 190.137.223.204 du"
    base, added = pii.find(text, field)
    assert pii.redact_text(text, base + added) == "Des [PHONE] [IP] du"
    text = "Des +1 (826) 555-4081 1234567891 du"
    assert pii.find(text, field)[0] == [] and pii.redact_text(text, pii.find(text, field)[1]) == "Des [PHONE] 1234567891 du"


def test_messages_are_exact_on_a_chain():
    field = pii.Field(np.random.default_rng(0).normal(size=(pii._FEATURES, 5)), np.random.default_rng(1).normal(size=(5, 5)), 1.0)
    x = np.random.default_rng(2).normal(size=(3, pii._FEATURES))
    nodes = pii.Nodes([0, 2, 4], [1, 3, 5], x, np.array([-1, -1, 2]), np.array([[0, 1], [1, 2]]), np.zeros((0, 2), np.int64))
    u = np.exp(x @ field.weights)
    u[2] = np.eye(5)[2]
    t = np.exp(field.transition)
    joint = np.einsum("a,b,c,ab,bc->abc", u[0], u[1], u[2], t, t)
    joint /= joint.sum()
    got = field.marginals(nodes)
    assert np.allclose(got[0], joint.sum(axis=(1, 2)), atol=1e-4) and np.allclose(got[1], joint.sum(axis=(0, 2)), atol=1e-4)


def test_pii_rows(docs, rows, empty):
    field = pii.train(docs)
    d = docs.select("doc_id", pii.digests(field)("text").alias("r")).select("doc_id", "r.*").collect()
    assert Counter((r.doc_id, r.base_sha256) for r in d) == Counter((i, hashlib.sha256(pii.joined(brute_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert pii.train(empty).marginals(pii.nodes_of("", [])).shape[0] == 0
    assert empty.select(pii.digests(field)("text")).count() == 0
