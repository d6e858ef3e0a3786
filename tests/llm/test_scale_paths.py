"""Paths that small tables don't take by themselves, and values beyond the usual range."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticebits.llm import chunks, components, dac, decontaminate, minhash, packing, pii, shared, token_output, topk


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6, 1e8, 1e20, 1e300])
def test_scores_are_exact_at_any_size(spark, scale):
    rng = np.random.default_rng(int(np.log10(scale)) + 1)
    rows = [(i, [float(x) for x in rng.normal(size=5) * (scale if i % 3 else 1.0)]) for i in range(90)] + [(7, [1e-3] * 5), (91, [0.0] * 5), (92, [scale] * 5), (93, [scale] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: int(np.floor(64 * x)) if abs(64 * x) < 2**53 else int(64 * x)
    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    want = set()
    for q in {i for i, _ in ints if i % 20 == 0}:
        (vq,) = [v for i, v in ints if i == q]
        best = sorted((-sum(a * b for a, b in zip(vq, v)), i) for i, v in ints if i != q)[:20]
        want |= {(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(best)}
    got = topk.top_k(topk.quantised(frame, "vec_id", "embedding", 64.0).repartition(3), F.col("vec_id") % 20 == 0, 20, block=2, probe=40, shard_rows=12)
    assert {tuple(r) for r in got.collect()} == want


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i % 7 - 3)] * (1 + i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantised(frame, "vec_id", "embedding", 64.0), F.col("vec_id") % 20 == 0, 3).collect()
    for q, v in rows[::20]:
        best = sorted((-sum(64 * int(a) * 64 * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch, docs, rows):
    items = [(1, rows[9][1]), (2, "same id one"), (3, "12345 67"), (4, "ab"), (None, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = Counter(tuple(r) for r in decontaminate.digest(docs, bench).collect())
    assert any(r[-1] for r in small)
    for name in ("MAX_BROADCAST", "MAX_BROADCAST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, 0)
            assert Counter(tuple(r) for r in decontaminate.digest(docs, bench).collect()) == small


def test_one_token_takes_few_bytes():
    ids = np.random.default_rng(1).integers(0, 50_000, 100_000).astype(np.uint32)
    code, taken = dac.encode(ids), []

    def read(at, n):
        taken.append(n)
        return code[at : at + n]

    reader = dac.Reader(read)
    head = sum(taken)
    for i in (0, 511, 512, 77_777, 99_999):
        taken.clear()
        assert reader[i] == ids[i] and sum(taken) <= len(reader.levels) * (1 + 4 + dac.STEP // 8)
    assert head < 64


def test_rows_without_an_id_are_dealt_to_several_parts(spark, tmp_path):
    rows = [(None, f"text {i:05d} " * 3) for i in range(4000)]
    path, joined = f"file://{tmp_path}/ids", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    try:
        token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    finally:
        spark.conf.unset(joined)
    got = token_output.read_ids(spark, path).orderBy("start").collect()
    assert len(got) == 4000 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert spark.read.parquet(f"{path}/parts").count() > 1


def test_step_groups_are_even_over_pools(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gamma,", "delta"]) for _ in range(int(draw.paretovariate(0.7) * 40) % 9000))) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), pool_tokens=30_000, step_tokens=8192).collect()
    sums = Counter()
    for r in got:
        sums[r.step_group] += r.length
    short = [n for n in sums.values() if n != 8192]
    assert len(sums) > 20 and max(sums.values()) == 8192 and sum(short) < 2 * 8192 and len(short) <= 3


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (7, 7)]
    least = {}
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for n in sorted(near):
        todo = [n] if n not in least else []
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = n
                todo += near[x]
    with shared.scratch(spark):
        assert {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == least
        assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_recall_of_near_duplicates_with_repeats(spark):
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for family in range(40):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(40, 200))]
        line = [draw.choice(vocabulary) for _ in range(12)]
        for copy in range(6):
            words = text[:]
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"edit{family}x{copy}"
            rows.append((len(rows), " ".join(words + line * draw.choice([0, 1, 3, 40]))))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 100 and sum(got[a] == got[b] for a, b in links) == len(links)


def test_many_classes_in_one_bucket(spark, monkeypatch):
    """Texts that share half of their words share buckets by chance, and hubs are not enough where rounds are none."""
    common = [f"c{i}" for i in range(60)]
    rows = [(10 * k + j, " ".join(common + [f"k{k}w{i}" for i in range(40)] + [f"e{j}"])) for k in range(25) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: 10 * (i // 10) for i, _ in rows}
    for rounds in (2, 0):
        monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(minhash, "BLOCK", 8)
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == want


def test_chunks_grow_with_the_corpus(spark, monkeypatch, docs, rows):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 8000)
    size = sum(len((t or "").encode()) + 1 for _, t in rows)
    with shared.scratch(spark):
        for growth in (0, 20_000):
            monkeypatch.setattr(chunks, "GROWTH", growth)
            corpus = chunks.stage(docs)
            staged = spark.read.schema(chunks.SCHEMA).parquet(corpus.path).collect()
            assert corpus.n_bytes == size == sum(r.n_bytes for r in staged) and sorted(i for r in staged for i in r.ids if i is not None) == sorted(i for i, _ in rows if i is not None)
            few = len(staged)
        assert few <= 15


def sentences(draw, n):
    """Texts with a phone number or a card that comes again in another form, and with plain numbers; and what is personal."""
    out = []
    for _ in range(n):
        phone = f"{draw.randint(200, 989)} {draw.randint(200, 999)} {draw.randint(1000, 9999)}"
        plain = f"{draw.randint(1900, 2030)} and {draw.randint(1, 999)} of {draw.randint(10000, 99999)}"
        again = draw.choice([phone, phone.replace(" ", "-"), phone.replace(" ", "")])
        text = f"Call +1 {phone} in {plain}. Later {again} answers, not {draw.randint(100, 999)}-{draw.randint(1000, 9999)}."
        at = text.index("Later ") + 6
        out.append((text, set(range(text.index("+1"), text.index("+1") + 3 + len(phone))) | set(range(at, at + len(again)))))
    return out


def test_precision_and_recall_on_texts_not_trained_on():
    draw = random.Random(4)
    field = pii.Field.fit([t for t, _ in sentences(draw, 300)])
    hit = found = wanted = 0
    for text, personal in sentences(draw, 200):
        base, added = pii.find(text, field)
        marked = {i for _, a, b in base + added for i in range(a, b) if text[i] != " "}
        personal = {i for i in personal if text[i] != " "}
        hit, found, wanted = hit + len(marked & personal), found + len(marked), wanted + len(personal)
    assert hit / found > 0.95 and hit / wanted > 0.95


def test_scratch_removes_what_is_not_a_result(spark):
    from pathlib import Path

    with shared.scratch(spark):
        with shared.scratch(spark):
            kept = shared.written(spark.range(3), "kept", result=True)
            gone = shared.new_path(spark, "gone")
            spark.range(2).write.parquet(gone)
        assert kept.count() == 3 and not Path(gone.removeprefix("file://")).exists()
        (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    assert not Path(path.removeprefix("file://")).exists()
