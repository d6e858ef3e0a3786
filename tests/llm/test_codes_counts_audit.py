"""Vector codes, prefix counts and the filter audit against brute force."""

import hashlib
import random
from collections import Counter
from itertools import permutations
from math import floor, inf, nan

import duckdb
import pytest
from pyspark.sql import functions as F

from latticebits.llm import audit, lloyd, prefix_counts, shared

# ---- vector codes


def lloyd_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, label, whole components): sorted (vec_id, code, error, label_error, sha)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of = Counter()
    for r, e in zip(rows, errors):
        of[r[1]] += e
    cap = 2**63 - 1
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), min(x, cap), min(of[r[1]], cap), sha) for r, f, x in zip(rows, found, errors))


def vectors(spark, rows):
    return spark.createDataFrame([(k, i, v, label, "x", None) for k, (i, label, v) in enumerate(rows)], "slice int, vec_id long, embedding array<double>, label string, code string, block int").repartition(3)


def usable(rows):
    return [(i, label, [floor(4096 * x) for x in v]) for i, label, v in rows if v and all(x is not None and abs(x) < inf for x in v)]


@pytest.mark.parametrize("size, scale", [(16, 1.0), (8, 1e6), (16, 1e30)])
def test_vector_codes_are_lloyds(spark, size, scale):
    r = random.Random(size)
    rows = [(i, r.choice(["a", "b", None]), [r.gauss(r.choice([-1, 1]), 0.3) * scale for _ in range(size)]) for i in range(300)]
    rows += [rows[5], rows[5], (7, "a", rows[9][2]), (None, "b", rows[11][2]), (900, "a", None), (901, "a", []), (902, None, [nan] * size), (903, None, [inf] + [0.0] * (size - 1)), (904, "a", [None] + [0.0] * (size - 1)), (905, "a", [1.0])]
    got = lloyd.compressed(lloyd.whole_vectors(vectors(spark, rows)), block_rows=7)
    assert Counter(tuple(x) for x in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == lloyd_by_hand([u for u in usable(rows) if len(u[2]) == size])


def test_few_and_no_vectors(spark):
    few = [(3, "a", [float(k) for k in range(8)]), (1, None, [0.5] * 8)]
    assert Counter(tuple(x) for x in lloyd.compressed(lloyd.whole_vectors(vectors(spark, few))).collect()) == lloyd_by_hand(usable(few))
    for none in ([], [(1, "a", None)], [(1, "a", [1.0] * 7)]):
        assert lloyd.compressed(lloyd.whole_vectors(vectors(spark, none))).collect() == []


def test_rounds_move_only_what_changed(spark):
    r = random.Random(4)
    rows = [(i, "a", [r.choice([-1, 1]) + r.gauss(0, 0.05) for _ in range(8)]) for i in range(400)]
    with shared.scratch(spark):
        trained = lloyd.train(lloyd.whole_vectors(vectors(spark, rows)), block_rows=50, rounds=50)
    assert trained.changed[-1] == 0 and len(trained.changed) < 50  # settled, and left out from there
    import numpy as np

    x, old = np.arange(32.0).reshape(4, 8), np.zeros((4, 8), np.uint8)
    assert lloyd.moved(x, old, old, 16, 1) == ([], [])
    new = old.copy()
    new[2, 3] = 5
    keys, amounts = lloyd.moved(x, old, new, 16, 1)
    assert dict(zip(keys, amounts)) == {(3 * 16 + 0) * 2: -1, (3 * 16 + 0) * 2 + 1: -19, (3 * 16 + 5) * 2: 1, (3 * 16 + 5) * 2 + 1: 19}


# ---- prefix counts

ODD = [
    "", "a", " ", "   x", "a   b", "a  \n b\n\nc", "don't stop'll 'll  'lx  'rex's's", "!!'s '' 's\n's\t's", "x<|endoftext|>y", "<|endoftext|><|endoftext|> ",
    "a <|endoftext|  <|endoftext|>  b!<|end", "été naïve 漢字 \U0001f600\U0001f600 e\u0301x", "\x1c\x1d\x85\xa0\u2003 q \u3000z", "12345 6789x12", "a\tb\r\n c  ", "'", "x" * 70, "    " * 40 + "if x:\n        y\n", "½ ² ① x²", "can'tt 've've'",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(prefix_counts.default_tokenizer())


def test_every_prefix_as_the_library_counts_it(monkeypatch):
    monkeypatch.setattr(prefix_counts, "PIECE", 40)
    tokenizer, counter, r = library(), prefix_counts.Counter(prefix_counts.default_tokenizer()), random.Random(1)
    pool = ["a", "b", " ", "  ", "'", "s", "ll", "re", "\n", "!", "<|endoftext|>", "<|end", "é", "漢", "1", "22", "The", " the", "ing", "\t", "X", "'t", "\U0001f600", "\xa0", "..."]
    for texts in [ODD, *[["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(5)] for _ in range(150)]]:
        for text, got in zip(texts, counter.counts(texts)):
            assert got.tolist() == [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text
            assert (prefix_counts.unpacked(prefix_counts.packed(got)) == got).all()


def test_full_table_of_words_starts_anew(monkeypatch):
    from latticebits.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 50)
    tokenizer, counter = library(), prefix_counts.Counter(prefix_counts.default_tokenizer())
    texts = [f"alpha{i} beta{i * 7}  gamma." for i in range(100)]
    assert [int(c[-1]) for lo in range(0, 100, 20) for c in counter.counts(texts[lo : lo + 20])] == [len(tokenizer.encode(t).ids) for t in texts]


def test_stored_counts_answer_prefixes_and_limits(spark, docs, rows):
    tokenizer = library()
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    counted = prefix_counts.prefix_counts(docs).persist()
    got = counted.select("doc_id", "n_bytes", "n_chars", prefix_counts.count_at(F.col("counts"), F.col("n_chars")).alias("n_tokens"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, len((t or "").encode()), len(t or ""), n(t or "")) for i, t in rows)
    text = "".join(f"{k} word'll  {'é' * (k % 3)}\n" for k in range(60))
    one = prefix_counts.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    every = one.select(F.explode(F.sequence(F.lit(0), F.lit(len(text)))).alias("at"), "counts").select("at", prefix_counts.count_at(F.col("counts"), F.col("at")).alias("n"))
    want = [n(text[:k]) for k in range(len(text) + 1)]
    assert [r["n"] for r in every.orderBy("at").collect()] == want
    for limit in (0, 1, 7, 100, 10_000):
        cut = prefix_counts.truncated(one.withColumn("text", F.lit(text)), limit).first()
        longest = max(k for k, w in enumerate(want) if w <= limit)
        assert (cut["text"], cut["n_chars"], cut["n_tokens"]) == (text[:longest], longest, want[longest])
    counted.unpersist()


def test_prefix_counts_of_odd_tables(spark, empty):
    assert prefix_counts.prefix_counts(empty).collect() == []
    bad = spark.sql("SELECT 1L AS doc_id, CAST(unhex('41FF42') AS STRING) AS text")
    row = prefix_counts.prefix_counts(bad).first()
    assert (row["n_bytes"], row["n_chars"]) == (3, 3)


# ---- filter audit


def audit_by_hand(docs, labels):
    import re

    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))  # no label without an id
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {f for f, x in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search("[#$%&*|]", t))), ("E", i is not None and i > first[t])) if x}
        failed.append((lang or "", fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {lang or "" for *_, lang in docs}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                hit = [f for f in own if name in f[1] and not before & f[1]]
                out.append((part, order, step, name, sum(not f[1] & (before | {name}) for f in own), len(hit), sum(name in f[1] and bool(before & f[1]) for f in own), sum(f[1] == {name} for f in own), sum(f[2] for f in hit), sum(f[3] for f in hit)))
                shapley[part, name] += len(hit)
    return Counter((*o, shapley[o[0], o[3]]) for o in out)


def audit_tables(spark):
    r = random.Random(3)
    long = " ".join(f"w{r.randint(0, 400)}" for _ in range(250))
    again = "one two " * 150
    texts = [long, long, again, again, "Short $ text", "SHOUTING " * 300, None, "", "\x0b \x0c\t", "été " * 210 + "漢 A", "a\x0bb|c", "x" * 200_000]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in [*range(60), 7, 7, None, None, None]]
    docs += [docs[3], docs[3]] + [(500 + k, again, "en") for k in range(200)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 70, 2), 7, 4, 4, None, *range(500, 600)]]
    table = spark.createDataFrame([(i, t, lang, 1, "m", False) for i, t, lang in docs], "doc_id long, text string, lang string, mask int, part string, good boolean").repartition(5)
    return docs, labels, table, spark.createDataFrame([(i, q, t, "z") for i, q, t in labels], "doc_id long, quality int, toxic int, text string")


def test_audit_by_hand(spark):
    docs, labels, table, marks = audit_tables(spark)
    got = audit.audited(audit.cells(table, marks))
    columns = ["part", "filter_order", "step", "filter", *audit.METRICS, "shapley"]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == audit_by_hand(docs, labels)
    assert audit.audited(audit.cells(table.limit(0), marks)).collect() == []
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", marks.select("doc_id", "quality", "toxic").toPandas().astype("Int64"))
    assert Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({audit.ORACLE_SQL})").fetchall()) == audit_by_hand(docs, labels)
