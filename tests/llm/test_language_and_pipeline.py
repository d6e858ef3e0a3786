import math

import pyarrow as pa
import pytest

from latticebits.llm import decontaminate, language, minhash, packing, pii

EN = ["the cat and the dog were thinking of the river", "they have gone to the other house this morning", "what is the reason for this and that"] * 8
DE = ["der hund und die katze gehen durch das dorf", "sie haben nicht mehr die zeit für das spiel", "ich weiß nicht ob das eine gute idee ist"] * 8


def brute_bits(train, text):
    """Code length by the textbook definition."""
    counts = {}
    for line in train:
        for word in line.lower().replace("\n", " ").split(" "):
            s = b" " + word.encode() + b" "
            for j in range(1, len(s)):
                for k in range(min(language.ORDER, j) + 1):
                    counts.setdefault(s[j - k : j], {}).setdefault(s[j], 0)
                    counts[s[j - k : j]][s[j]] += 1
    # contexts of one length are kept apart by their length alone
    total = 0.0
    for word in text.lower().replace("\n", " ").split(" "):
        s = b" " + word.encode() + b" "
        for j in range(1, len(s)):
            for k in range(min(language.ORDER, j), -2, -1):
                if k < 0:
                    total += 8
                    break
                c = counts.get(s[j - k : j])
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if s[j] in c:
                    total += math.log2((n + d) / c[s[j]])
                    break
                total += math.log2((n + d) / d)
    return total


def test_costs_are_exact():
    model = language.Model.fit({"en": EN, "de": DE})
    scorer = language.Scorer(model)
    for text in ["the house", "das haus für zebra-xyz", "qqqq 123", "the the the", "x" * 300]:
        words = language.split_words(pa.array([text])).flatten()
        bits = scorer.costs(words.dictionary_encode().dictionary)[words.dictionary_encode().indices.to_numpy()].sum(axis=0)
        assert bits == pytest.approx([brute_bits(DE, text), brute_bits(EN, text)])


def test_predictions_and_odd_texts():
    scorer = language.Scorer(language.Model.fit({"en": EN, "de": DE}))
    texts = ["this is what they were thinking", "nicht die katze", None, "", " \n", "123 !!", "a" * 100_000, "this is what they were thinking"]
    labels, scores = scorer.predict(pa.array(texts))
    assert labels.to_pylist()[:6] == ["en", "de", "und", "und", "und", "und"] and labels[0] == labels[7]
    assert (scores[2:6] == 0).all() and scores[0] > 0.5 and ((scores >= 0) & (scores <= 1)).all()
    assert len(scorer.predict(pa.array([], pa.string()))[0]) == 0


def test_full_table_starts_anew(monkeypatch):
    from latticebits.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 8)
    model = language.Model.fit({"en": EN, "de": DE})
    small, texts = language.Scorer(model), pa.array(EN + DE)
    a = [small.predict(texts.slice(i, 1))[1][0] for i in range(len(texts))]
    monkeypatch.undo()
    assert a == pytest.approx(language.Scorer(model).predict(texts)[1].tolist())


def test_held_out_accuracy(spark):
    rows = [(i, t + f" {i}", lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = docs.select("lang", language.held_out().alias("out"), language.predicted(spark, model)("text")["lang_pred"].alias("p")).where("out").collect()
    assert got and sum(r.lang == r.p for r in got) >= 0.9 * len(got)


def test_training_on_nothing(spark, empty, docs):
    assert language.train(empty) is None
    assert {r[0] for r in docs.select(language.predicted(spark, None)("text")["lang_pred"]).collect()} == {"und"}


def test_no_label_is_lost_in_training(spark):
    from pyspark.sql import functions as F

    rows = [(1, "12 " + " ".join(DE * 100), "de")] + [(10 + i, f"{EN[i % 3]} {i}", f"l{i:02}") for i in range(40)]
    assert len(rows[0][1]) > language.MAX_DOC_BYTES
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), total_bytes=41 * 8)
    assert model.languages == sorted(r[2] for r in rows)


def test_documents_without_labels_stay(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, EN[0], None), (2, "12 --", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in c.keep_known_language(spark, docs, str(tmp_path)).collect()] == [1]


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (docs.union(docs.limit(0)), empty):
        now = source
        for name, stage in c.STAGES:
            before, now = now, stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == docs.columns
        assert now.count() >= 0
    assert [n for n, _ in c.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = c.keep_known_language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.subtract(kept).collect()} == {4, 5, 6, 7}
    single = c.drop_near_duplicates(spark, kept, str(tmp_path))
    assert not {2, 3} & {r.doc_id for r in single.collect()}
    clean = c.drop_contaminated(spark, single, str(tmp_path))
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {10, 11}
    text = {r.doc_id: r for r in c.redact_personal_data(spark, clean, str(tmp_path)).collect()}[12]
    assert "[EMAIL]" in text.text and "[CARD]" in text.text and "[IP]" in text.text and "10.0.0.300" in text.text and text.n_chars == len(text.text)
