"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree of depth ORDER is counted over words (a blank before and behind,
contexts end at the word). In a context seen n times before d different bytes, a byte seen c times there has
probability c/(n+d), leaving has d/(n+d) and leads to the context one byte shorter, at last to 1/256. The trees are
frozen after training; the code length of a text is the exact sum of these costs over all its words, and the
language with the least one is predicted. The cost of a word depends on nothing else, so a worker keeps it in a
bounded table and looks only at words new to it.

Training: different labelled texts of at most MAX_DOC_BYTES, chosen by a hash of the text with a rate that lets
TRAIN_BYTES be expected for each label (TOTAL_BYTES for all of them): a bounded sample, whatever repeats. A label of
which nothing is drawn gives a piece of one text, of a longer one where it has no other. Prediction reads whole texts
and only them.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text where nothing could
be learned; equal code lengths go to the label that sorts first; null labels and null doc_ids are not learned from;
repeated rows are predicted alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import memory, shared, tokens

ORDER = 4
TRAIN_BYTES, TOTAL_BYTES, MAX_DOC_BYTES = 1 << 20, 8 << 20, 1 << 16
UND = "und"
_BATCH_BYTES = 1 << 20


def _bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words as one byte array, each with a blank before and behind it; where each begins and ends."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    begins = np.concatenate([[0], np.cumsum(lengths + 2)])
    data = np.full(begins[-1], 32, np.uint8)
    data[np.arange(len(raw)) + np.repeat(2 * np.arange(len(words)) + 1, lengths)] = raw
    return data, begins[:-1], begins[1:]


def _grams(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the key of the gram that ends at each predicted byte, how many bytes of context each has, and its word.

    The key of order k is that of order k+1 without its highest byte; orders that a byte lacks hold other words' bytes."""
    word = np.repeat(np.arange(len(begins)), ends - begins - 1)
    at = np.arange(len(word)) + word + 1
    keys, key = [], data[at].astype(np.uint64)
    keys.append(key)
    for k in range(1, ORDER + 1):
        key = key | data[np.maximum(at - k, 0)].astype(np.uint64) << np.uint64(8 * k)
        keys.append(key)
    return keys, np.minimum(at - begins[word], ORDER), word


def split_words(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern(pc.replace_substring(pc.utf8_lower(texts), "\n", " "), " ")


@dataclass
class Model:
    """languages; for each order the sorted grams with their costs, the sorted contexts with the costs of leaving."""

    languages: list[str]
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    leave: list[np.ndarray]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Model:
        languages = sorted(texts)
        counts: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
        for language in languages:
            words = pc.value_counts(split_words(pa.array(texts[language], pa.string())).flatten())
            data, begins, ends = _bytes(words.field(0))
            weight = words.field(1).to_numpy()
            keys, context, word = _grams(data, begins, ends)
            for k in range(ORDER + 1):
                has = context >= k
                gram, back = np.unique(keys[k][has], return_inverse=True)
                n = np.bincount(back, weights=weight[word[has]], minlength=len(gram))
                ctx, back = np.unique(gram >> np.uint64(8), return_inverse=True)
                total, different = np.bincount(back, weights=n, minlength=len(ctx)), np.bincount(back, minlength=len(ctx))
                counts[k].append((gram, np.log2((total + different)[back] / n), ctx, np.log2((total + different) / different)))
        model = cls(languages, [], [], [], [])
        for k in range(ORDER + 1):
            gram = np.unique(np.concatenate([c[0] for c in counts[k]]))
            ctx = np.unique(np.concatenate([c[2] for c in counts[k]]))
            leave = np.zeros((len(ctx), len(languages)))
            for i, c in enumerate(counts[k]):
                leave[np.searchsorted(ctx, c[2]), i] = c[3]
            shorter = np.full((len(gram), len(languages)), 8.0)
            if k:
                mask = np.uint64((1 << (8 * k)) - 1)
                shorter = model.costs[k - 1][np.searchsorted(model.grams[k - 1], gram & mask)].astype(float)
            cost = shorter + leave[np.searchsorted(ctx, gram >> np.uint64(8))]
            for i, c in enumerate(counts[k]):
                cost[np.searchsorted(gram, c[0]), i] = c[1]
            for part, value in ((model.grams, gram), (model.costs, cost), (model.contexts, ctx), (model.leave, leave)):
                part.append(value)
        return model

    def word_costs(self, words: pa.StringArray) -> np.ndarray:
        """Bits of each of these words under each language."""
        data, begins, ends = _bytes(words)
        keys, context, word = _grams(data, begins, ends)
        bits = np.zeros((len(word), len(self.languages)))
        left = np.arange(len(word))
        for k in range(ORDER, -1, -1):
            own = left[context[left] >= k]
            key = keys[k][own]
            at = np.minimum(np.searchsorted(self.grams[k], key), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == key
            bits[own[hit]] += self.costs[k][at[hit]]
            miss, ctx = own[~hit], key[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == ctx
            bits[miss[seen]] += self.leave[k][at[seen]]
            left = np.concatenate([left[context[left] < k], miss])
        bits[left] += 8.0
        return np.add.reduceat(bits, begins - np.arange(len(begins)), axis=0)


class Scorer:
    """A model with the costs of the words seen last."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.table, self.bits = tokens.WordTable(max(4, len(self.model.languages))), np.zeros((0, len(self.model.languages)))

    def costs(self, words: pa.StringArray) -> np.ndarray:
        """Bits of each of these different words under each language."""
        texts = words.to_numpy(zero_copy_only=False)
        number = self.table.find(texts)
        new = np.flatnonzero(number < 0)
        if len(new):
            sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
            if self.table.full(len(new), int(sizes[new].sum())):
                self._clear()
                new = np.arange(len(texts))
            at = number[new] = self.table.add(texts[new], int(sizes[new].sum()))
            if at[-1] >= len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros((at[-1] + len(at) + 1 - len(self.bits), len(self.model.languages)))])
            self.bits[at] = self.model.word_costs(words.take(pa.array(new)))
        return self.bits[number]

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The label and its probability, all labels alike beforehand, of each text."""
        labels, scores, lo = [], [], 0
        texts = pc.fill_null(texts.cast(pa.string()), "")
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _BATCH_BYTES)))
            split = split_words(texts.slice(lo, hi - lo))
            coded = split.flatten().dictionary_encode()
            each = self.costs(coded.dictionary)[coded.indices.to_numpy()]
            total = np.add.reduceat(each, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), axis=0)
            best = total.argmin(axis=1)
            odds = np.exp2(np.maximum(total[np.arange(len(best)), best][:, None] - total, -1000.0)).sum(axis=1)
            labels.append(best)
            scores.append(1 / odds)
            memory.after(int(upto[hi - 1] - (upto[lo - 1] if lo else 0)))
            lo = hi
        if not labels:
            return pa.array([], pa.string()), np.zeros(0)
        best, score = np.concatenate(labels), np.concatenate(scores)
        named = pa.array(self.model.languages, pa.string()).take(pa.array(best))
        return pc.if_else(pa.array(letters), named, UND), np.where(letters, score, 0.0)


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of a model, kept from task to task."""
    return memory.kept(("language", model.token), lambda: Scorer(model))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, learn_from: Column | None = None, *, train_bytes: int = TRAIN_BYTES, total_bytes: int = TOTAL_BYTES) -> Model | None:
    """A model of docs (doc_id, text, lang); None where no labelled text can be learned from."""
    usable = shared.columns(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & (~held_out() if learn_from is None else learn_from))
    short, order = F.octet_length("text") <= MAX_DOC_BYTES, F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.sum(F.when(short, F.octet_length("text")).otherwise(0)).alias("n")).collect()}
    if not sizes:
        return None
    share = min(train_bytes, total_bytes // len(sizes))
    rate = F.lit(0.0)
    for language, n in sizes.items():
        rate = F.when(F.col("lang") == language, F.lit(min(1.0, share / max(n, 1)))).otherwise(rate)
    drawn = usable.where(short & (order < rate * float(1 << 30))).select("lang", "text").distinct()
    texts: dict[str, list[str]] = {}
    for row in drawn.collect():  # about total_bytes
        texts.setdefault(row["lang"], []).append(row["text"])
    missing = [language for language in sizes if language not in texts]
    if missing:
        # four bytes a character at most
        piece = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max(min(share, MAX_DOC_BYTES) // 4, 64) - 1}}}", 0)
        first = usable.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct((~short).alias("long"), order.alias("order"), piece.alias("piece"))).alias("first"))
        for row in first.collect():
            texts[row["lang"]] = [row["first"]["piece"]]
    return Model.fit({k: sorted(v) for k, v in texts.items()})


def predicted(spark: SparkSession, model: Model | None):
    """A function from a text column to struct<lang_pred: string, score: double>."""
    if model is None:
        return lambda text: F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(model)  # its size is bounded by the training sample

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        labels, scores = _scorer(held.value).predict(text)
        return pa.StructArray.from_arrays([labels, pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    model = train(docs)
    rows = shared.columns(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), predicted(spark, model)(F.col("text")).alias("r"))
    return rows.select("doc_id", "held_out", F.col("r.lang_pred").alias("lang_pred"), F.col("r.score").alias("score"))
