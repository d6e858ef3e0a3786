"""A training corpus from documents: language, near duplicates, benchmark passages, personal data, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, also extra ones, whatever their names. run() writes each stage's rows as a table in the shared folder,
hands the next one that table; all but the last are removed at the end.

- language: documents in which no language is found (null, or without a letter) go, also where no label can be learned;
  repeated rows stay or go alike.
- near duplicates: of each class at a Jaccard similarity of 0.8 over five words the document of the least doc_id stays
  (null last; of equal ids, repeated rows too, one row); documents without words stay.
- decontamination: documents that hold ten words in a row of a benchmark item (or a whole shorter item) go, all rows of
  that doc_id and text; null texts stay.
- personal data: spans are replaced by their kind; n_chars, where there is such a column, is counted anew; null stays null.
- packing: pieces of token sequences of at most 4096; null counts as empty; rows of one doc_id are packed each for itself.

An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import decontaminate, language, minhash, packing, pii, shared


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    if model is None:  # no labelled text to tell languages by: none is turned away for that
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = language.predicted(spark, model)
    return docs.where(predict(F.col("text"))["lang_pred"] != language.UND)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", pii.redacted(pii.train(docs))(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage but the third has an SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    with shared.scratch(spark):
        for name, stage in STAGES:
            docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}", result=name == STAGES[-1][0])
    return docs
