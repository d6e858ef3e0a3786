"""Audit of filters that are applied one after the other, in every order (DataFrame functions only).

Each text is judged once: a mask has a bit for every filter that it fails. Rows come down to cells (part, mask, good,
toxic, documents), of which there are at most 128 a part, and only these are unpivoted against the steps of all orders.
In this long form a running bit-or over the steps before tells what an earlier filter would have removed; conditional
sums give each step's metrics, and a window over part and filter adds up what a filter removes in all orders.

Rows with one text are counted by the SHA-256 of the text, so the shuffles hold digests and no texts. First come rows
of one doc_id (a key that spreads, whatever the texts), then minima by digest, both added up before they are shuffled.

Defined results: null text counts as empty, null lang as the empty string; a row fails E where a smaller doc_id has its
text, so equal ids don't make each other fail, and a null doc_id neither fails E nor makes others fail; a document is
good (toxic) if any label row of its doc_id has quality (toxic) 1, null or missing labels are neither; repeated rows
count each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticebits.llm import shared

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D that a text without nulls fails."""

    def judged(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.struct((n < LEAST_WORDS).alias("a"), (F.lit(100) * distinct < F.lit(LEAST_DISTINCT) * n).alias("b"))

    # a lambda's argument is computed once, however often it is used
    of_words = F.transform(F.array(F.array_remove(F.split(text, SPACE), "")), judged)[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [of_words["a"], of_words["b"], F.lit(100) * capitals > F.lit(MOST_CAPITALS) * F.length(text), text.rlike(SYMBOLS)]
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part by what they fail and how they are labelled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = shared.columns(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    each = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = shared.columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality"), yes("toxic")).where("quality OR toxic")
    # rows without an id have no label: they needn't meet in one task
    known = each.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select(*each.columns, F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    marked = known.unionByName(each.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    # of each digest, part and label: all rows, those with an id, its least id and the rows that have it
    alike = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    repeats = F.col("with_id") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = alike.withColumn("first", first).withColumn("repeats", repeats)
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("repeats")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("repeats").alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audited(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, filter and the metrics, for every order of the filters; mask's bits are in their order."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = F.posexplode(F.split("filter_order", "")).alias("at", "filter")
    own = F.element_at(F.create_map(*[x for k, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << k))]), F.col("filter"))
    long = cells.select("*", F.explode(orders).alias("filter_order")).select("*", steps).withColumn("own", own).withColumn("fails", F.col("mask").bitwiseAND(F.col("own")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") > 0, F.col("earlier") > 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    metrics = seen.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter").agg(
        total(~fails & ~gone)("kept"),
        total(fails & ~gone)("removed"),
        total(fails & gone)("redundant"),
        total(F.col("mask") == F.col("own"))("unique_fails"),
        total(fails & ~gone & F.col("good"))("good_lost"),
        total(fails & ~gone & F.col("toxic"))("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(cells(shared.documents(spark, sf_dir), shared.table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(w.doc_id > first, false) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, own)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.own + b.own + c.own + d.own + e.own = 31 AND (a.own | b.own | c.own | d.own | e.own) = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, name AS filter, own, CAST((SELECT coalesce(sum(own), 0) FROM f WHERE strpos(filter_order, f.name) < step) AS INTEGER) AS before
      FROM o, range(1, 6) r(step) JOIN f ON substring(filter_order, step, 1) = f.name),
x AS (SELECT part, filter_order, step, filter, count(*) FILTER (WHERE mask & (own | before) = 0) AS kept, count(*) FILTER (WHERE mask & own > 0 AND mask & before = 0) AS removed,
      count(*) FILTER (WHERE mask & own > 0 AND mask & before > 0) AS redundant, count(*) FILTER (WHERE mask = own) AS unique_fails,
      count(*) FILTER (WHERE mask & own > 0 AND mask & before = 0 AND good = 1) AS good_lost, count(*) FILTER (WHERE mask & own > 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM x
"""
