"""Benchmark decontamination: a broadcast hash set of normalised item windows (DataFrame functions only).

Words: A-Z are lower-cased, then the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` are taken. An item gives its
windows of `size` words, or itself as one window if it is shorter. Every window of a document is hashed in its row;
the hashes meet the broadcast set in a hash join, and what matches is verified word by word before it counts.

The set is broadcast while it has at most MAX_BROADCAST windows and MAX_BROADCAST_BYTES of them and their item lists.
Beyond, hashes alone are shuffled (row, place and hash of each window), and the words are fetched for rows that met one.

Defined results: null or wordless texts have no words and no hits; an item of no words gives no window; items of
null item_id mark hits but are neither counted nor listed; repeated items count once; rows with one doc_id are
documents of their own; empty tables give no rows or no hits; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import shared

SIZE = 10
MAX_BROADCAST, MAX_BROADCAST_BYTES = 500_000, 128 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text, an empty array for null. lower() does the same as translate() on pure ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP), "")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, n: Column, size: int) -> Column:
    """The hash of each window of `size` words, in order; empty where there are fewer words."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(len, hash, gram, items): each different window with the items that have it."""
    items = shared.columns(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("ws")).withColumn("n", F.size("ws")).where("n > 0").withColumn("len", F.least("n", F.lit(size)))
    each = items.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1), lambda i: F.slice("ws", i, F.col("len")))).alias("win"))
    return each.groupBy("len", F.xxhash64(word_hashes(F.col("win"))).alias("hash"), F.array_join("win", " ").alias("gram")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of docs: row_id, doc_id, n_words, hit_words (sorted positions from 1), items (sorted)."""
    spark = docs.sparkSession
    windows = shared.written(item_windows(benchmark, size), "benchmark-windows")
    lengths = sorted((r[0] for r in windows.select("len").distinct().collect()), reverse=True)  # at most `size` values
    base = shared.columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words(F.col("text")).alias("ws"))
    base = base.select("row_id", "doc_id", "ws", F.size("ws").alias("n_words"))
    n = F.col("n_words")
    # the windows of each length, one length after another, and a last entry that keeps every document (so the outer
    # form drops nothing, and no filter on the size of the array is made, which would compute it twice); the lambda
    # binds the word hashes, which the optimiser would else compute anew for each window
    every = F.transform(F.array(word_hashes(F.col("ws"))), lambda hs: F.concat(*[window_hashes(hs, n, k) for k in lengths], F.array(F.lit(None).cast("long"))))[0]
    counts = {k: F.greatest(n - (k - 1), F.lit(0)) for k in lengths}
    total = sum(counts.values(), F.lit(0))
    size_of = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram") + F.octet_length(F.array_join("items", ",")) + 64), F.lit(0)).alias("bytes")).first()
    if size_of["n"] <= MAX_BROADCAST and size_of["bytes"] <= MAX_BROADCAST_BYTES:
        entries = base.select("row_id", "doc_id", "ws", "n_words", every.alias("every")).select("row_id", "doc_id", "ws", "n_words", F.posexplode_outer("every").alias("pos", "h"))
        met = entries.join(F.broadcast(windows), F.col("h") == F.col("hash"), "left")
        met = met.where(F.col("hash").isNotNull() | (F.col("pos") == total))
    else:
        base = shared.written(base, "decontamination-words")
        entries = base.select("row_id", every.alias("every")).select("row_id", F.posexplode("every").alias("pos", "h"))
        found = entries.where("h IS NOT NULL").join(windows, F.col("h") == F.col("hash")).select("row_id", "pos", "len", "gram", "items")
        met = base.join(found, "row_id", "left")
    start, before = F.lit(None).cast("int"), F.lit(0)
    for k in lengths:
        start = F.when(F.col("len") == k, F.col("pos") - before + 1).otherwise(start)
        before = before + counts[k]
    met = met.select("row_id", "doc_id", "n_words", "gram", "items", "len", start.alias("start"), "ws")
    true = F.col("gram") == F.array_join(F.slice("ws", F.coalesce("start", F.lit(1)), F.coalesce("len", F.lit(0))), " ")
    met = met.select("row_id", "doc_id", "n_words", F.when(true, F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at"), F.when(true, F.col("items")).alias("items"))
    return met.groupBy("row_id", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def digest(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    n_hit = F.size("hit_words").cast("long")
    return scan(docs, benchmark, size).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay."""
    text = lambda d: F.xxhash64(F.coalesce(d["text"], F.lit("")))
    tagged = docs.select("doc_id", "text")
    hit = scan(tagged.withColumn("doc_id", F.struct("doc_id", text(docs).alias("t"))), benchmark, size).where(F.size("hit_words") > 0).select(F.col("doc_id.doc_id").alias("_hit_id"), F.col("doc_id.t").alias("_hit_text")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (text(docs) == hit["_hit_text"]), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(shared.documents(spark, sf_dir), shared.table(spark, sf_dir, "benchmark"))


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, l, array_to_string(w[s:s + l - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), {SIZE}) AS l, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
pos AS (SELECT rid, l, s, array_to_string(w[s:s + l - 1], ' ') AS g
        FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT rid, s, win.l AS l, item FROM pos JOIN win ON pos.g = win.g AND pos.l = win.l),
hits AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + l)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
