"""Sharding by a Feistel permutation over global row numbers (DataFrame functions only).

Rows are numbered from 0 in the order of (doc_id, CRC-32 of the text, size). The permutation works on pairs (l, r)
with l below a and r below b, a*b the least such product of a near-square at or above the row count: rounds add a
keyed function of one half to the other, modulo its range. Numbers that leave the row range walk on along their
cycle until they are back in it. The result p gives shard p mod n and slot p div n, so counts differ by one at most,
slots have no gaps, and both can be computed from the row number and the seed alone; `row_of` inverts them.

Defined results: null text has size 1 and CRC 0; null doc_id is numbered first; rows with one doc_id, also wholly
equal ones, get numbers of their own (which of equal rows gets which is not told apart by any column); an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticebits.llm import shared

ROUNDS = 6
#: Steps along a cycle before an error is raised. Walks of w steps have odds below rows**(-w/2).
WALK = 64
_LOW = (1 << 33) - 1


def keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round, from a 64-bit mixer."""
    out, x = [], seed & (2**64 - 1)
    for _ in range(2 * ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(z ^ (z >> 31))
    return [(out[2 * i] >> 25 | 1, out[2 * i + 1] >> 5) for i in range(ROUNDS)]


def halves(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(i: int, n: int, seed: int) -> int:
    """Where row i of n goes: the same arithmetic as the column expression, for lookups and tests."""
    a, b = halves(n)
    while True:
        left, right = divmod(i, b)
        for k, (mul, add) in enumerate(keys(seed)):
            if k % 2:
                right = (right + ((left * mul + add) >> 17)) % b
            else:
                left = (left + ((right * mul + add) >> 17)) % a
        i = left * b + right
        if i < n:
            return i


def row_of(shard: int, slot: int, n_shards: int, n: int, seed: int) -> int:
    """The row number at a slot of a shard."""
    i, (a, b) = slot * n_shards + shard, halves(n)
    while True:
        left, right = divmod(i, b)
        for k, (mul, add) in reversed(list(enumerate(keys(seed)))):
            if k % 2:
                right = (right - ((left * mul + add) >> 17)) % b
            else:
                left = (left - ((right * mul + add) >> 17)) % a
        i = left * b + right
        if i < n:
            return i


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _once(i: Column, n: int, seed: int) -> Column:
    a, b = halves(n)
    left, right = _div(i, F.lit(b)), i % F.lit(b)
    for k, (mul, add) in enumerate(keys(seed)):
        if k % 2:
            right = (right + F.shiftright(left * F.lit(mul) + F.lit(add), 17)) % F.lit(b)
        else:
            left = (left + F.shiftright(right * F.lit(mul) + F.lit(add), 17)) % F.lit(a)
    return left * F.lit(b) + right


def permuted(i: Column, n: int, seed: int) -> Column:
    """The permutation of row numbers below n as a column. n must be below 2**44."""
    if n >= 1 << 44:
        raise ValueError("row numbers must stay below 2**44")
    a, b = halves(n)
    steps = min(WALK, a * b - n)
    first = _once(i, n, seed)
    if not steps:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda p, _: F.when(p < n, p).otherwise(_once(p, n, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


SEED = 20240501


def shard(docs: DataFrame, n_shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of every row.

    Broadcast: one row per partition of the numbered table, so at most the number of shuffle partitions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = shared.columns(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = [shared.null_first("doc_id"), F.col("text_crc32"), F.col("size")]
    numbered = shared.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    n = numbered.count()
    part = F.shiftright("rid", 33)
    totals = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    row = (F.col("base") + F.col("rid").bitwiseAND(F.lit(_LOW))).alias("row_number")
    placed = numbered.join(F.broadcast(base), part == F.col("part")).select("doc_id", "size", "text_crc32", row).withColumn("p", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % n_shards).cast("int").alias("shard"),
        _div(F.col("p"), F.lit(n_shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(shared.documents(spark, sf_dir))


def _once_sql(p: str, source: str) -> str:
    """The permutation once, of column p of a table with row_number, n, a and b, as nested subqueries."""
    out = f"SELECT row_number, n, a, b, {p} // b AS l, {p} % b AS r FROM {source}"
    for k, (mul, add) in enumerate(keys(SEED)):
        change = f"l, (r + ((l * {mul} + {add}) >> 17)) % b AS r" if k % 2 else f"(l + ((r * {mul} + {add}) >> 17)) % a AS l, r"
        out = f"SELECT row_number, n, a, b, {change} FROM ({out})"
    return f"SELECT row_number, n, a, b, l * b + r AS p FROM ({out})"


ORACLE_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, len(h) // 2 + 1 AS size, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS n FROM s),
z AS MATERIALIZED (SELECT row_number, n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT row_number, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM q)),
w AS ({_once_sql("row_number", "z")} UNION ALL {_once_sql("p", "w WHERE p >= n")})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard, CAST(p // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(q.row_number AS BIGINT) AS row_number
FROM q JOIN w ON q.row_number = w.row_number WHERE p < w.n
"""
