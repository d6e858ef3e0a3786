"""A synthetic pair table: uniform places, random types, pairs drawn with replacement, a logistic edge rule.

Every draw is a hash of the seed and the row's number, so the table is the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.functions.columns import length3, sigmoid

#: Coefficients of the edge rule. Fixed values.
INTERCEPT, SLOPE = -2.4, -5.0
SAME_TYPE, OTHER_TYPE, DIRECTION = 1.2, -0.35, 0.25


def uniform(seed: int, key: Column, draw: int) -> Column:
    """In [0, 1), 53 bits."""
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(draw)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pairs(spark: SparkSession, *, n_nodes: int = 500, n_pairs: int = 40_000, n_types: int = 4, seed: int = 7) -> DataFrame:
    if n_nodes < 2 or n_pairs < 1 or n_types < 1:
        raise ValueError("two nodes, one pair and one type at least are needed")
    rows = spark.range(n_pairs).withColumnRenamed("id", "pair_id")
    source = F.floor(uniform(seed, F.col("pair_id"), 11) * n_nodes)
    other = F.floor(uniform(seed, F.col("pair_id"), 12) * (n_nodes - 1))  # skips the source, so no pair is a loop
    rows = rows.select("pair_id", source.alias("source"), other.alias("o")).select("pair_id", "source", F.when(F.col("o") >= F.col("source"), F.col("o") + 1).otherwise(F.col("o")).alias("target"))
    for end, axis in (("source", "s"), ("target", "t")):
        key = F.col(end)
        rows = rows.withColumns({f"{axis}{c}": uniform(seed, key, k) for k, c in enumerate("xyz", 1)} | {f"{end}_type": F.floor(uniform(seed, key, 4) * n_types)})
    affinity = F.when(F.col("source_type") == F.col("target_type"), SAME_TYPE).otherwise(OTHER_TYPE)
    direction = F.lit(DIRECTION) * (F.col("source_type") - F.col("target_type")) / max(1, n_types - 1)
    d = length3(*[F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"])
    rows = rows.withColumn("distance", d)
    z = F.lit(INTERCEPT) + SLOPE * F.col("distance") + affinity + direction
    connected = (uniform(seed, F.col("pair_id"), 13) < sigmoid(z)).cast("int")
    return rows.select("pair_id", "source", "target", *[F.col(f"{e}_type").cast("string").alias(f"{e}_type") for e in ("source", "target")], "distance", connected.alias("connected"), "sx", "sy", "sz", "tx", "ty", "tz")
