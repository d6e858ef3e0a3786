"""Table profiles and object listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import is_finite
from latticebits.operators import graph
from latticebits.operators.ranking import ranked

MAX_LABELS = 50


def column_values(df: DataFrame) -> DataFrame:
    """(k, value, n): how often column k of df (a column that is no list or structure) has a value, as text; null too.

    One pass: tasks count the different values of each column of a batch, so what is shuffled of a column of few values
    is few rows, and no row is written once a column."""
    text = lambda n, t: F.hex(F.col(f"`{n}`")) if t == "binary" else F.col(f"`{n}`").cast("double").cast("string") if t == "float" else F.col(f"`{n}`").cast("string")
    rows = df.select(*[text(n, t).alias(f"c{k}") for k, (n, t) in enumerate(plain_columns(df))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, column in enumerate(batch.columns):
                values = pc.value_counts(column)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), values.field(0).cast(pa.string()), values.field(1)], ["k", "value", "n"])

    return rows.mapInArrow(count, "k int, value string, n long").groupBy("k", "value").agg(F.sum("n").alias("n"))


def plain_columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(n, t) for n, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))]


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, non_null, distinct, finite, min, max) of every plain column, from its values' counts."""
    plain = plain_columns(df)
    names = df.sparkSession.createDataFrame([(k, n, t) for k, (n, t) in enumerate(plain)], "k int, column string, type string")
    if not plain:
        return names.select("column", "type", *[F.lit(0).cast("bigint").alias(c) for c in ("nulls", "non_null", "distinct", "finite")], *[F.lit(None).cast("double").alias(c) for c in ("min", "max")])
    numbers = [k for k, (_, t) in enumerate(plain) if t not in ("date", "timestamp", "timestamp_ntz", "binary", "boolean")]
    x = F.when(F.col("k").isin(*numbers), F.col("value").try_cast("double")) if numbers else F.lit(None).cast("double")
    finite = F.when(is_finite(x), x)
    has = F.col("value").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    # zero and minus zero are one double
    twice = F.count_if(F.col("value") == "-0.0") + F.count_if(F.col("value") == "0.0") - 1
    both = F.when(F.col("k").isin(*[k for k, (_, t) in enumerate(plain) if t in ("double", "float")]), F.greatest(twice, F.lit(0))).otherwise(0)
    sums = column_values(df).groupBy("k").agg(F.sum(F.when(~has, F.col("n"))).alias("nulls"), F.sum(F.when(has, F.col("n"))).alias("non_null"), (F.count("value") - both).alias("distinct"), F.sum(F.when(finite.isNotNull(), F.col("n"))).alias("finite"), F.min(finite).alias("min"), F.max(finite).alias("max"))
    return names.join(sums, "k", "left").select("column", "type", *[zero(F.col(c)).alias(c) for c in ("nulls", "non_null", "distinct", "finite")], "min", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, rows), null as <NA>."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NA>")).alias("value")).agg(F.count("*").alias("rows"))


def with_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """df with numbers from 0 for the values of a column of labels, in their order; null has none."""
    labels, _ = ranked(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=code)
    codes = labels.withColumn(code, (F.col(code) - 1).cast("int"))
    return df.join(graph.small(codes), column, "left")


def label_counts(df: DataFrame, column: str, limit: int = MAX_LABELS) -> DataFrame | None:
    """value_counts of a column with at most `limit` different values, else None: too many to be labels."""
    return value_counts(df, column) if df.select(column).distinct().limit(limit + 1).count() <= limit else None


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    """(repeated_ids, rows)."""
    many = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return many.agg(F.count("*").alias("repeated_ids"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def object_summary(listing: DataFrame, prefix: str) -> DataFrame:
    """(objects, bytes, smallest, largest) of listing (name, size) under a prefix; sizes may be text."""
    size = F.col("size").cast("bigint")
    return listing.where(F.col("name").startswith(prefix)).agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"))
