"""Exact global ranks without a window over the whole table.

Rows are range-partitioned by their order, sorted inside their partitions and numbered there; a row's rank is its place
plus the rows of the partitions before, of which the driver sees one count each. What is numbered is cut off with
checkpoint(), so bounds that were sampled once hold for the counts and the ranks alike, also after a lost executor; its
files are left to Spark's cleaner.

Rows equal in every order column are told apart by no rank that can be relied on: end the order with a key."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read from there; only a local master may lack that setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="latticebits-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def _placed(df: DataFrame, *order: str | Column) -> DataFrame:
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("__place", 33)


def _before(rows: list, column: str, zero) -> tuple[Column, int | float]:
    """What the partitions before a row's own hold, by partition number, and what all hold."""
    own = {r["part"]: r[column] for r in rows}
    sums = list(accumulate((own.get(k, zero) for k in range(max(own, default=-1) + 1)), initial=zero))
    return F.element_at(F.array(*[F.lit(x) for x in sums]), _part().cast("int") + 1), sums[-1]


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> tuple[DataFrame, int]:
    """df with its rank from 1 in this order (a bigint column of this name), and the number of rows."""
    placed = _placed(df, *order)
    before, n = _before(placed.groupBy(_part().alias("part")).count().collect(), "count", 0)  # a row a partition
    rank = before + F.col("__place").bitwiseAND(F.lit(_LOW)) + 1
    return placed.withColumn(name, rank.cast("bigint")).drop("__place"), n


def running_sums(df: DataFrame, *order: str | Column, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """df with the sums of each of these columns up to and with a row, in this order (doubles), and the whole sums.

    Each partition adds up its own rows; the driver sees its sums, a row a partition."""
    placed = _placed(df, *order)
    upto = Window.partitionBy(_part()).orderBy("__place")
    rows = placed.groupBy(_part().alias("part")).agg(*[F.sum(c.cast("double")).alias(n) for n, c in sums.items()]).collect()
    before = {n: _before(rows, n, 0.0) for n in sums}
    return placed.withColumns({n: F.sum(c.cast("double")).over(upto) + before[n][0] for n, c in sums.items()}).drop("__place"), {n: total for n, (_, total) in before.items()}
