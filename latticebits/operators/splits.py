"""Node-disjoint spatial splits, rank windows and exact hash permutations.

Nodes are cut by their exact rank along an axis, which range partitions number together (see ranking.py); a permutation
is cut at the value of a hash, which sketches bracket (see selection.py). No task meets more than its partition. Pairs
get their nodes' parts by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticebits.operators import graph, selection
from latticebits.operators.ranking import ranked


def slabs(nodes: DataFrame, n_splits: int = 5, axis: str = "x") -> DataFrame:
    """nodes with `slab` 0..n-1: contiguous along the axis, the first ones a node larger where sizes don't divide; ties by id."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    rows, n = ranked(nodes, axis, "id", name="__rank")
    size, more = divmod(n, n_splits)
    at = F.col("__rank") - 1
    div = lambda x, y: F.call_function("div", x, F.lit(max(1, y)))
    slab = F.when(at < more * (size + 1), div(at, size + 1)).otherwise(more + div(at - more * (size + 1), size))
    return rows.withColumn("slab", slab.cast("int")).drop("__rank")


def rank_cuts(n: int, train: float = 0.7, validation: float = 0.85) -> tuple[int, int]:
    """Where train and validation end among n ranks; halves round to even, and each part has a node."""
    if n < 3:
        raise ValueError("three nodes at least are needed")
    first = max(1, min(n - 2, round(train * n)))
    return first, max(first + 1, min(n - 1, round(validation * n)))


def axis_split(nodes: DataFrame, axis: str = "x", train: float = 0.7, validation: float = 0.85) -> DataFrame:
    """nodes with `part` train, validation or test by rank along the axis."""
    rows, n = ranked(nodes, axis, "id", name="__rank")
    first, second = rank_cuts(n, train, validation)
    rank = F.col("__rank")
    return rows.withColumn("part", F.when(rank <= first, "train").when(rank <= second, "validation").otherwise("test")).drop("__rank")


def central_window(nodes: DataFrame, count: int, axis: str = "x") -> DataFrame:
    """The `count` middle nodes along the axis, in (axis, id) order."""
    rows, n = ranked(nodes, axis, "id", name="__rank")
    if not 0 < count <= n:
        raise ValueError(f"{count} of {n} nodes were asked for")
    start = (n - count) // 2
    return rows.where(F.col("__rank").between(start + 1, start + count)).drop("__rank")


def with_parts(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """pairs with the node column of both ends, as s_<column> and t_<column>."""
    of = nodes.select("id", column)
    hint = F.broadcast if graph.is_small(of) else lambda df: df
    s = hint(of.select(F.col("id").alias("source"), F.col(column).alias(f"s_{column}")))
    t = hint(of.select(F.col("id").alias("target"), F.col(column).alias(f"t_{column}")))
    return pairs.join(s, "source").join(t, "target")


def within_parts(pairs: DataFrame, column: str) -> DataFrame:
    """Pairs whose ends share a part, which becomes `<column>`; pairs across parts go."""
    return pairs.where(F.col(f"s_{column}") == F.col(f"t_{column}")).withColumn(column, F.col(f"s_{column}"))


def among(column: str, values: list) -> Column:
    """Both ends in these parts, pairs across them included."""
    return F.col(f"s_{column}").isin(*values) & F.col(f"t_{column}").isin(*values)


def slab_positives(pairs: DataFrame, n_splits: int = 5) -> DataFrame:
    """(slab, pairs, positives, enough) for every slab, also those without pairs."""
    inside = within_parts(pairs, "slab").groupBy("slab").agg(F.count("*").alias("pairs"), F.sum(F.col("connected").cast("bigint")).alias("positives"))
    return _every_slab(inside, n_splits)


def slab_rows(between: DataFrame, n_splits: int = 5) -> DataFrame:
    """slab_positives() from the pairs and edges between slabs (s_slab, t_slab, n, k)."""
    return _every_slab(between.where("s_slab = t_slab").select(F.col("s_slab").alias("slab"), F.col("n").alias("pairs"), F.col("k").alias("positives")), n_splits)


def _every_slab(inside: DataFrame, n_splits: int) -> DataFrame:
    every = inside.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("slab"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return every.join(inside, "slab", "left").select("slab", zero("pairs"), zero("positives")).withColumn("enough", F.col("positives") > 0)


def require_slab_positives(pairs: DataFrame, n_splits: int = 5) -> list[dict]:
    rows = [r.asDict() for r in slab_positives(pairs, n_splits).orderBy("slab").collect()]
    for row in rows:
        if not row["enough"]:
            raise ValueError(f"slab {row['slab']} has no positive pair")
    return rows


def permutation_split(df: DataFrame, keys: list[str], fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """df with `part` train or test: exactly round(n*(1-fraction)) rows are train, by a seeded hash of the keys (the MD5
    of the seed and the keys as text, which any engine gives alike).

    The cut is a value of the hash's first 52 bits, found between sketched bounds; rows of that value are ranked by the
    whole hash and the keys. Of rows with the same keys any may be on either side, as many as needed."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    value = F.conv(F.substring(code, 1, 13), 16, 10).cast("double")
    split = selection.with_first(df, value, [code, *keys], lambda n: round(n * (1 - fraction)), "__train")
    return split.withColumn("part", F.when(F.col("__train"), "train").otherwise("test")).drop("__train")
