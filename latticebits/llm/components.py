"""Connected components of an edge table by contraction, each round a written table.

In a round every vertex takes the least of its neighbours and itself, follows that one's choice once, and edges are made
anew between what their ends chose; loops and repeats go. So the edges that a round reads are what earlier rounds could
not yet join, and few rounds read many.

Defined results: loops, repeated edges and either direction are allowed; edges with a null end join nothing and go; a
node of loops only is a component of its own; no edges give no rows; columns other than u and v are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v), comp the least node that it reaches. Loops and repeats are allowed."""
    edges = edges.select("u", "v").dropna()
    left = shared.written(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "cc-edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    left = left.where("a <> b")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("vertex"), F.col("b").alias("near")), F.struct(F.col("b").alias("vertex"), F.col("a").alias("near")))).alias("e")).select("e.*")
        chosen = shared.written(ends.groupBy("vertex").agg(F.least(F.min("near"), F.col("vertex")).alias("choice")), "cc-choices")
        onward = chosen.select(F.col("vertex").alias("choice"), F.col("choice").alias("next"))
        to = shared.written(chosen.join(onward, "choice").select("vertex", F.col("next").alias("to")), "cc-to")
        labels = shared.written(labels.join(to, F.col("comp") == F.col("vertex"), "left").select("node", F.coalesce("to", "comp").alias("comp")), "cc-labels")
        moved = left.join(to.select(F.col("vertex").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("vertex").alias("b"), F.col("to").alias("y")), "b")
        left = shared.written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return labels
