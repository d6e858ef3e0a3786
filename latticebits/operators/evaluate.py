"""Held-out code length of the transparent models, as rows and as one lazy plan."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import bin_of, code_length, per_positive, per_sample, smoothed_rate
from latticebits.operators import models, ranking
from latticebits.operators.tiles import Tiles

MODELS = ("global", "distance", "type_pair", "type_distance")
RESULT = "model string, test_pairs bigint, positives bigint, residual_bits double, model_bits bigint, two_part_bits double, bits_per_pair double, bits_per_positive double"


def score(pairs: DataFrame) -> dict:
    """Pairs, positives and bits of pairs with `p`, in one pass."""
    return pairs.agg(F.count("*").alias("pairs"), F.sum(F.col("connected").cast("bigint")).alias("positives"), F.sum(code_length(F.col("connected"), F.col("p"))).alias("bits")).first().asDict()


def evaluate_fitted(model, test: DataFrame) -> dict:
    got = score(model.predict(test))
    return {"model": model.name, "residual_bits": got["bits"], "model_bits": model.model_bits, "two_part_bits": got["bits"] + model.model_bits, "test_pairs": got["pairs"], "positives": got["positives"]}


def model_comparison(pairs: DataFrame, train: Column, test: Column, bins: int = 12) -> DataFrame:
    """One row per transparent model: fitted where `train` holds, scored where `test` holds.

    A pair's code length depends on its types, its distance bin and its label alone. So one grouped pass over the pairs
    counts rows and edges of every (types, bin) on both sides; rates, roll-ups and bits come from these counts. Before it
    stand the passes for the exact edges of the bins, over the distances of the training pairs."""
    rows = pairs.select(train.alias("is_train"), test.alias("is_test"), "source_type", "target_type", "distance", F.col("connected").cast("bigint").alias("y")).where("is_train OR is_test").persist()
    try:
        edges = models.exact_quantiles(rows.where("is_train"), "distance", [i / bins for i in range(bins + 1)])
        interior = F.array(*[F.lit(e) for e in edges[1:-1]]) if edges else F.array().cast("array<double>")
        sums = [F.coalesce(F.sum(F.when(side, v)), F.lit(0)).alias(n) for n, side, v in (("n", F.col("is_train"), F.lit(1)), ("k", F.col("is_train"), F.col("y")), ("test_n", F.col("is_test"), F.lit(1)), ("test_k", F.col("is_test"), F.col("y")))]
        keys = ["source_type", "target_type", "bin"]
        counts = rows.withColumn("bin", bin_of(F.col("distance"), interior)).groupBy(*keys).agg(*sums)
        counts = ranking.checkpointed(counts)  # as many rows as types squared times bins
    finally:
        rows.unpersist()
    return of_counts(counts, bins)


def node_comparison(tiles: Tiles, train: frozenset[int], test: frozenset[int], bins: int = 12) -> DataFrame:
    """model_comparison over the pairs of tiled nodes, with both ends in slabs of train, and of test.

    Tasks count their tiles' pairs by types and bin; only these counts, histograms of distances, and the distances around
    the bins' edges ever leave them."""
    with tiles.kept() as kept:
        edges = kept.quantiles([i / bins for i in range(bins + 1)], train)
        counts = ranking.checkpointed(kept.binned(edges[1:-1] if edges else [], train, test))
    return of_counts(counts, bins)


def of_counts(counts: DataFrame, bins: int) -> DataFrame:
    """The rows of a comparison from (source_type, target_type, bin, n, k, test_n, test_k)."""
    keys = ["source_type", "target_type", "bin"]
    roll = lambda *by: counts.where("n > 0").groupBy(*by).agg(smoothed_rate(F.sum("k"), F.sum("n")).alias("p"))
    both, pair, binned, whole = (roll(*by).withColumnRenamed("p", f"p_{m}") for m, by in (("type_distance", keys), ("type_pair", keys[:2]), ("distance", keys[2:]), ("global", [])))
    scored = counts.where("test_n > 0").join(both, keys, "left").join(pair, keys[:2], "left").join(binned, keys[2:], "left").crossJoin(F.broadcast(whole))  # whole is one row
    p = {m: F.coalesce(f"p_{m}", "p_global") for m in MODELS}
    one, zero = F.lit(1), F.lit(0)
    bits = [F.sum(F.when(F.col("test_k") > 0, F.col("test_k") * code_length(one, p[m])).otherwise(0.0) + F.when(F.col("test_n") > F.col("test_k"), (F.col("test_n") - F.col("test_k")) * code_length(zero, p[m])).otherwise(0.0)).alias(m) for m in MODELS]
    totals = scored.agg(F.coalesce(F.sum("test_n"), F.lit(0)).alias("test_pairs"), F.sum("test_k").alias("positives"), *bits)
    sizes = pair.agg(F.count("*").alias("k_pair")).crossJoin(both.agg(F.count("*").alias("k_both")))
    bits_of = {"global": F.lit(64), "distance": F.lit(64 * (2 * bins + 1)), "type_pair": 64 * (F.col("k_pair") + 1), "type_distance": 64 * (F.col("k_both") + bins + 2)}
    rows_of = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("residual_bits"), bits_of[m].cast("bigint").alias("model_bits")) for m in MODELS])).alias("r")
    out = totals.crossJoin(sizes).select("test_pairs", "positives", rows_of).select("r.model", "test_pairs", "positives", "r.residual_bits", "r.model_bits")
    return out.select("*", (F.col("residual_bits") + F.col("model_bits")).alias("two_part_bits"), per_sample(F.col("residual_bits"), F.col("test_pairs")).alias("bits_per_pair"), per_positive(F.col("residual_bits"), F.col("positives")).alias("bits_per_positive"))


def best_model(results: DataFrame) -> str:
    """The model of least two-part bits; ties to the name that sorts first."""
    return results.agg(F.min_by("model", F.struct("two_part_bits", "model"))).first()[0]


def save_results(results: DataFrame, path: str | Path) -> None:
    """Result rows as an indented JSON array: a report, a few rows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([r.asDict() for r in results.orderBy("model").collect()], indent=2) + "\n")
