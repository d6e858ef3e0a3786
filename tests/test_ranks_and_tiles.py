"""Global ranks, selection by rank, the tiled pair relation, and what is built on them."""

import random
from math import ceil, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticebits.operators import degree, evaluate, graph, logistic, models, nested_cv, ranking, selection, splits, tiles, validate

LEVELS = [0, 0.001, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]


def plan(df):
    return df._jdf.queryExecution().toString()


# ---- ranks


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_ranks_are_row_numbers(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, 1.5, 2.5, float(i)])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    got, count = ranking.ranked(df, "x", F.desc("id"))
    want = sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, -t[0]))
    assert count == n and [(x["id"], x["x"]) for x in got.orderBy("rank").collect()] == want
    assert sorted(x["rank"] for x in got.collect()) == list(range(1, n + 1))


def test_running_sums(spark):
    rows = [(k, k * 7 % 31) for k in range(500)]
    got, totals = ranking.running_sums(spark.createDataFrame(rows, "k long, w long").repartition(6), "k", upto=F.col("w"), n=F.lit(1))
    want = np.cumsum([w for _, w in rows])
    assert [(x["upto"], x["n"]) for x in got.orderBy("k").collect()] == [(float(a), float(k + 1)) for k, a in enumerate(want)]
    assert totals == {"upto": float(want[-1]), "n": 500.0}


def test_no_task_ranks_all_rows(spark):
    nodes = spark.range(5000).select("id", (F.col("id") * 7919 % 5000).cast("double").alias("x"))
    for df in (splits.slabs(nodes), splits.axis_split(nodes), splits.central_window(nodes, 100), splits.permutation_split(nodes, ["id"], 0.3, 1)):
        assert "SinglePartition" not in plan(df) and "TakeOrdered" not in plan(df) and "Window" not in plan(df)


def test_more_slabs_than_nodes(spark):
    nodes = spark.createDataFrame([(i, float(-i)) for i in range(3)], "id long, x double")
    assert [(r["id"], r["slab"]) for r in splits.slabs(nodes, 5).orderBy("id").collect()] == [(0, 2), (1, 1), (2, 0)]
    assert splits.slabs(nodes.limit(0)).collect() == []


# ---- selection


@pytest.mark.parametrize("few, margin", [(20_000, 0.001), (3, 0.1)])
@pytest.mark.parametrize("kind", ["normal", "ties", "one", "same", "mixed"])
def test_quantiles_are_exact(spark, monkeypatch, kind, few, margin):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "MARGIN", margin)
    r = np.random.default_rng(3)
    x = {"normal": r.normal(size=4000), "ties": np.repeat([1.0, 2.0, 3.0], [2000, 1, 1999]), "one": np.array([5.0]), "same": np.ones(500), "mixed": np.concatenate([np.zeros(2000), r.normal(size=2000)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in r.permutation(x)], "d double").repartition(3)
    assert selection.quantiles(df, "d", LEVELS) == pytest.approx(np.quantile(x, LEVELS).tolist(), rel=1e-12)


def test_ranges_whose_width_overflows(spark):
    x = np.sort(np.random.default_rng(1).uniform(-1, 1, 3000) * 1.7e308)
    df = spark.createDataFrame([(float(v),) for v in x], "d double")
    assert models.exact_quantiles(df, "d", [0, 0.5, 1]) == pytest.approx([x[0], x[1499] * 0.5 + x[1500] * 0.5, x[-1]])
    assert selection.quantiles(df.where("false"), "d", [0.5]) is None
    with pytest.raises(ValueError):
        selection.at_ranks(df, "d", [3000])


@pytest.mark.parametrize("count", [0, 1, 55, 100, 555, 1000, 2000])
def test_first_rows_break_ties_by_keys(spark, count):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), "id").repartition(5)
    got = sorted(r["id"] for r in selection.first_rows(df, F.col("a").cast("double"), ["id"], count).collect())
    assert got == sorted(i for _, i in sorted((i % 10, i) for i in range(1000))[:count])


def test_split_is_exact_though_keys_repeat(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    assert splits.permutation_split(df, ["k"], 0.3, 5).where("part = 'train'").count() == 700


# ---- tiles


def small_graph(spark, n=70, edges=300, repeat=False):
    r = random.Random(n)
    rows = [(i * 3, r.choice(["a", "b", None]), r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)) for i in range(n)] + ([(6, "again", 1.0, 2.0, 3.0)] if repeat else [])
    nodes = spark.createDataFrame(rows, "id long, type string, x double, y double, z double").repartition(3)
    pairs = {(r.randrange(n + 4) * 3, r.randrange(n + 4) * 3) for _ in range(edges)}
    counts = spark.createDataFrame([(a, b, r.randint(1, 9)) for a, b in sorted(pairs)], "pre long, post long, synapse_count long")
    return nodes, counts


@pytest.mark.parametrize("block, panel, repeat", [(2048, 1 << 16, False), (9, 50, False), (9, 50, True)])
def test_tiles_are_the_labelled_pairs(spark, monkeypatch, block, panel, repeat):
    monkeypatch.setattr(tiles, "PANEL", panel)
    nodes, counts = small_graph(spark, repeat=repeat)
    got = tiles.tiled(nodes, counts, block=block).pairs()
    want = graph.labelled_pairs(graph.candidate_pairs(nodes), counts).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 4000
    assert "BroadcastNestedLoopJoin" not in plan(got) and "CartesianProduct" not in plan(got)


def test_tiles_of_few_nodes(spark):
    nodes, counts = small_graph(spark, 1, 0)
    assert tiles.tiled(nodes, counts).pairs().count() == 0
    assert tiles.tiled(nodes.limit(0), counts).pairs().count() == 0


def test_connected_pairs_are_those_with_an_edge(spark):
    nodes, counts = small_graph(spark)
    got, want = graph.connected_pairs(nodes, counts), graph.labelled_pairs(graph.candidate_pairs(nodes), counts).where("connected = 1")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count() > 100


def test_models_of_tiles_are_those_of_pairs(spark):
    nodes, counts = small_graph(spark)
    placed = splits.slabs(nodes.na.fill("?"))
    own = tiles.tiled(placed, counts, block=11)
    pairs = splits.with_parts(own.pairs(), placed.select("id", "slab"), "slab").persist()
    train, test = splits.among("slab", [0, 1, 2, 3]), splits.among("slab", [4])
    rows = lambda df: {r["model"]: r.asDict() for r in df.collect()}
    a, b = rows(evaluate.model_comparison(pairs, train, test)), rows(evaluate.node_comparison(own, frozenset(range(4)), frozenset([4])))
    for name, row in a.items():
        assert b[name] == {k: pytest.approx(v) for k, v in row.items()}
    spec = [logistic.Spec(f, f, 1.0, frozenset(range(4))) for f in ("distance", "relative", "spatial")]
    with logistic.tile_rows(own) as kept:
        got = logistic.fit_many(kept, spec)
        bits = logistic.slab_bits(kept, got, 5)
    with logistic.packed(pairs) as kept:
        want = logistic.fit_many(kept, spec)
        for key, value in logistic.slab_bits(kept, want, 5).items():
            assert bits[key] == pytest.approx(value, rel=1e-9)
    for f in got:
        assert np.allclose(got[f].coefficients, want[f].coefficients, rtol=1e-6, atol=1e-9)
    pairs.unpersist()


def test_degrees_of_nodes_are_those_of_pairs(spark):
    nodes, counts = small_graph(spark)
    pairs = [(r["source"], r["target"], r["connected"]) for r in tiles.tiled(nodes, counts).pairs().collect()]
    out, into = {}, {}
    for s, t, c in pairs:
        out[s], into[t] = out.get(s, 0) + c, into.get(t, 0) + c
    w = np.array([(out[s] + 0.5) * (into[t] + 0.5) for s, t, _ in pairs])
    y = np.array([c for *_, c in pairs])
    low, high = 0.0, 1.0
    while np.minimum(high * w, 1 - 1e-12).sum() < y.sum():
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(middle * w, 1 - 1e-12).sum() < y.sum() else (low, middle)
    p = np.clip(np.minimum(high * w, 1 - 1e-12), 1e-12, 1 - 1e-12)
    bits = -np.log2(np.where(y == 1, p, 1 - p)).sum()
    for got in (degree.node_diagnostic(nodes, counts).first(), degree.degree_diagnostic(tiles.tiled(nodes, counts).pairs()).first()):
        assert got["residual_bits"] == pytest.approx(bits, rel=1e-9) and got["degree_side_bits"] == 2 * 70 * ceil(log2(70)) and got["n_nodes"] == 70
    none = degree.node_diagnostic(nodes, counts.where("false")).first()
    assert none["residual_bits"] == pytest.approx(-70 * 69 * log2(1 - 0.5 / (70 * 69 + 1)))


def test_validation_finds_repeats(spark):
    nodes, counts = small_graph(spark)
    pairs = tiles.tiled(nodes.na.fill("?"), counts).pairs()
    found = lambda p: {r["rule"]: r["violations"] for r in validate.violations(nodes.na.fill("?"), p).collect() if r["violations"]}
    assert found(pairs) == {}
    again = pairs.where("source = 3 AND target < 30")
    stray = pairs.where("source = 3 AND target IN (6, 9)").withColumn("target", F.lit(10**9))
    n, k = again.count(), stray.count()
    got = found(pairs.unionByName(again).unionByName(stray))
    assert got["repeated_pair"] == n + k - 1 and got["unknown_node"] == k and got["pair_count"] == n + k
    assert found(pairs.limit(0)) == {"pair_count": 70 * 69}


def test_nested_runs_of_nodes_are_those_of_pairs(spark):
    nodes, counts = small_graph(spark, 40, 400)
    nodes = nodes.na.fill("?")
    near = 7.0
    pairs = tiles.tiled(nodes, counts).pairs().withColumn("connected", F.when(F.col("distance") <= near, F.col("connected")).otherwise(0))
    a, b = nested_cv.run(pairs, nodes), nested_cv.run_nodes(nodes, counts, near=near)
    assert nested_cv.equivalence(a, b, 1e-6)["max_fold_residual_difference_bits"] < 1e-6
    for x, y in zip(a["folds"], b["folds"]):
        assert {k: v for k, v in x.items() if k not in ("predictive", "inner_selection", "degree_oracle")} == {k: v for k, v in y.items() if k not in ("predictive", "inner_selection", "degree_oracle")}
        assert y["degree_oracle"] == {k: pytest.approx(v) for k, v in x["degree_oracle"].items()}
