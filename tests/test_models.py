import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticebits.functions import columns as c
from latticebits.operators import degree, distortion, evaluate, graph, logistic, models, nested_cv, splits, synthetic

GRID = [(i, float(20 * i), float(11 * (i % 5)), float(13 * (i % 4))) for i in range(25)]


@pytest.fixture(scope="module")
def grid(spark):
    nodes = spark.createDataFrame([(i, "unknown", x, y, z) for i, x, y, z in GRID], "id long, type string, x double, y double, z double")
    pairs = graph.candidate_pairs(nodes)
    y = ((F.col("distance") < 55) | ((F.col("source") + F.col("target")) % 19 == 0)).cast("int")
    return nodes, pairs.withColumn("connected", y).cache()


def numpy_pairs(pairs, feature_set):
    rows = pairs.select("connected", *c.geometry_features(feature_set).values()).collect()
    a = np.array([list(r) for r in rows], dtype=float)
    return a[:, 1:], a[:, 0]


def numpy_fit(x, y, l2, rounds=200):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    a = np.column_stack([np.ones(len(y)), (x - mean) / sd])
    b = np.zeros(a.shape[1])
    p = (y.sum() + 0.5) / (len(y) + 1)
    b[0] = math.log(p / (1 - p))
    pen = np.ones(len(b)) * l2
    pen[0] = 0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-a @ b))
        step = np.linalg.solve(a.T @ (np.clip(q * (1 - q), 1e-8, None)[:, None] * a) + np.diag(pen), a.T @ (q - y) + pen * b)
        b = b - step
        if np.linalg.norm(step) < 1e-9:
            break
    return b, 1 / (1 + np.exp(-a @ b))


def test_metrics(spark):
    one = spark.createDataFrame([(1, 1.0, 0.5), (0, 0.0, 0.5)], "y int, sure double, fair double")
    got = one.agg(F.sum(c.code_length(F.col("y"), F.col("sure"))), F.sum(c.code_length(F.col("y"), F.col("fair")))).first()
    assert got[0] < 1e-10 and got[1] == 2.0
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double").select(c.entropy_bits(F.col("p"))).collect()] == [0.0, 0.0, 1.0]
    for bad in (c.code_length(F.lit(2), F.lit(0.5)), c.code_length(F.lit(1), F.lit(float("nan"))), c.per_positive(F.lit(1.0), F.lit(0)), c.per_sample(F.lit(1.0), F.lit(0)), c.entropy_bits(F.lit(1.5))):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_feature_widths_and_units():
    assert [len(c.geometry_features(f)) for f in c.FEATURE_SETS] == [1, 7, 16]
    with pytest.raises(ValueError):
        c.geometry_features("other")


@pytest.mark.parametrize("feature_set,bits", [("distance", 256), ("relative", 1408), ("spatial", 3136)])
@pytest.mark.parametrize("solver", ["newton", "damped"])
def test_logistic_is_the_penalised_optimum(grid, feature_set, bits, solver):
    _, pairs = grid
    model = logistic.fit(pairs, feature_set, 1.0, solver)
    x, y = numpy_pairs(pairs, feature_set)
    beta, p = numpy_fit(x, y, 1.0)
    assert model.model_bits == bits and model.converged
    got = np.sort([r["p"] for r in model.predict(pairs).select("p").collect()])
    assert np.allclose(got, np.sort(p), atol=1e-7)
    if solver == "damped":
        assert all(b <= a + 1e-9 for a, b in zip(model.objectives, model.objectives[1:]))


def test_logistic_errors(grid):
    _, pairs = grid
    with pytest.raises(ValueError):
        logistic.fit(pairs, "distance", 0.0)
    with pytest.raises(ValueError):
        logistic.fit(pairs.where("false"), "distance")
    with pytest.raises(ValueError):
        logistic.fit(pairs.withColumn("connected", F.lit(2)), "distance")
    with pytest.raises(ValueError):
        logistic.fit(pairs, "distance", 1.0, "other")


def test_damped_on_rare_correlated_pairs(spark):
    rows = spark.range(6000).withColumn("u", synthetic.uniform(3, F.col("id"), 1) * 100)
    pairs = rows.select((F.col("u") + 1).alias("distance"), *[F.lit(0.0).alias(f"s{a}") for a in "xyz"], F.col("u").alias("tx"), (F.col("u") * 1.0000001).alias("ty"), F.lit(1.0).alias("tz"), (synthetic.uniform(3, F.col("id"), 2) < 0.002).cast("int").alias("connected"))
    model = logistic.fit(pairs, "relative", 1.0, "damped")
    assert model.converged and all(b <= a + 1e-9 for a, b in zip(model.objectives, model.objectives[1:]))


def test_transparent_models(spark):
    rows = splits.permutation_split(synthetic.pairs(spark, n_pairs=8000), ["pair_id"], 0.3, 1).cache()
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    assert train.count() == 5600 and rows.count() == 8000
    single = [evaluate.evaluate_fitted(f(train), test) for f in (models.GlobalRate.fit, models.distance_binned, models.type_pair, models.type_distance)]
    table = {r["model"]: r for r in evaluate.model_comparison(rows, F.col("part") == "train", F.col("part") == "test").collect()}
    for r in single:
        assert table[r["model"]]["residual_bits"] == pytest.approx(r["residual_bits"]) and table[r["model"]]["model_bits"] == r["model_bits"]
        assert r["two_part_bits"] == r["residual_bits"] + r["model_bits"]
    assert table["distance"]["residual_bits"] < table["global"]["residual_bits"] and table["distance"]["model_bits"] == 1600
    assert evaluate.best_model(evaluate.model_comparison(rows, F.col("part") == "train", F.col("part") == "test")) in evaluate.MODELS
    with pytest.raises(ValueError):
        models.GlobalRate.fit(train.where("false"))


def test_equal_distances_widen(spark):
    same = spark.createDataFrame([("a", "b", 5.0, k % 2) for k in range(10)], "source_type string, target_type string, distance double, connected int")
    assert models.distance_edges(same, 12)[-1] == 6.0
    assert {round(r["p"], 6) for r in models.distance_binned(same).predict(same).collect()} == {0.5}


def test_synthetic_does_not_depend_on_partitions(spark):
    a, b = synthetic.pairs(spark, n_pairs=500), synthetic.pairs(spark, n_pairs=500).repartition(7)
    assert a.exceptAll(b).isEmpty() and a.where("source = target").isEmpty() and 0 < a.agg(F.sum("connected")).first()[0] < 500


# ---- splits


def line(spark, n):
    return spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, x double")


@pytest.mark.parametrize("n", [5, 7, 12, 334])
def test_slabs_are_sized_like_array_split(spark, n):
    sizes = [r["count"] for r in splits.slabs(line(spark, n)).groupBy("slab").count().orderBy("slab").collect()]
    assert sizes == [len(a) for a in np.array_split(np.arange(n), 5)]


@pytest.mark.parametrize("n", [3, 4, 10, 20])
def test_axis_split(spark, n):
    got = {r["part"]: r["count"] for r in splits.axis_split(line(spark, n)).groupBy("part").count().collect()}
    a, b = splits.rank_cuts(n)
    assert got == {"train": a, "validation": b - a, "test": n - b}
    with pytest.raises(ValueError):
        splits.rank_cuts(2)


def test_windows_and_slab_positives(spark):
    assert [r["id"] for r in splits.central_window(line(spark, 10), 4).orderBy("id").collect()] == [3, 4, 5, 6]
    nodes = line(spark, 15)
    pairs = spark.createDataFrame([(a, a + 1, int(a % 3 == 0)) for a in range(14)], "source long, target long, connected int")
    placed = splits.with_parts(pairs, splits.slabs(nodes).select("id", "slab"), "slab")
    assert [r["positives"] for r in splits.require_slab_positives(placed)] == [1] * 5
    with pytest.raises(ValueError, match="slab 4"):
        splits.require_slab_positives(placed.where("source <> 12"))
    assert splits.slab_positives(placed.where("false")).where("pairs = 0").count() == 5


# ---- nested cross-validation


def brute_degree(rows):
    out, into = {}, {}
    for s, t, y in rows:
        out[s], into[t] = out.get(s, 0) + y, into.get(t, 0) + y
    w = np.array([(out[s] + 0.5) * (into[t] + 0.5) for s, t, _ in rows])
    y = np.array([r[2] for r in rows])
    low, high = 0.0, 1.0
    while np.minimum(high * w, 1 - 1e-12).sum() < y.sum():
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(mid * w, 1 - 1e-12).sum() < y.sum() else (low, mid)
    p = np.clip(np.minimum(high * w, 1 - 1e-12), 1e-12, 1 - 1e-12)
    return -(y * np.log2(p) + (1 - y) * np.log2(1 - p)).sum()


def test_degree_diagnostic(spark):
    rows = [(a, b, int((a * b) % 3 == 1)) for a in range(10) for b in range(10) if a != b]
    df = spark.createDataFrame(rows, "source long, target long, connected int")
    got = degree.degree_diagnostic(df).first()
    assert got["degree_side_bits"] == 80 and got["residual_bits"] == pytest.approx(brute_degree(rows), abs=1e-6)
    none = degree.degree_diagnostic(df.withColumn("connected", F.lit(0))).first()
    p = 0.5 / 91
    assert none["residual_bits"] == pytest.approx(-90 * math.log2(1 - p))
    full = degree.degree_diagnostic(df.withColumn("connected", F.lit(1))).first()  # ends
    assert full["residual_bits"] < 1e-6


@pytest.fixture(scope="module")
def run(grid):
    nodes, pairs = grid
    return nested_cv.run(pairs, nodes, "damped")


def test_nested_cv(run, grid):
    nodes, pairs = grid
    ids = [i for f in run["folds"] for i in f["test_node_ids"]]
    assert sorted(ids) == list(range(25)) and len(run["folds"]) == 5
    total = run["aggregate"]
    assert total["spatial"]["two_part_bits"] == pytest.approx(sum(f["predictive"]["spatial"]["two_part_bits"] for f in run["folds"]))
    # one outer fold against plain numpy
    fold = run["folds"][0]
    placed = splits.with_parts(pairs, splits.slabs(nodes).select("id", "slab"), "slab")
    x, y = numpy_pairs(placed.where("s_slab > 0 AND t_slab > 0"), "relative")
    assert fold["train_pairs"] == len(y) and fold["train_positive_pairs"] == y.sum()
    beta, _ = numpy_fit(x, y, fold["predictive"]["relative"]["l2"])
    tx, ty = numpy_pairs(placed.where("s_slab = 0 AND t_slab = 0"), "relative")
    sd = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    p = np.clip(1 / (1 + np.exp(-(np.column_stack([np.ones(len(ty)), (tx - x.mean(axis=0)) / sd]) @ beta))), 1e-12, 1 - 1e-12)
    assert fold["predictive"]["relative"]["residual_bits"] == pytest.approx(-(ty * np.log2(p) + (1 - ty) * np.log2(1 - p)).sum(), abs=1e-4)


def test_confirmation_and_equivalence(run, spark):
    base = {"two_part_bits": 90.0, "residual_bits": 90.0, "wins_vs_global": 4, "residual_reduction_vs_global": 0.06}
    result = {"aggregate": {"global": base | {"residual_bits": 100.0}, "distance": base, "relative": base, "spatial": dict(base)}}
    assert nested_cv.confirmation(result)["criterion_met"]
    result["aggregate"]["spatial"]["residual_reduction_vs_global"] = 0.03
    assert not nested_cv.confirmation(result)["criterion_met"]
    with pytest.raises(ValueError):
        nested_cv.confirmation({"aggregate": {"global": base}})
    assert nested_cv.equivalence(run, run)["max_fold_residual_difference_bits"] == 0
    import copy

    other = copy.deepcopy(run)
    other["folds"][2]["predictive"]["spatial"]["residual_bits"] += 0.2
    with pytest.raises(ValueError):
        nested_cv.equivalence(run, other)
    with pytest.raises(ValueError):
        nested_cv.equivalence({"protocol": "x"}, run)
    rows = nested_cv.fold_rows(run, spark)
    assert nested_cv.equivalence_rows(rows, nested_cv.fold_rows(other, spark)).where("NOT equal").count() == 1


# ---- rate-distortion


def test_distortion(spark):
    rows = [(0, 1, 1, 0.9), (1, 2, 1, 0.2), (2, 0, 1, 0.7), (0, 2, 0, 0.1), (2, 1, 1, 0.8)]
    df = spark.createDataFrame(rows, "source int, target int, connected int, p double")
    order = [(r["source"], r["target"]) for r in distortion.ranked_edges(df, "residual-first").orderBy("retention_rank").collect()]
    assert order == [(1, 2), (2, 0), (2, 1), (0, 1)]
    assert [(r["source"], r["target"]) for r in distortion.ranked_edges(df, "typical-first").orderBy("retention_rank").collect()] == order[::-1]
    assert {(r["source"], r["target"]) for r in distortion.retained(df, "residual-first", 0.5).collect()} == set(order[:2])
    curve = {(r["mode"], r["fraction"]): r for r in distortion.distortion_curve(df, 3).collect()}
    assert len(curve) == 15 and all(curve[(m, 1.0)]["normalized_mse"] == 0 and curve[(m, 1.0)]["retained_edges"] == 4 for m in distortion.MODES)
    w = distortion.stable_weights(np.ones((5, 5)), 1)
    assert np.abs(np.linalg.eigvals(w)).max() == pytest.approx(0.85)
    assert distortion.normalized_mse(np.zeros(3), np.ones(3)) == 1.0
    for bad in (lambda: distortion.ranked_edges(df, "x"), lambda: distortion.retained(df, "random", 1.5), lambda: distortion.distortion_curve(df, 10**6)):
        with pytest.raises(ValueError):
            bad()
