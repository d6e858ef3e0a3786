"""What keeps the pair queries bounded: no broadcast of tiles, as many tiles as are needed, distances counted in tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticebits.functions import columns
from latticebits.operators import geometry, graph, splits, tiles, validate
from latticebits.plans import features


def graph_of(spark, n, edges=400, spread=9.0, repeat=False):
    r = random.Random(n)
    rows = [(i, r.choice("abc"), *(round(r.uniform(0, spread), 3) for _ in "xyz")) for i in range(n)] + ([(6, "again", 1.0, 2.0, 3.0)] if repeat else [])
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(edges)}
    nodes = spark.createDataFrame(rows, "id long, type string, x double, y double, z double")
    return nodes, spark.createDataFrame([(a, b, 1) for a, b in sorted(pairs)], "pre long, post long, synapse_count long")


def test_tiles_are_never_broadcast(spark):
    table = tiles.tiled(*graph_of(spark, 60)).table
    table.count()
    assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()


def test_tiles_grow_no_faster_than_nodes(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MAX_BLOCKS", 7)
    nodes, counts = graph_of(spark, 300)
    own = tiles.tiled(nodes, counts, block=10)
    assert own.table.count() <= 49 and own.pairs().count() == 300 * 299


@pytest.mark.parametrize("few, repeat, spread", [(4_000_000, False, 9.0), (10, True, 9.0), (10, False, 0.002), (10, False, 0.0)])
def test_distances_and_bins_of_tiles_are_those_of_pairs(spark, monkeypatch, few, repeat, spread):
    monkeypatch.setattr(tiles, "FEW", few)
    nodes, counts = graph_of(spark, 90, spread=spread, repeat=repeat)
    with tiles.tiled(splits.slabs(nodes), counts, block=20).kept() as own:
        rows = own.pairs("source_type", "target_type", "distance", "connected", "s_slab", "t_slab").toPandas()
        inside = rows[(rows.s_slab < 4) & (rows.t_slab < 4)]
        levels = [i / 12 for i in range(13)]
        got = own.quantiles(levels, frozenset(range(4)))
        assert got == pytest.approx(np.quantile(inside.distance.to_numpy(), levels).tolist(), rel=1e-12, abs=1e-12)
        edges = sorted(set(got[1:-1]))
        binned = {(r["source_type"], r["target_type"], r["bin"]): (r["n"], r["k"]) for r in own.binned(edges, frozenset(range(4)), frozenset([4])).where("n > 0").collect()}
        inside = inside.assign(bin=np.searchsorted(edges, inside.distance.to_numpy(), side="right"))
        want = inside.groupby(["source_type", "target_type", "bin"]).connected.agg(["size", "sum"])
        assert binned == {k: (int(v["size"]), int(v["sum"])) for k, v in want.iterrows()}
        between = {(r["s_slab"], r["t_slab"]): (r["n"], r["k"]) for r in own.slab_counts().collect()}
        want = rows.groupby(["s_slab", "t_slab"]).connected.agg(["size", "sum"])
        assert between == {k: (int(v["size"]), int(v["sum"])) for k, v in want.iterrows()}
        assert own.pairs("s_slab", same_slab=True).count() == (rows.s_slab == rows.t_slab).sum()
        assert own.quantiles(levels, frozenset([9])) is None
    assert tiles.tiled(nodes.limit(0), counts).quantiles([0.5]) is None


def test_geometry_sums_are_made_in_tiles(spark):
    nodes, _ = graph_of(spark, 60, repeat=True)
    assert geometry.all_finite(nodes) and not geometry.all_finite(nodes.selectExpr("id", "type", "x", "y", "CAST(NULL AS DOUBLE) AS z"))
    own = tiles.tiled(nodes, block=20)
    f = columns.geometry_features("spatial")
    pairs = own.pairs()
    want = {r["source"]: r[1:] for r in pairs.groupBy("source").agg(*[F.avg(v).alias(k) for k, v in f.items()]).collect()}
    got = {r["source"]: r[1:] for r in geometry.source_means(own).select("source", *f).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)
    f = columns.geometry_features("relative")
    want = pairs.agg(*[x for v in f.values() for x in (F.avg(v), F.stddev_pop(v))]).first()
    assert tuple(geometry.moments(own).first()) == pytest.approx(tuple(want), rel=1e-9, abs=1e-9)


def test_validation_does_not_shuffle_pairs_for_their_nodes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, counts = graph_of(spark, 30)
        found = validate.violations(nodes, tiles.tiled(nodes, counts).pairs())
        assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shards_grow_with_events(spark, monkeypatch):
    seen, listed = [], features.shards.listed_shards
    monkeypatch.setattr(features, "SHARD_EVENTS", 100)
    monkeypatch.setattr(features.shards, "listed_shards", lambda folder: seen.append(listed(folder)) or seen[-1])
    features.shard_stream_counts(spark, "/root/testdata/sf0.001")
    assert len(seen[0]) == 10  # of 1,000 events


@pytest.mark.parametrize("few", [200_000, 10])
def test_tasks_of_the_pair_table_are_as_many_as_its_pairs_ask_for(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "TASK_PAIRS", 400)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", few)
    pairs = graph.candidate_pairs(graph_of(spark, 100)[0])
    sizes = pairs.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    assert sizes.sum() == 100 * 99 and sizes.max() <= 1_500 and pairs.rdd.getNumPartitions() >= 25
    assert pairs.select("source", "target").distinct().count() == 100 * 99
