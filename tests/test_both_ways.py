"""Pairs made both ways from tiles on and above the diagonal: all of them, rounded as round() does, in files of half the size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large_pairs import graph_of

from latticebits.operators import graph, splits, tiles
from latticebits.plans import catalogue


@pytest.mark.parametrize("run, panel, near", [(512, 1 << 16, None), (3, 40, 4.0)])
def test_runs_are_all_pairs(spark, monkeypatch, run, panel, near):
    monkeypatch.setattr(tiles, "RUN", run)
    monkeypatch.setattr(tiles, "PANEL", panel)
    nodes, counts = graph_of(spark, 60, repeat=True)
    own = tiles.replace(tiles.tiled(splits.slabs(nodes), counts, block=15), near=near)
    want = graph.labelled_pairs(graph.candidate_pairs(nodes), counts)
    if near is not None:
        want = want.withColumn("synapse_count", F.when(F.col("distance") <= near, F.col("synapse_count")).otherwise(0)).withColumn("connected", (F.col("synapse_count") > 0).cast("int"))
    got = own.pairs()
    assert got.count() == want.count() > 3000
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_a_distance_and_its_copy_stand_in_one_stretch(spark, tmp_path):
    """Before, a file of pairs took as much as that of the cross join, 9 bytes a pair."""
    r = random.Random(5)
    nodes = spark.createDataFrame([(i, "a", *(r.uniform(0, 1e6) for _ in "xyz")) for i in range(1500)], "id long, type string, x double, y double, z double")
    size = {}
    for name, pairs in (("tiles", tiles.tiled(nodes).pairs()), ("join", graph.candidate_pairs(nodes))):
        pairs.select("source", "target", "distance").write.parquet(str(tmp_path / name))
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size["tiles"] < 0.75 * size["join"]


def test_distances_are_rounded_as_in_spark(spark):
    r = random.Random(3)
    x = [0.0, 0.0005, 1.0005, 2.0015, 1e300, 2.0**51 + 0.5, float("inf"), 123456.7895, 99999.9995] + [r.randrange(10**9) / 1e4 for _ in range(2000)] + [r.uniform(0, 1e6) for _ in range(2000)]
    want = [v["r"] for v in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double").select("k", F.round("v", 3).alias("r")).orderBy("k").collect()]
    assert tiles.half_up(np.array(x), 3).tolist() == want
    assert np.isnan(tiles.half_up(np.array([np.nan]), 3)).all()


def test_a_node_without_a_place_has_no_distance(spark):
    nodes = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (2, "a", None, 1.0, 1.0), (3, "b", 3.0, 4.0, 0.0)], "id long, type string, x double, y double, z double")
    got = {(r["source"], r["target"]): r["distance"] for r in tiles.tiled(nodes).pairs("source", "target", "distance", digits=3).collect()}
    assert got == {(1, 2): None, (2, 1): None, (2, 3): None, (3, 2): None, (1, 3): 5.0, (3, 1): 5.0}


def test_candidate_pairs_come_from_tiles(spark):
    assert "MapInArrow" in catalogue.QUERIES["candidate_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
