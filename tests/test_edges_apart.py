"""Pairs by slabs and types without tiles, pairs inside slabs from tiles of one slab."""

from test_large_pairs import graph_of

from latticebits.operators import splits, tiles


def plan(df):
    return df._jdf.queryExecution().toString()


def test_counts_by_slabs_and_types_make_no_tile(spark):
    nodes, counts = graph_of(spark, 40, repeat=True)
    own = tiles.tiled(splits.slabs(nodes), counts, block=20)
    assert "MapInArrow" not in plan(own.slab_counts())
    binned = own.binned([], frozenset(range(4)), frozenset([4]))
    assert "MapInArrow" not in plan(binned)
    rows = own.pairs("source_type", "target_type", "connected", "s_slab", "t_slab").toPandas()
    inside = rows[(rows.s_slab < 4) & (rows.t_slab < 4)].groupby(["source_type", "target_type"]).connected.agg(["size", "sum"])
    got = {(r["source_type"], r["target_type"]): (r["n"], r["k"]) for r in binned.where("n > 0").collect()}
    assert got == {k: (int(v["size"]), int(v["sum"])) for k, v in inside.iterrows()}


def test_pairs_inside_slabs_come_from_tiles_of_one_slab(spark):
    nodes, counts = graph_of(spark, 60, repeat=True)
    placed = splits.slabs(nodes)
    own = tiles.tiled(placed, counts, block=20, within=True)
    assert own.table.where("s_slab[0] <> t_slab[0]").isEmpty()
    names = ("source", "target", "s_slab", "synapse_count")
    want = tiles.tiled(placed, counts).pairs(*names, same_slab=True)
    got = own.pairs(*names, same_slab=True)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 600
