"""Fits over tiles: each unordered pair once, no edges in the tiles, the same results as over all ordered pairs."""

import numpy as np
import pytest
from test_large_pairs import graph_of

from latticebits.operators import logistic, splits, tile_fits, tiles

SPECS = [logistic.Spec(f"{f}|{k}", f, 1.0, slabs) for f in ("distance", "relative", "spatial") for k, slabs in enumerate((None, frozenset([0, 1, 3])))]


@pytest.mark.parametrize("solver, started", [("newton", False), ("damped", True)])
def test_unordered_pairs_give_the_fits_of_all(spark, monkeypatch, solver, started):
    if started:
        monkeypatch.setattr(tile_fits, "START_FROM", 1)
    nodes, counts = graph_of(spark, 50, repeat=True)
    placed = splits.slabs(nodes)
    with tiles.tiled(placed, counts, block=15).kept() as own:
        rows = tile_fits.TileRows(own.blocks, own.parts, 16, own)
        got = logistic.fit_many(rows, SPECS, solver)
        bits = logistic.slab_bits(rows, got, 5)
        assert started == bool(rows.start({s.name: s for s in SPECS}, rows.moments({s.name: s for s in SPECS})))
        names = [c.split()[0] for c in tiles.PAIRS.split(", ")]
        with logistic.packed(own.pairs(*names, "s_slab", "t_slab")) as pairs:
            want = logistic.fit_many(pairs, SPECS, solver)
            for key, value in logistic.slab_bits(pairs, want, 5).items():
                assert bits[key] == pytest.approx(value, rel=1e-8)
    for name, m in want.items():
        assert np.allclose(got[name].coefficients, m.coefficients, rtol=1e-6, atol=1e-8)


def test_passes_visit_a_pair_once(spark):
    nodes, counts = graph_of(spark, 40, repeat=True)
    with logistic.tile_rows(tiles.tiled(nodes, counts, block=15)) as rows:
        spec = {"all": logistic.Spec("all", "spatial", 1.0)}
        n = rows._pass(spec, lambda _, even, odd: np.array([even.shape[1]]))["all"][0]
        assert 2 * n == rows.tiles.nodes.count() ** 2 - 43  # 41 rows with themselves, two rows of one id with each other both ways
        assert not [c for c in rows.tiles.blocks.columns if c.startswith("e_")]
