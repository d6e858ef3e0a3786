"""Passes of fits: none over pairs that no fit has, one for each damped step."""

import numpy as np
from test_large_pairs import graph_of

from latticebits.operators import logistic, splits, tile_fits, tiles


def test_pairs_that_no_fit_has_are_not_measured(spark):
    nodes, counts = graph_of(spark, 50)
    with logistic.tile_rows(tiles.tiled(splits.slabs(nodes), counts, block=15)) as rows:
        for batch in rows.tiles.blocks.toArrow().to_batches():
            for k in range(batch.num_rows):
                tile = tiles.Tile(batch, k)
                assert {(u, v) for u, v, *_ in rows.frame.parts(tile, frozenset([(4, 4), (2, 2)]), 2)} <= {(4, 4), (2, 2)}
                assert sum(e.shape[1] for *_, e, _ in rows.frame.parts(tile, None, 2)) == np.prod([len(tile.s["id"]), len(tile.t["id"]) - (tile.i == tile.j)]) / (1 + (tile.i == tile.j))
        fits = logistic.fit_many(rows, [logistic.Spec("d", "distance", 1.0)])
        every = logistic.slab_bits(rows, fits, 5)
        assert logistic.slab_bits(rows, fits, 5, frozenset([4])) == {(4, "d"): every[(4, "d")]}


def test_a_damped_step_is_one_pass(spark, monkeypatch):
    passes, made = [], tile_fits.TileRows._pass
    monkeypatch.setattr(tile_fits.TileRows, "_pass", lambda *a, **k: passes.append(1) or made(*a, **k))
    nodes, counts = graph_of(spark, 50)
    with logistic.tile_rows(tiles.tiled(nodes, counts, block=15)) as rows:
        fit = logistic.fit_many(rows, [logistic.Spec("d", "relative", 1.0)], "damped")["d"]
    assert fit.backtracks == 0 and len(fit.objectives) >= 3
    assert len(passes) <= 2 + len(fit.objectives)  # moments, and one for each place; before, two for each
