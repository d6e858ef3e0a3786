"""Means and spreads of the geometry features over all pairs of tiled nodes, added up in the tiles.

Distances and absolute differences are the same both ways and unit vectors turn round, so a tile above the diagonal serves
its mirror image too. A pair of a node with itself adds nothing to these sums; what does not depend on the distance comes
from sums of places alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import is_finite
from latticebits.operators.tiles import PANEL, Tile, Tiles

_NEAR = ["f_log_distance", *(f"f_abs_{a}" for a in "xyz"), *(f"f_unit_{a}" for a in "xyz")]


def all_finite(nodes: DataFrame) -> bool:
    """Whether every node has a place: a missing part of one leaves out some features of its pairs, which sums can't tell."""
    return nodes.where(~F.coalesce(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")), F.lit(False))).isEmpty()


def _features(tile: Tile) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The features that need both ends, of some sources with all targets."""
    step = max(1, PANEL // max(1, len(tile.t["id"])))
    for lo in range(0, len(tile.s["id"]), step):
        rows = slice(lo, min(lo + step, len(tile.s["id"])))
        yield rows, _of([tile.t[a][None, :] - tile.s[a][rows, None] for a in "xyz"])


def _of(delta: list[np.ndarray]) -> list[np.ndarray]:
    d = np.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2])
    length = np.maximum(d, 1e-12)
    return [np.log1p(d), *(np.abs(x) for x in delta), *(x / length for x in delta)]


def source_means(tiles: Tiles) -> DataFrame:
    """(source, and the mean of each spatial feature over the pairs of that source)."""
    names = ["n", *_NEAR, *(f"own_{a}" for a in "xyz"), *(f"other_{a}" for a in "xyz")]

    def sums(each: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for tile in each:
            s, t = tile.s, tile.t
            p, q = tile.same()
            n = np.full(len(s["id"]), float(len(t["id"]))) - np.bincount(p, minlength=len(s["id"]))
            out = np.zeros((len(_NEAR), len(s["id"])))
            back = np.zeros((len(_NEAR), len(t["id"])))
            if tile.i <= tile.j:
                for rows, features in _features(tile):
                    for k, f in enumerate(features):
                        out[k, rows] += f.sum(axis=1)
                        if tile.i < tile.j:
                            back[k] += f.sum(axis=0)
                for k, f in enumerate(_of([t[a][q] - s[a][p] for a in "xyz"])):
                    out[k] -= np.bincount(p, weights=f, minlength=len(s["id"]))
                back[4:] *= -1
            other = [t[a].sum() - np.bincount(p, weights=t[a][q], minlength=len(s["id"])) for a in "xyz"]
            columns = [s["id"], n, *out, *(s[a] * n for a in "xyz"), *other]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source", *names])
            if tile.i < tile.j:
                zero = np.zeros(len(t["id"]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [t["id"], zero, *back, *[zero] * 6]], ["source", *names])

    total = tiles.tasks(sums, ", ".join(["source long", *(f"{n} double" for n in names)])).groupBy("source").agg(*[F.sum(n).alias(n) for n in names]).where("n > 0")
    mean = {f: F.col(f) / F.col("n") for f in _NEAR}
    mean |= {f"f_{k}_{a}": F.col(f"{c}_{a}") / F.col("n") for k, c in (("source", "own"), ("target", "other")) for a in "xyz"}
    mean |= {f"f_middle_{a}": (F.col(f"own_{a}") + F.col(f"other_{a}")) / (2 * F.col("n")) for a in "xyz"}
    return total.select("source", *[v.alias(k) for k, v in mean.items()])


def moments(tiles: Tiles) -> DataFrame:
    """One row: the mean and the population's standard deviation (mean_, sd_) of each relative feature over all pairs."""
    names = [f"{k}{f}" for k in ("sum_", "square_") for f in _NEAR]

    def sums(each: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for tile in each:
            p, q = tile.same()
            n += len(tile.s["id"]) * len(tile.t["id"]) - len(p)
            if tile.i > tile.j:
                continue
            twice = 2 if tile.i < tile.j else 1
            own = np.zeros(len(names))
            for features in (f for _, f in _features(tile)):
                own += [f.sum() for f in features] + [np.einsum("ij,ij->", f, f) for f in features]
            again = _of([tile.t[a][q] - tile.s[a][p] for a in "xyz"])
            own -= [f.sum() for f in again] + [(f * f).sum() for f in again]
            if twice == 2:
                own[4:7] = 0  # as much the other way
            total += twice * own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([v]) for v in total]], ["n", *names])

    row = tiles.tasks(sums, ", ".join(["n long", *(f"{n} double" for n in names)])).agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
    n = F.when(F.col("n") > 0, F.col("n"))
    columns = []
    for f in _NEAR:
        mean = F.col(f"sum_{f}") / n
        columns += [mean.alias(f"mean_{f}"), F.sqrt(F.greatest(F.col(f"square_{f}") / n - mean * mean, F.lit(0.0))).alias(f"sd_{f}")]
    return row.select(*columns)
