"""What logistic fits ask of the pairs of tiled nodes, each unordered pair visited once and no edge among them.

A pair's features split into an even part, the same both ways (log distance, absolute differences, the middle), and an odd
part that turns round (unit vector, half the difference; a source is the middle less this half, a target the middle plus
it). With z = e + o one way it is e - o the other, so sums of both directions come from one visit of 8 + 6 numbers in place
of two visits of 17. Labels enter a gradient only by the features of edges, whose sums between slabs are made once.

Tiles are cut by slabs, so that a part's pairs belong to the same fits. A fit starts from coefficients of a fit to a few of
the tiles, which spares passes; it ends by the same rule on all pairs as without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from latticebits.functions.columns import geometry_features
from latticebits.operators import logistic
from latticebits.operators.tiles import Tile, Tiles

#: Numbers of the even and the odd part that each set of features needs; pairs worked on at a time.
PARTS = {"distance": (2, 0), "relative": (5, 3), "spatial": (8, 6)}
PANEL = 1 << 14
#: Unordered pairs from which fits are started by a fit to some tiles, the pairs of these (about; an eighth at most), its
#: rounds and the step that ends it.
START_FROM, START_PAIRS, START_ROUNDS, START_STEP = 20_000_000, 30_000_000, 12, 1e-3


@dataclass(frozen=True)
class Frame:
    """Where the numbers of the even part are centred, and what both parts are divided by."""

    centre: np.ndarray  # 8, 0 for the first, which is always 1
    even: np.ndarray
    odd: np.ndarray  # 6

    def parts(self, tile: Tile, wanted: frozenset[tuple[int, int]] | None, n_even: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(slab, slab, even part, odd part) of a tile's unordered pairs between wanted slabs (None: all), some at a time."""
        ends, slabs = [], None if wanted is None else {u for u, _ in wanted}
        for end in (tile.s, tile.t):
            ends.append({u: np.flatnonzero(end["slab"] == u) for u in np.unique(end["slab"]).tolist() if slabs is None or u in slabs})
        own = tile.i == tile.j
        for u, a in ends[0].items():
            for v, b in ends[1].items():
                if own and u > v or wanted is not None and (u, v) not in wanted:
                    continue
                step = max(1, PANEL // max(1, len(b)))
                for lo in range(0, len(a), step):
                    p, q = np.repeat(a[lo : lo + step], len(b)), np.tile(b, len(a[lo : lo + step]))
                    if own:
                        s, t = tile.s["id"][p], tile.t["id"][q]
                        once = s < t if u == v else s != t
                        p, q = p[once], q[once]
                    if len(p):
                        yield u, v, *self.of(tile, p, q, n_even)

    def of(self, tile: Tile, p: np.ndarray, q: np.ndarray, n_even: int) -> tuple[np.ndarray, np.ndarray]:
        n_odd = {2: 0, 5: 3, 8: 6}[n_even]
        even, odd = np.empty((n_even, len(p))), np.empty((n_odd, len(p)))
        delta = [tile.t[a][q] - tile.s[a][p] for a in "xyz"]
        d = np.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2])
        even[0] = 1.0
        np.log1p(d, out=even[1])
        if n_odd:
            length = np.maximum(d, 1e-12)
            for k, x in enumerate(delta):
                np.abs(x, out=even[2 + k])
                np.divide(x, length, out=odd[k])
        if n_even > 5:
            for k, a in enumerate("xyz"):
                np.multiply(delta[k], 0.5, out=odd[3 + k])
                np.add(tile.s[a][p], odd[3 + k], out=even[5 + k])
        even -= self.centre[:n_even, None]
        even /= self.even[:n_even, None]
        odd /= self.odd[:n_odd, None]
        return even, odd

    def design(self, feature_set: str, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrices by which the even and the odd part give 1 and the features less their mean over their scale."""
        n_even, n_odd = PARTS[feature_set]
        rows = len(mean) + 1
        e, o = np.zeros((rows, n_even)), np.zeros((rows, n_odd))
        e[0, 0] = 1.0
        for k in range(1, rows):
            if k <= 4:
                e[k, k], e[k, 0] = self.even[k], self.centre[k]
            elif k <= 7:
                o[k, k - 5] = self.odd[k - 5]
            else:
                axis, kind = (k - 8) % 3, (k - 8) // 3  # source, target, middle
                e[k, 5 + axis], e[k, 0] = self.even[5 + axis], self.centre[5 + axis]
                o[k, 3 + axis] = (-1.0, 1.0, 0.0)[kind] * self.odd[3 + axis]
            e[k, 0] -= mean[k - 1]
            e[k] /= scale[k - 1]
            o[k] /= scale[k - 1]
        return e, o


def _both(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1 + e), e


def _softplus(z: np.ndarray) -> float:
    return float((np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))).sum())


def _terms(even: np.ndarray, odd: np.ndarray, be: np.ndarray, bo: np.ndarray, floor: float) -> np.ndarray:
    """Sums over both directions: objective without labels, p and weights times the parts."""
    ze = be @ even
    if not len(odd):
        p, e = _both(ze)
        w = np.maximum(p * (1 - p), floor)
        return 2 * np.concatenate([[(np.maximum(ze, 0) + np.log1p(e)).sum()], even @ p, ((even * w) @ even.T).ravel()])
    zo = bo @ odd
    z, back = ze + zo, ze - zo
    (p, e), (q, f) = _both(z), _both(back)
    w, v = np.maximum(p * (1 - p), floor), np.maximum(q * (1 - q), floor)
    total, apart = w + v, w - v
    value = (np.maximum(z, 0) + np.maximum(back, 0) + np.log1p(e + f + e * f)).sum()
    heavy = even * total
    return np.concatenate([[value], even @ (p + q), odd @ (p - q), (heavy @ even.T).ravel(), ((odd * total) @ odd.T).ravel(), ((even * apart) @ odd.T).ravel()])


def _summed(v: np.ndarray, e: np.ndarray, o: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian in the features from sums of _terms()."""
    n, m = e.shape[1], o.shape[1]
    at = np.cumsum([1, n, m, n * n, m * m])
    g, h, a, b, c = (v[lo:hi] for lo, hi in zip(at, [*at[1:], None]))
    cross = e @ c.reshape(n, m) @ o.T
    return float(v[0]), e @ g + o @ h, e @ a.reshape(n, n) @ e.T + o @ b.reshape(m, m) @ o.T + cross + cross.T


@dataclass(frozen=True)
class TileRows(logistic.Rows):
    """The pairs of tiled nodes: features are made anew in every pass from the places of two blocks of nodes."""

    tiles: Tiles | None = None

    @cached_property
    def frame(self) -> Frame:
        """From the nodes' spread alone, so that sums of squares lose nothing; any centre would give the same results."""
        n = self.tiles.nodes.agg(*[f(a).alias(f"{k}{a}") for a in "xyz" for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        m, sd = (np.array([n[f"{k}{a}"] if n[f"{k}{a}"] is not None else 0.0 for a in "xyz"], float) for k in "ms")
        sd = np.where((sd > 0) & np.isfinite(sd), sd, 1.0)
        m = np.where(np.isfinite(m), m, 0.0)
        centre = np.concatenate([[0.0, np.log1p(np.sqrt(2 * (sd * sd).sum()))], 1.1 * sd, m])
        return Frame(centre, np.concatenate([[1.0, 1.0], sd, sd]), np.concatenate([np.ones(3), sd]))

    @cached_property
    def links(self) -> dict[tuple[int, int], np.ndarray]:
        """Edges and sums of their features between every two slabs."""
        features = geometry_features("spatial" if self.width > 7 else "relative" if self.width > 1 else "distance")
        rows = self.tiles.linked().select("s_slab", "t_slab", *[c.alias(n) for n, c in features.items()])
        rows = rows.groupBy("s_slab", "t_slab").agg(F.count("*").cast("double").alias("n"), *[F.sum(n).alias(n) for n in features])
        return {(r[0], r[1]): np.array([np.nan if x is None else x for x in r[2:]]) for r in rows.collect()}  # slabs squared

    def edges(self, spec: logistic.Spec) -> np.ndarray:
        """Edges and sums of their features with both ends in the slabs of a fit."""
        k = 1 + logistic._widths()[spec.feature_set]
        own = [v[:k] for (s, t), v in self.links.items() if spec.slabs is None or {s, t} <= spec.slabs]
        return np.sum(own, axis=0) if own else np.zeros(k)

    def _pass(self, specs: dict[str, logistic.Spec], per_fit, tiles: Tiles | None = None) -> dict[str, np.ndarray]:
        """Sum over unordered pairs of per_fit(name, even, odd) for every fit whose slabs hold both ends."""
        frame, items, of = self.frame, list(specs.items()), tiles or self.tiles
        widest = max(PARTS[s.feature_set][0] for s in specs.values())
        wanted = None if any(s.slabs is None for s in specs.values()) else frozenset((u, v) for s in specs.values() for u in s.slabs for v in s.slabs)

        def partial(each: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            for tile in each:
                for u, v, even, odd in frame.parts(tile, wanted, widest):
                    for name, spec in items:
                        if spec.slabs is None or u in spec.slabs and v in spec.slabs:
                            n_even, n_odd = PARTS[spec.feature_set]
                            got = per_fit(name, even[:n_even], odd[:n_odd])
                            totals[name] = totals[name] + got if name in totals else got
            if totals:
                yield logistic._named(totals)

        return logistic._collected(of.halves(partial, "name string, v array<double>"), self.parts)

    def moments(self, specs: dict[str, logistic.Spec]) -> dict[str, logistic.Moments]:
        """One pass, since places are centred beforehand: fits of the same slabs share it."""
        widest = max((s.feature_set for s in specs.values()), key=lambda f: PARTS[f][0])
        sets = {s.slabs: replace(s, feature_set=widest) for s in specs.values()}
        keys = {slabs: str(k) for k, slabs in enumerate(sets)}
        got = self._pass({keys[k]: s for k, s in sets.items()}, lambda _, e, o: np.concatenate([e.sum(axis=1), np.einsum("ij,ij->i", e, e), np.einsum("ij,ij->i", o, o)]))
        frame, (n_even, n_odd), out = self.frame, PARTS[widest], {}
        for name, spec in specs.items():
            v = got.get(keys[spec.slabs], np.zeros(2 * n_even + n_odd))
            bad = float((~np.isfinite(v)).sum())
            logistic._checked(name, v[0], 0, bad)
            first, square, odd = np.split(v / v[0], [n_even, 2 * n_even])
            mean = frame.centre[:n_even] + frame.even[:n_even] * first
            spread = frame.even[:n_even] ** 2 * np.maximum(square - first * first, 0.0)
            odd = frame.odd[:n_odd] ** 2 * odd
            middle, half = spread[5:], odd[3:]
            features = np.concatenate([mean[1:5], np.zeros(min(3, n_odd)), np.tile(mean[5:], 3)])
            squares = np.concatenate([spread[1:5], odd[:3], np.tile(middle + half, 2), middle]) if n_odd > 3 else np.concatenate([spread[1:5], odd[:3]])
            k = logistic._widths()[spec.feature_set]
            out[name] = logistic.Moments(2 * v[0], self.edges(spec)[0], features[:k], logistic._scale(squares[:k]))
        return out

    def _labels(self, spec: logistic.Spec, of: logistic.Moments) -> np.ndarray:
        """The sum over edges of 1 and the features less their mean over their scale."""
        v = self.edges(spec)
        return np.concatenate([v[:1], (v[1:] - v[0] * of.mean) / of.scale])

    def start(self, specs: dict[str, logistic.Spec], of: dict[str, logistic.Moments]) -> dict[str, np.ndarray]:
        """Coefficients at which the features of all edges are what some tiles' pairs, weighted up, would have."""
        total = self.tiles.n_nodes**2 // 2
        if total < START_FROM:
            return {}
        one_in = max(8, total // START_PAIRS)
        some = replace(self.tiles, blocks=self.tiles.blocks.where(F.pmod(F.xxhash64("i", "j"), F.lit(one_in)) == 0))
        there = self._pass(specs, lambda _, even, odd: np.array([2.0 * even.shape[1]]), some)
        open_, beta, out = {n: s for n, s in specs.items() if n in there}, {}, {}
        for n, spec in open_.items():
            p = (of[n].positives + 0.5) / (of[n].n + 1.0)
            beta[n] = np.concatenate([[np.log(p / (1 - p))], np.zeros(logistic._widths()[spec.feature_set])])
        for _ in range(START_ROUNDS):
            if not open_:
                break
            for n, (_, gradient, hessian) in self.newton_terms(open_, of, beta, some).items():
                weight, penalty = of[n].n / there[n][0], np.concatenate([[0.0], np.full(len(beta[n]) - 1, open_[n].l2)])
                step = np.linalg.lstsq(weight * hessian + np.diag(penalty), weight * gradient - self._labels(open_[n], of[n]) + penalty * beta[n], rcond=None)[0]
                beta[n] = beta[n] - step
                if not np.isfinite(beta[n]).all():
                    del open_[n]
                elif np.linalg.norm(step) < START_STEP:
                    out[n] = beta[n]
                    del open_[n]
        return out

    def newton_terms(self, specs, of, beta, tiles: Tiles | None = None):
        design = {n: self.frame.design(s.feature_set, of[n].mean, of[n].scale) for n, s in specs.items()}
        at = {n: (beta[n] @ e, beta[n] @ o) for n, (e, o) in design.items()}
        floor, out = logistic.WEIGHT_FLOOR, {}
        for n, v in self._pass(specs, lambda n, e, o: _terms(e, o, *at[n], floor), tiles).items():
            value, gradient, hessian = _summed(v, *design[n])
            out[n] = value, gradient, hessian
        if tiles is None:
            labels = {n: self._labels(s, of[n]) for n, s in specs.items()}
            out = {n: (value - float(labels[n] @ beta[n]), g - labels[n], h) for n, (value, g, h) in out.items()}
        return out

    def objectives(self, specs, of, trials):
        at = {n: [(b @ e, b @ o) for b in trials[n]] for n, s in specs.items() for e, o in [self.frame.design(s.feature_set, of[n].mean, of[n].scale)]}

        def values(n: str, even: np.ndarray, odd: np.ndarray) -> np.ndarray:
            out = []
            for be, bo in at[n]:
                ze = be @ even
                zo = bo @ odd if len(odd) else 0.0
                out.append(_softplus(ze + zo) + _softplus(ze - zo) if len(odd) else 2 * _softplus(ze))
            return np.array(out)

        labels = {n: self._labels(s, of[n]) for n, s in specs.items()}
        return {n: v - np.array([labels[n] @ b for b in trials[n]]) for n, v in self._pass(specs, values).items()}

    def gram(self, feature_set: str, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian at coefficients of raw features."""
        spec = logistic.Spec("gram", feature_set, 1.0)
        k = len(beta) - 1
        raw = logistic.Moments(0, 0, np.zeros(k), np.ones(k))
        e, o = self.frame.design(feature_set, raw.mean, raw.scale)
        at = beta @ e, beta @ o
        _, gradient, hessian = _summed(self._pass({"gram": spec}, lambda _, even, odd: _terms(even, odd, *at, 0.0))["gram"], e, o)
        return gradient - self._labels(spec, raw), hessian

    def slab_bits(self, fitted: dict[str, logistic.GeometryModel], n_slabs: int, only: frozenset[int] | None = None) -> dict[tuple[int, str], float]:
        """Bits of all pairs as if unconnected, in the tiles, and what edges add to them, from the edges."""
        slabs = [u for u in range(n_slabs) if only is None or u in only]
        specs = {f"{u}|{n}": logistic.Spec(n, m.name, 1.0, frozenset([u])) for n, m in fitted.items() for u in slabs}
        at = {n: (m.coefficients @ e, m.coefficients @ o) for n, m in fitted.items() for e, o in [self.frame.design(m.name, m.means, m.scales)]}

        def none(key: str, even: np.ndarray, odd: np.ndarray) -> np.ndarray:
            be, bo = at[key.split("|", 1)[1]]
            ze = be @ even
            ways = (ze + bo @ odd, ze - bo @ odd) if len(odd) else (ze, ze)
            return np.array([sum(-np.log2(1 - logistic._clipped(z)).sum() for z in ways)])

        out = {(u, n): 0.0 for n in fitted for u in slabs}
        for key, v in self._pass(specs, none).items():
            u, n = key.split("|", 1)
            out[int(u), n] += float(v[0])
        widths, names = logistic._widths(), list(geometry_features("spatial" if self.width > 7 else "relative" if self.width > 1 else "distance").items())

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = {n: np.zeros(n_slabs) for n in fitted}
            for batch in batches:
                slab, *x = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
                x = np.column_stack(x)
                for n, m in fitted.items():
                    p = logistic._clipped((x[:, : widths[m.name]] - m.means) / m.scales @ m.coefficients[1:] + m.coefficients[0])
                    totals[n] += np.bincount(slab, weights=np.log2(1 - p) - np.log2(p), minlength=n_slabs)
            yield logistic._named(totals)

        links = self.tiles.linked().where("s_slab = t_slab").select("s_slab", *[c.alias(k) for k, c in names])
        for n, v in logistic._collected(links.mapInArrow(more, "name string, v array<double>"), logistic.DRIVER_PARTS + 1).items():
            for u in slabs:
                out[u, n] += float(v[u])
        return out
