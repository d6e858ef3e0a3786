"""Ridge-logistic geometry models by Newton's method over Arrow passes, many fits to a pass.

The pair table is read once and kept as packed blocks (features, label, slabs as binary), so a pass sends a few large
values to Python and builds nothing anew. Each task adds up, for every fit that is still open, the moments, or gradient,
Hessian and objective of the rows that belong to it; partial sums are added up, and the driver solves systems of at most
17 unknowns. So a nested cross-validation of a hundred fits takes as many passes as its slowest fit takes iterations,
not a hundred times that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import CLIP, geometry_features, sigmoid
from latticebits.operators.tiles import Tiles

SCALE_FLOOR, WEIGHT_FLOOR = 1e-12, 1e-8
NEWTON_STEP, NEWTON_ROUNDS = 1e-8, 100
DAMPED_GRADIENT, DAMPED_STEP, DAMPED_ROUNDS = 1e-10, 1e-8, 500
BLOCK_ROWS = 16_384
#: Partial sums of at most so many tasks go to the driver; of more, they are added by a group-by first.
DRIVER_PARTS = 64
ARMIJO, SHRINK, BACKTRACKS, TRIALS_A_PASS = 1e-4, 0.5, 31, 8


class FitError(RuntimeError):
    pass


@dataclass(frozen=True)
class Spec:
    """One fit: a name, a feature set, a penalty, and the slabs both ends must be in (None: all pairs)."""

    name: str
    feature_set: str
    l2: float
    slabs: frozenset[int] | None = None


@dataclass
class GeometryModel:
    spec: Spec
    coefficients: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    iterations: int
    converged: bool
    objectives: list[float] = field(default_factory=list)
    backtracks: int = 0
    scaled_gradient: float | None = None

    @property
    def name(self) -> str:
        return self.spec.feature_set

    @property
    def model_bits(self) -> int:
        return 64 * (len(self.coefficients) + len(self.means) + len(self.scales))

    def probability(self) -> Column:
        """p as a sum of literal coefficients times features: no Python in the plan."""
        z = F.lit(float(self.coefficients[0]))
        for c, b, m, s in zip(geometry_features(self.spec.feature_set).values(), self.coefficients[1:], self.means, self.scales):
            z = z + (c - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
        return sigmoid(z)

    def predict(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("p", self.probability())


def _widths() -> dict[str, int]:
    return {"distance": 1, "relative": 7, "spatial": 16}


def _design(pairs: DataFrame, feature_set: str = "spatial") -> DataFrame:
    """The features of a set (smaller sets are the first columns of larger ones), label and slabs as plain columns."""
    features = geometry_features(feature_set)
    slab = [F.col(c).cast("int") if c in pairs.columns else F.lit(0) for c in ("s_slab", "t_slab")]
    return pairs.select(*[c.alias(n) for n, c in features.items()], F.col("connected").cast("double").alias("y"), slab[0].alias("s_slab"), slab[1].alias("t_slab"))


@dataclass(frozen=True)
class Rows:
    """Pairs as persisted blocks of at most BLOCK_ROWS rows: x (`width` doubles a row), y, s and t (slabs) as binary."""

    blocks: DataFrame
    parts: int
    width: int

    def batches(self, f, schema: str) -> DataFrame:
        """f over an iterator of (x, y, s, t) of each task's blocks."""
        width = self.width

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for x, y, s, t in zip(*batch.columns):
                    yield (
                        np.frombuffer(x.as_buffer()).reshape(-1, width),
                        np.frombuffer(y.as_buffer(), np.int8).astype(float),
                        np.frombuffer(s.as_buffer(), np.int32),
                        np.frombuffer(t.as_buffer(), np.int32),
                    )

        return self.blocks.mapInArrow(lambda batches: f(unpacked(batches)), schema)

    def moments(self, specs: dict[str, Spec]) -> dict[str, Moments]:
        """Rows, positives, mean and scale of every fit."""

        def sums(_: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            bad = float((~np.isfinite(x)).sum()), float(((y != 0) & (y != 1)).sum())
            return np.concatenate([[len(y), y.sum(), *bad], x.sum(axis=0)])

        first = _pass(self, specs, sums)
        for name in specs:
            _checked(name, *(first[name][:4] if name in first else (0, 0, 0, 0)))
        mean = {n: v[4:] / v[0] for n, v in first.items()}
        second = _pass(self, specs, lambda n, x, y: ((x - mean[n]) ** 2).sum(axis=0))
        return {n: Moments(v[0], v[1], mean[n], _scale(second[n] / v[0])) for n, v in first.items()}

    def newton_terms(self, specs: dict[str, Spec], of: dict[str, Moments], beta: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
        """Objective, gradient and Hessian of every fit, without its penalty."""

        def terms(n: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = np.column_stack([np.ones(len(y)), (x - of[n].mean) / of[n].scale])
            z = a @ beta[n]
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
            w = np.clip(p * (1 - p), WEIGHT_FLOOR, None)
            return np.concatenate([[(np.maximum(z, 0) + np.log1p(e) - y * z).sum()], a.T @ (p - y), (a.T @ (w[:, None] * a)).ravel()])

        out = {}
        for n, v in _pass(self, specs, terms).items():
            k = len(beta[n])
            out[n] = v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)
        return out

    def objectives(self, specs: dict[str, Spec], of: dict[str, Moments], trials: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
        """Objectives of every fit at these coefficients, without its penalty."""

        def values(n: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = (x - of[n].mean) / of[n].scale
            return np.array([_objective(a, y, b) for b in trials[n]])

        return _pass(self, specs, values)

    def start(self, specs: dict[str, Spec], of: dict[str, Moments]) -> dict[str, np.ndarray]:
        """Coefficients to start from, where there are better ones than the rate alone."""
        return {}

    def slab_bits(self, fitted: dict[str, GeometryModel], n_slabs: int, only: frozenset[int] | None = None) -> dict[tuple[int, str], float]:
        widths = _widths()

        def partial(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            totals = {name: np.zeros(n_slabs) for name in fitted}
            for x, y, s, t in blocks:
                inside = s == t
                x, y, slab = x[inside], y[inside], s[inside]
                for name, m in fitted.items():
                    p = _clipped((x[:, : widths[m.name]] - m.means) / m.scales @ m.coefficients[1:] + m.coefficients[0])
                    totals[name] += np.bincount(slab, weights=-np.log2(np.where(y == 1, p, 1 - p)), minlength=n_slabs)
            yield _named(totals)

        sums = self.batches(partial, "name string, v array<double>").select("name", F.posexplode("v").alias("slab", "bits")).groupBy("name", "slab").agg(F.sum("bits").alias("bits"))
        return {(r["slab"], r["name"]): r["bits"] for r in sums.collect() if only is None or r["slab"] in only}  # slabs times models


@dataclass(frozen=True)
class Moments:
    """Rows and positives of a fit, mean and scale of its features."""

    n: float
    positives: float
    mean: np.ndarray
    scale: np.ndarray


def _checked(name: str, n: float, positives: float, bad: float, labels: float = 0) -> None:
    if not n:
        raise ValueError(f"cannot fit to no pairs: {name}")
    if bad or labels:
        raise ValueError(f"{name}: {bad:.0f} features aren't finite, {labels:.0f} labels aren't 0 or 1")


def _scale(square: np.ndarray) -> np.ndarray:
    return np.where((sd := np.sqrt(np.maximum(square, 0.0))) > SCALE_FLOOR, sd, 1.0)


def _clipped(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.clip(np.where(z >= 0, 1 / (1 + e), e / (1 + e)), CLIP, 1 - CLIP)


def _named(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], ["name", "v"])


@contextmanager
def packed(pairs: DataFrame, feature_set: str = "spatial"):
    """Rows of pairs with the features that a set and smaller ones need, kept while the context is open."""
    columns, width = ["x", "y", "s", "t"], _widths()[feature_set]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.slice(lo, BLOCK_ROWS).columns]
                y = np.asarray(part[width], dtype=float)
                label = np.where((y == 0) | (y == 1), y, -1).astype(np.int8)  # anything else is told by the moments
                packed_ = (np.column_stack(part[:width]).astype(float).tobytes(), label.tobytes(), *(np.asarray(p, dtype=np.int32).tobytes() for p in part[width + 1 :]))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed_], columns)

    with _rows_to_a_batch(pairs, BLOCK_ROWS):
        blocks = _design(pairs, feature_set).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).persist()
        try:
            yield Rows(blocks, blocks.rdd.getNumPartitions(), width)
        finally:
            blocks.unpersist()


@contextmanager
def tile_rows(tiles: Tiles, feature_set: str = "spatial"):
    """The pairs of tiled nodes, their blocks kept while the context is open."""
    from latticebits.operators.tile_fits import TileRows

    with tiles.kept() as kept:
        yield TileRows(kept.blocks, kept.parts, _widths()[feature_set], kept)


@contextmanager
def _rows_to_a_batch(df: DataFrame, n: int):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(key)
    df.sparkSession.conf.set(key, str(n))
    try:
        yield
    finally:
        df.sparkSession.conf.set(key, before)


def _pass(rows: Rows, specs: dict[str, Spec], per_fit) -> dict[str, np.ndarray]:
    """Sum over rows of per_fit(name, X, y), a flat vector, for each spec."""
    widths, items = _widths(), list(specs.items())

    def partial(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for x, y, s, t in blocks:
            chosen: dict[frozenset | None, tuple[np.ndarray, np.ndarray]] = {None: (x, y)}
            for name, spec in items:
                if spec.slabs not in chosen:
                    inside = np.isin(s, list(spec.slabs)) & np.isin(t, list(spec.slabs))
                    chosen[spec.slabs] = x[inside], y[inside]
                xs, ys = chosen[spec.slabs]
                got = per_fit(name, xs[:, : widths[spec.feature_set]], ys)
                totals[name] = totals[name] + got if name in totals else got
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], ["name", "v"])

    return _collected(rows.batches(partial, "name string, v array<double>"), rows.parts)


def _collected(partials: DataFrame, parts: int) -> dict[str, np.ndarray]:
    """The sums by name of the arrays v that tasks send as (name, v)."""
    if parts > DRIVER_PARTS:
        sums = partials.select("name", F.posexplode("v").alias("i", "v")).groupBy("name", "i").agg(F.sum("v").alias("v"))
        partials = sums.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("v"))  # 290 values a fit
    out: dict[str, np.ndarray] = {}
    for row in partials.collect():
        out[row["name"]] = out.get(row["name"], 0) + np.array(row["v"])
    return out


def _objective(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> float:
    z = x @ beta[1:] + beta[0]
    return float((np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z).sum())


def fit_many(pairs: DataFrame | Rows, specs: list[Spec], solver: str = "newton") -> dict[str, GeometryModel]:
    """Every spec fitted to pairs (s_slab and t_slab where specs name slabs), read once; Rows of several fits are shared.

    `newton` takes full steps; `damped` takes Armijo steps and stops on the scaled gradient too. A fit that doesn't
    converge, or meets a value that isn't finite, is an error."""
    if solver not in ("newton", "damped"):
        raise ValueError("solver must be newton or damped")
    if any(s.l2 <= 0 for s in specs):
        raise ValueError("l2 must be positive")
    todo = {s.name: s for s in specs}
    if len(todo) != len(specs):
        raise ValueError("fits must have different names")
    if not isinstance(pairs, Rows):
        with packed(pairs, max((s.feature_set for s in specs), key=_widths().get)) as rows:
            return fit_many(rows, specs, solver)
    design = pairs

    of = design.moments(todo)
    widths = _widths()
    beta, history, backtracks, out = design.start(todo, of), {n: [] for n in todo}, dict.fromkeys(todo, 0), {}
    for n in todo:
        if n not in beta:
            p = (of[n].positives + 0.5) / (of[n].n + 1.0)
            beta[n] = np.concatenate([[np.log(p / (1 - p))], np.zeros(widths[todo[n].feature_set])])

    def done(n: str, rounds: int, gradient: float | None) -> None:
        out[n] = GeometryModel(todo[n], beta[n], of[n].mean, of[n].scale, rounds, True, history[n], backtracks[n], gradient)

    open_, limit, known = dict(todo), NEWTON_ROUNDS if solver == "newton" else DAMPED_ROUNDS, {}
    for turn in range(1, limit + 1):
        missing = {n: s for n, s in open_.items() if n not in known}
        terms = known | (design.newton_terms(missing, of, beta) if missing else {})
        direction, slope, base = {}, {}, {}
        for n in list(open_):
            k, l2 = len(beta[n]), todo[n].l2
            penalty = np.ones(k)
            penalty[0] = 0.0
            base[n] = terms[n][0] + 0.5 * l2 * float((penalty * beta[n] ** 2).sum())
            gradient = terms[n][1] + l2 * penalty * beta[n]
            hessian = terms[n][2] + l2 * np.diag(penalty)
            if not np.isfinite(base[n]):
                raise FitError(f"{n}: the objective isn't finite")
            if solver == "damped":
                if not history[n]:
                    history[n].append(base[n])
                steepest = float(np.abs(gradient).max()) / max(1.0, of[n].n)
                if steepest <= DAMPED_GRADIENT:
                    done(n, turn, steepest)
                    del open_[n]
                    continue
            try:
                direction[n] = np.linalg.solve(hessian, gradient)
            except np.linalg.LinAlgError:
                direction[n] = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if not np.isfinite(direction[n]).all():
                raise FitError(f"{n}: the direction isn't finite")
            slope[n] = float(gradient @ direction[n])
            if solver == "damped" and slope[n] <= 0:
                raise FitError(f"{n}: no descent direction")
        if solver == "newton":
            for n in direction:
                beta[n] = beta[n] - direction[n]
                if np.linalg.norm(direction[n]) < NEWTON_STEP:
                    done(n, turn, None)
                    del open_[n]
        else:
            known = _line_search(design, open_, todo, of, beta, direction, slope, base, history, backtracks)
            for n in direction:
                if np.linalg.norm(direction[n]) <= DAMPED_STEP * (1 + np.linalg.norm(beta[n])):
                    done(n, turn, None)
                    del open_[n]
        if not open_:
            return out
    raise FitError(f"no convergence after {limit} iterations: {sorted(open_)[0]}")


def _line_search(design, open_, todo, of, beta, direction, slope, base, history, backtracks) -> dict[str, tuple]:
    """Armijo steps; direction becomes the step taken. The first pass tries the whole step, which nearly always does, and
    makes what the next round asks for there, which is returned; later ones try TRIALS_A_PASS shorter lengths of every fit
    that is still waiting."""
    waiting, known = {n: open_[n] for n in direction}, {}
    if not waiting:
        return known
    for lo in (0, *range(1, BACKTRACKS, TRIALS_A_PASS)):
        lengths = [SHRINK**k for k in range(lo, min(lo + TRIALS_A_PASS if lo else 1, BACKTRACKS))]

        if lo:
            got = design.objectives(waiting, of, {n: [beta[n] - length * direction[n] for length in lengths] for n in waiting})
        else:
            whole = design.newton_terms(waiting, of, {n: beta[n] - direction[n] for n in waiting})
            got = {n: [terms[0]] for n, terms in whole.items()}
        for n in list(waiting):
            for k, length in enumerate(lengths):
                new = beta[n] - length * direction[n]
                value = got[n][k] + 0.5 * todo[n].l2 * float((new[1:] ** 2).sum())
                if np.isfinite(value) and value <= base[n] - ARMIJO * length * slope[n]:
                    beta[n], direction[n] = new, length * direction[n]
                    history[n].append(value)
                    backtracks[n] += lo + k
                    if not lo:
                        known[n] = whole[n]
                    del waiting[n]
                    break
        if not waiting:
            return known
    raise FitError(f"line search failed after {BACKTRACKS} trials: {sorted(waiting)[0]}")


def slab_bits(rows: Rows, fitted: dict[str, GeometryModel], n_slabs: int, only: frozenset[int] | None = None) -> dict[tuple[int, str], float]:
    """Code length inside each slab, or only these, under each model, in one pass: the plan of dozens of literal models
    would be too large for generated code."""
    return rows.slab_bits(fitted, n_slabs, only)


def fit(pairs: DataFrame, feature_set: str = "relative", l2: float = 1.0, solver: str = "newton") -> GeometryModel:
    return fit_many(pairs, [Spec("fit", feature_set, l2)], solver)["fit"]


def gram(pairs: DataFrame | Tiles, feature_set: str, beta: list[float]) -> dict[str, np.ndarray]:
    """Gradient and Hessian of the unpenalised objective at given coefficients of raw features: one pass."""
    b = np.array(beta)

    def terms(_: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(y)), x])
        p = 1 / (1 + np.exp(-np.clip(a @ b, -700, 700)))
        return np.concatenate([a.T @ (p - y), (a.T @ ((p * (1 - p))[:, None] * a)).ravel()])

    if isinstance(pairs, Tiles):
        with tile_rows(pairs, feature_set) as rows:
            gradient, hessian = rows.gram(feature_set, b)
        return {"gradient": gradient, "hessian": hessian}
    with packed(pairs, feature_set) as rows:
        v = _pass(rows, {"gram": Spec("gram", feature_set, 1.0)}, terms)["gram"]
    return {"gradient": v[: len(b)], "hessian": v[len(b) :].reshape(len(b), len(b))}
