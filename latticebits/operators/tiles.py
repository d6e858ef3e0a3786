"""The pair relation tile by tile: what a task needs of all pairs of two blocks of nodes.

Nodes are dealt to blocks by ranges of their id's hash, pair counts to tiles (source block, target block) by the same. A
tile's row holds both blocks and its counts, so a task expands, labels, measures, bins or fits all its pairs by itself:
no pair is shuffled, zeros are filled in the tile, and what is kept between passes is nodes and edges, never pairs.

A block has about BLOCK nodes, worked on PANEL pairs at a time. Blocks are made smaller where there would be fewer tiles
than cores, and larger where there would be more than MAX_BLOCKS: a node is sent to a tile of every other block, so what
is kept grows with the nodes and edges, not with the pairs.

Pairs are made both ways from a tile on or above the diagonal: a run of RUN pairs out of a source, then the same pairs the
other way round. So a distance is measured once, and in a file its second run is a copy of the one just before, which any
codec takes for a few bytes; ids, types and places of a run repeat from source to source.

Distances are the same both ways, so what needs them alone measures tiles on and above the diagonal and counts twice. Such
passes take the blocks without their edges; what edges add to them comes from two joins of the edges with their nodes, and
counts by slabs or types need no tile at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import bin_of
from latticebits.operators import graph, ranking, selection

BLOCK, MAX_BLOCKS, PANEL = 2048, 64, 1 << 16
#: Pairs of a run: some runs and their copies lie within the 64 kB that a codec looks back.
RUN = 512
#: Distances worked on at a time where they are only counted, few enough for a core's cache; buckets of their histogram,
#: and of each wanted bucket's own.
MEASURED, BUCKETS, SUBBUCKETS = 1 << 16, 1 << 17, 1 << 12
#: Pairs in wanted buckets that are few enough to be taken along without a second histogram.
FEW = 4_000_000
_NODE = ("id", "type", "x", "y", "z", "slab")
PAIRS = "source long, target long, source_type string, target_type string, distance double, sx double, sy double, sz double, tx double, ty double, tz double, synapse_count long, connected int"


class Panel:
    """Some sources of a tile with all its targets: numpy arrays, one value a pair, measured where they are asked for."""

    def __init__(self, tile: Tile, source: np.ndarray, target: np.ndarray, count: np.ndarray):
        self.tile, self.source, self.target, self.count = tile, source, target, count  # places in the tile's blocks

    @cached_property
    def delta(self) -> tuple[np.ndarray, ...]:
        return tuple(self.tile.t[a][self.target] - self.tile.s[a][self.source] for a in "xyz")

    @cached_property
    def distance(self) -> np.ndarray:
        d = self.delta
        return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def where(self, keep: np.ndarray) -> Panel:
        return self if keep.all() else Panel(self.tile, self.source[keep], self.target[keep], self.count[keep])


class Run:
    """Unordered pairs of a tile, each to be taken both ways: places of sources and targets, rows by columns, or one for each
    pair in one row; counts from source to target and back."""

    def __init__(self, tile: Tile, a: np.ndarray, b: np.ndarray, count: np.ndarray, back: np.ndarray):
        self.tile, self.a, self.b, self.count, self.back = tile, a, b, count, back

    def where(self, keep: np.ndarray) -> Run:
        if keep.all():
            return self
        a, b = (np.broadcast_to(x, keep.shape)[keep] for x in (self.a, self.b))
        return Run(self.tile, a[None, :], b[None, :], self.count[keep][None, :], self.back[keep][None, :])

    @cached_property
    def distance(self) -> np.ndarray:
        return self.tile.distance(self.a, self.b)

    def both(self, there: np.ndarray, back: np.ndarray) -> np.ndarray:
        """A value for each pair, out of each row's sources and then the other way round."""
        out = np.empty((self.count.shape[0], 2, self.count.shape[1]), there.dtype)
        out[:, 0], out[:, 1] = there, back
        return out.ravel()

    def ends(self, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the nodes of both blocks, as those of the pairs' sources and of their targets."""
        there, back = s[self.a], t[self.b]
        return self.both(there, back), self.both(back, there)


class Tile:
    """One row of the tile table as arrays: s and t hold id, type, x, y, z and slab of both blocks."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda c: batch.column(batch.schema.get_field_index(c))[row].values
        self.s, self.t = ({c: value(f"{end}_{c}") if c == "type" else value(f"{end}_{c}").to_numpy(zero_copy_only=False) for c in _NODE} for end in "st")
        edges = [value(f"e_{c}") if f"e_{c}" in batch.schema.names else None for c in ("pre", "post", "count")]
        pre, post, count = (np.zeros(0, np.int64) if e is None else e.to_numpy(zero_copy_only=False) for e in edges)
        self.blank = [np.logical_or.reduce([value(f"{end}_{c}").is_null().to_numpy(zero_copy_only=False) for c in "xyz"]) for end in "st"]
        self.i, self.j = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in "ij")
        self._edges = pre, post, count
        self.place, self.number = self._placed(pre, post)

    def _placed(self, pre: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, of = _met(self.s["id"], self.t["id"], pre, post)
        place, number = a * len(self.t["id"]) + b, self._edges[2][of]
        order = np.argsort(place)
        return place[order], number[order]

    @cached_property
    def back(self) -> tuple[np.ndarray, np.ndarray]:
        """place and number of the edges from a target to a source, in a tile that has them."""
        return self._placed(*self._edges[1::-1])

    def counted(self, edges: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> np.ndarray:
        """The counts among these edges of the pairs of sources lo to hi with all targets."""
        width, (place, number) = len(self.t["id"]), edges
        count = np.zeros((hi - lo) * width, np.int64)
        own = slice(*np.searchsorted(place, [lo * width, hi * width]))
        count[place[own] - lo * width] = number[own]
        return count.reshape(hi - lo, width)

    def runs(self) -> Iterator[Run]:
        """All unordered pairs of different nodes, in a tile on or above the diagonal."""
        s, t, own = self.s["id"], self.t["id"], self.i == self.j
        rows = max(1, PANEL // max(1, len(t)))
        for lo in range(0, len(s) if len(t) else 0, rows):
            hi = min(lo + rows, len(s))
            counts = self.counted((self.place, self.number), lo, hi), self.counted(self.back, lo, hi)
            for first in range(0, len(t), RUN):
                a, b = np.arange(lo, hi), np.arange(first, min(first + RUN, len(t)))
                if own and b[-1] <= lo:
                    continue
                run = Run(self, a[:, None], b[None, :], *[c[:, b[0] : b[-1] + 1] for c in counts])
                yield run.where((a[:, None] < b[None, :]) & (s[a, None] != t[None, b])) if own and (b[0] < hi or s[hi - 1] == t[b[0]]) else run

    def panels(self) -> Iterator[Panel]:
        """All pairs of different nodes."""
        s, t, width = self.s, self.t, len(self.t["id"])
        step = max(1, PANEL // max(1, width))
        for lo in range(0, len(s["id"]), step):
            hi = min(lo + step, len(s["id"]))
            count = self.counted((self.place, self.number), lo, hi).ravel()
            panel = Panel(self, np.repeat(np.arange(lo, hi), width), np.tile(np.arange(width), hi - lo), count)
            yield panel.where((s["id"][lo:hi, None] != t["id"][None, :]).ravel())

    def same(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows with the same id in both blocks: no pairs."""
        ids = self.s["id"] if self.i == self.j else np.zeros(0, np.int64)
        first = np.unique(ids)
        return _met(self.s["id"], self.t["id"], first, first)[:2]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = [self.t[c][b] - self.s[c][a] for c in "xyz"]
        return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def measured(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Distances of these sources (rows, panel by panel, with their slice of a) from these targets."""
        s, t = [self.s[c][a] for c in "xyz"], [self.t[c][b] for c in "xyz"]
        step = max(1, MEASURED // max(1, len(b)))
        for lo in range(0, len(a) if len(b) else 0, step):
            rows = slice(lo, min(lo + step, len(a)))
            total = t[0][None, :] - s[0][rows, None]
            total *= total
            for c in (1, 2):
                d = t[c][None, :] - s[c][rows, None]
                d *= d
                total += d
            yield rows, np.sqrt(total, out=total)

    def inside(self, slabs: frozenset[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes in these slabs; None: all."""
        return tuple(np.arange(len(end["id"])) if slabs is None else np.flatnonzero(np.isin(end["slab"], list(slabs))) for end in (self.s, self.t))

    def apart(self, slabs: frozenset[int] | None) -> Iterator[np.ndarray]:
        """Distances of the unordered pairs with both ends in these slabs and finite places: each once, in a tile on or
        above the diagonal."""
        if self.i > self.j:
            return
        a, b = (k[np.isfinite(end["x"][k] + end["y"][k] + end["z"][k])] for k, end in zip(self.inside(slabs), (self.s, self.t)))
        for rows, d in self.measured(a, b):
            yield d.ravel() if self.i < self.j else d[self.s["id"][a[rows], None] < self.t["id"][None, b]]


def _met(s: np.ndarray, t: np.ndarray, pre: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in s and t (in order) that hold pre and post, and which of these: once each, unless ids repeat."""
    a, b = ((np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")) for ids, own in ((s, pre), (t, post)))
    n = (a[1] - a[0]) * (b[1] - b[0])
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    p, q = np.divmod(k, np.repeat(b[1] - b[0], n))
    return a[0][of] + p, b[0][of] + q, of


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """round(x, digits) of distances as Spark has it: halves of the shortest decimal form go up. What lies near a half is
    rounded as a decimal, number by number."""
    y = x * 10.0**digits
    whole = np.floor(y + 0.5)
    far = np.isfinite(x) & (y >= 2.0**50)
    with np.errstate(invalid="ignore"):
        near = (np.abs(np.abs(y - whole) - 0.5) < 1e-15 * y + 1e-12) & ~far
    out = np.where(np.isfinite(x) & ~far, whole / 10.0**digits, x)
    for at in zip(*np.nonzero(near | far & (x < 2.0**53))):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Bins:
    """Which of the bins between these edges a distance below `top` is in: a table of buckets, each with one edge at most."""

    def __init__(self, edges: np.ndarray, top: float, size: int = 4096):
        self.edges, self.cut = edges, None
        self.scale = (size - 1) / top if 0 < top < np.inf else 0.0
        if self.scale and np.isfinite(self.scale) and np.isfinite(edges).all():
            own = np.minimum(edges * self.scale, size - 1).astype(np.intp)
            near = edges <= top  # no distance is in a bin beyond
            if len(np.unique(own[near])) == near.sum() and (edges >= 0).all():
                self.cut = np.full(size, np.inf)
                self.cut[own[near]] = edges[near]
                self.low = np.searchsorted(own[near], np.arange(size), "left")

    def of(self, d: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.searchsorted(self.edges, d, side="right")
        bucket = (d * self.scale).astype(np.intp)
        return self.low[bucket] + (d >= self.cut[bucket])


@dataclass(frozen=True)
class Tiles:
    """The tile table, and of its tiles on and above the diagonal: mirrored with the edges of both directions, blocks without
    edges, which kept() holds in memory. near: pairs farther apart than this count as unconnected."""

    table: DataFrame
    mirrored: DataFrame
    n_nodes: int
    parts: int
    blocks: DataFrame
    nodes: DataFrame
    counts: DataFrame
    near: float | None = None

    @contextmanager
    def kept(self):
        blocks = self.blocks.persist()
        try:
            yield replace(self, blocks=blocks)
        finally:
            blocks.unpersist()

    def linked(self) -> DataFrame:
        """The rows of pairs() that have an edge, with s_slab and t_slab, from the edges."""
        rows = graph.connected_pairs(self.nodes, self.counts, self.n_nodes)
        return rows if self.near is None else rows.where(F.col("distance") <= F.lit(self.near))

    def halves(self, f, schema: str) -> DataFrame:
        """tasks() over the blocks: every unordered pair once, no edges."""
        return _over(self.blocks, f, schema)

    def scan(self, f, schema: str) -> DataFrame:
        """f over an iterator of each task's (tile, panel), record batches out."""
        near = self.near

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[Tile, Panel]]:
                for batch in batches:
                    for row in range(batch.num_rows):
                        tile = Tile(batch, row)
                        for panel in tile.panels():
                            if near is not None:
                                panel.count = np.where(panel.distance <= near, panel.count, 0)
                            yield tile, panel

            yield from f(each())

        return self.table.mapInArrow(run, schema)

    def runs(self, f, schema: str) -> DataFrame:
        """f over an iterator of each task's runs, record batches out: every unordered pair once, with its edges both ways."""
        near = self.near

        def each(tiles: Iterator[Tile]) -> Iterator[Run]:
            for tile in tiles:
                for run in tile.runs():
                    if near is not None and (run.count.any() or run.back.any()):
                        close = run.distance <= near
                        run.count, run.back = run.count * close, run.back * close
                    yield run

        return _over(self.mirrored, lambda tiles: f(each(tiles)), schema)

    def pairs(self, *columns: str, same_slab: bool = False, digits: int | None = None) -> DataFrame:
        """Every pair with its label, as graph.labelled_pairs() has it, or these of its columns; s_slab and t_slab may be
        named too. same_slab: only pairs inside a slab. digits: the distance is rounded so, as round() does."""
        types = dict(c.split() for c in (PAIRS + ", s_slab int, t_slab int").split(", "))
        names = list(columns) or [c.split()[0] for c in PAIRS.split(", ")]

        def expand(runs: Iterator[Run]) -> Iterator[pa.RecordBatch]:
            for r in runs:
                tile = r.tile
                if same_slab:
                    r = r.where(tile.s["slab"][r.a] == tile.t["slab"][r.b])
                if not r.count.size:
                    continue
                made: dict[str, np.ndarray | pa.Array] = {}
                for pair, own in ((("source", "target"), "id"), (("s_slab", "t_slab"), "slab"), *(((f"s{c}", f"t{c}"), c) for c in "xyz")):
                    if set(pair) & set(names):
                        made |= zip(pair, r.ends(tile.s[own], tile.t[own]))
                if {"source_type", "target_type"} & set(names):
                    kinds, n = pa.concat_arrays([tile.s["type"], tile.t["type"]]), len(tile.s["id"])
                    made |= zip(("source_type", "target_type"), (kinds.take(pa.array(at)) for at in r.ends(np.arange(n), np.arange(n, len(kinds)))))
                if "distance" in names:
                    d = r.distance if digits is None else half_up(r.distance, digits)
                    blank = tile.blank[0][r.a] | tile.blank[1][r.b] if tile.blank[0].any() or tile.blank[1].any() else None
                    made["distance"] = pa.array(r.both(d, d), mask=None if blank is None else r.both(blank, blank))
                made["synapse_count"] = r.both(r.count, r.back)
                made["connected"] = (made["synapse_count"] > 0).astype(np.int32)
                for c in ("s_slab", "t_slab"):
                    if c in names:
                        made[c] = made[c].astype(np.int32)
                yield pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names], names)

        return self.runs(expand, ", ".join(f"{n} {types[n]}" for n in names))

    def tasks(self, f, schema: str) -> DataFrame:
        """f over an iterator of each task's tiles, record batches out."""

        return _over(self.table, f, schema)

    def quantiles(self, levels: list[float], slabs: frozenset[int] | None = None) -> list[float] | None:
        """Exact linear quantiles of the distances of pairs with both ends in these slabs, None without pairs.

        A histogram of all distances tells which of its buckets hold the wanted ranks, another divides these where they
        hold much; what is left is taken along, value by value, and the ranks are looked up there."""
        box = self.blocks.agg(*[f(g(f"s_{a}")).alias(f"{h}_{a}") for a in "xyz" for h, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))]).first()
        if any(v is None for v in box):
            return None
        top = float(np.sqrt(sum((box[f"high_{a}"] - box[f"low_{a}"]) ** 2 for a in "xyz")))
        if not np.isfinite(top):
            return selection.quantiles(self.distances(slabs), "distance", levels)
        scale = (BUCKETS - 1) / top if top else 0.0
        scale = scale if np.isfinite(scale) else 0.0
        bucket = lambda d: np.minimum(d * scale, BUCKETS - 1).astype(np.intp)

        def counts(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BUCKETS, np.int64)
            for tile in tiles:
                for d in tile.apart(slabs):
                    total += np.bincount(bucket(d), minlength=BUCKETS)
            yield _filled(total)

        cells = self._added(counts, BUCKETS)
        half = int(cells.sum())
        if not half:
            return None
        spots = [level * (2 * half - 1) for level in levels]
        ranks = sorted({r // 2 for spot in spots for r in (int(spot), min(int(spot) + 1, 2 * half - 1))})  # a distance stands there twice
        wanted = np.unique(np.searchsorted(np.cumsum(cells), ranks, side="right"))
        place = np.full(BUCKETS, -1)
        place[wanted] = np.arange(len(wanted))
        sub = lambda d, k: np.clip((d * scale - wanted[k]) * SUBBUCKETS, 0, SUBBUCKETS - 1).astype(np.intp) + k * SUBBUCKETS
        inner = None
        if int(cells[wanted].sum()) > FEW and scale:

            def finer(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(wanted) * SUBBUCKETS, np.int64)
                for tile in tiles:
                    for d in tile.apart(slabs):
                        k = place[bucket(d)]
                        total += np.bincount(sub(d[k >= 0], k[k >= 0]), minlength=len(total))
                yield _filled(total)

            within = self._added(finer, len(wanted) * SUBBUCKETS)
            width = np.ones(BUCKETS, np.int64)
            width[wanted] = SUBBUCKETS
            first = np.cumsum(width) - width
            inner = (first[wanted][:, None] + np.arange(SUBBUCKETS)).ravel()
            cells, coarse = np.zeros(int(width.sum()), np.int64), cells
            cells[first] = np.where(width == 1, coarse, 0)
            cells[inner] = within
        at = np.searchsorted(np.cumsum(cells), ranks, side="right")
        taken = np.zeros(len(cells), bool)
        taken[at] = True
        asked = dict(zip(ranks, (np.array(ranks) - np.cumsum(np.where(taken, 0, cells))[at]).tolist()))  # among what is taken along
        finest = None if inner is None else taken[inner]

        def values(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
            for tile in tiles:
                for d in tile.apart(slabs):
                    k = place[bucket(d)]
                    d, k = d[k >= 0], k[k >= 0]
                    v, m = np.unique(d if finest is None else d[finest[sub(d, k)]], return_counts=True)
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], ["v", "m"])

        each = self.halves(values, "v double, m long").groupBy("v").agg(F.sum("m").alias("m"))
        rows, _ = ranking.running_sums(each, "v", upto=F.col("m"))
        found = rows.agg(*[F.min(F.when(F.col("upto") > asked[r], F.col("v"))).alias(f"v{r}") for r in ranks]).first()
        out = []
        for spot in spots:
            a, b, share = found[f"v{int(spot) // 2}"], found[f"v{min(int(spot) + 1, 2 * half - 1) // 2}"], spot - int(spot)
            out.append(a + (b - a) * share)
        return out

    def _added(self, f, size: int) -> np.ndarray:
        """The sums over tasks of the counts that f sends as (bucket, n), `size` of them."""
        sums = self.halves(f, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
        return out

    def distances(self, slabs: frozenset[int] | None = None) -> DataFrame:
        """(distance) of the pairs with both ends in these slabs."""

        def measure(each: Iterator[tuple[Tile, Panel]]) -> Iterator[pa.RecordBatch]:
            for tile, p in each:
                inside = among(tile, p, slabs)
                yield pa.RecordBatch.from_arrays([pa.array(p.distance if inside is None else p.distance[inside])], ["distance"])

        return self.scan(measure, "distance double")

    def between(self, key: str, slabs: frozenset[int] | None = None) -> DataFrame:
        """(s_<key>, t_<key>, n, k): pairs and edges between every two values of a node column, with both ends in these
        slabs. Pairs come from the sizes of values less what ids have in common; no tile is made."""
        names = [f"s_{key}", f"t_{key}"]
        inside = self.nodes if slabs is None else self.nodes.where(F.col("slab").isin(*slabs))
        own = inside.where("id IS NOT NULL").groupBy("id", key).agg(F.count("*").alias("c"))
        sizes = ranking.checkpointed(own.groupBy(key).agg(F.sum("c").alias("c")))  # a row a value
        side = lambda df, end, *more: df.select(*more, F.col(key).alias(f"{end}_{key}"), F.col("c").alias(f"{end}_c"))
        every = side(sizes, "s").crossJoin(side(sizes, "t")).select(*names, (F.col("s_c") * F.col("t_c")).alias("n"), F.lit(0).cast("long").alias("k"))
        same = side(own, "s", "id").join(side(own, "t", "id"), "id").select(*names, (-F.col("s_c") * F.col("t_c")).alias("n"), F.lit(0).cast("long").alias("k"))
        links = self.linked() if slabs is None else self.linked().where(F.col("s_slab").isin(*slabs) & F.col("t_slab").isin(*slabs))
        ends = [F.col(f"{end}_{key}" if key == "slab" else f"{name}_{key}").alias(f"{end}_{key}") for end, name in (("s", "source"), ("t", "target"))]
        edges = links.select(*ends, F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("k"))
        return every.unionByName(same).unionByName(edges).groupBy(*names).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0")

    def slab_counts(self) -> DataFrame:
        """(s_slab, t_slab, n, k): pairs and edges between every two slabs."""
        return self.between("slab")

    def binned(self, interior: list[float], train: frozenset[int], test: frozenset[int]) -> DataFrame:
        """(source_type, target_type, bin, n, k, test_n, test_k): pairs and edges with both ends in the train slabs, and
        in the test slabs, by types and distance bin. Tasks measure and count pairs, each once for both directions, and
        send one row for each of these that they met; edges are counted by joins. Without edges of bins no distance is
        measured."""
        keys, sides = ["source_type", "target_type", "bin"], (("n", "k", train), ("test_n", "test_k", test))
        zero = F.lit(0).cast("long")
        names = [c for n, k, _ in sides for c in (n, k)]

        def only(df: DataFrame, n: str, k: str) -> DataFrame:
            return df.select(*keys, *[F.col({n: "n", k: "k"}[c]).alias(c) if c in (n, k) else zero.alias(c) for c in names])

        if not interior:
            rows = [only(self.between("type", slabs).select(F.col("s_type").alias("source_type"), F.col("t_type").alias("target_type"), F.lit(0).alias("bin"), "n", "k"), n, k) for n, k, slabs in sides]
            sums = rows[0].unionByName(rows[1])
        else:
            edges = np.array(interior, dtype=float)

            def count(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
                totals: dict[tuple, np.ndarray] = {}
                for tile in tiles:
                    code = pa.concat_arrays([tile.s["type"], tile.t["type"]]).dictionary_encode(null_encoding="encode")
                    types, index = code.dictionary.to_pylist(), code.indices.to_numpy().astype(np.int64)
                    s, t = index[: len(tile.s["id"])], index[len(tile.s["id"]) :]
                    for column, (_, _, slabs) in enumerate(sides):
                        n = _by_types(tile, s, t, len(types), edges, slabs)
                        for at in np.flatnonzero(n).tolist():
                            pair, bin_ = divmod(at, len(edges) + 1)
                            a, b = divmod(pair, len(types))
                            totals.setdefault((types[a], types[b], bin_), np.zeros(2, np.int64))[column] += n[at]
                if totals:
                    own, values = list(zip(*totals)), np.array(list(totals.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.string()), pa.array(own[2], pa.int32()), *[pa.array(values[:, c], pa.int64()) for c in range(2)]], [*keys, "n", "test_n"])

            pairs = self.halves(count, "source_type string, target_type string, bin int, n long, test_n long").select(*keys, "n", zero.alias("k"), "test_n", zero.alias("test_k"))
            both = lambda slabs: (F.col("s_slab").isin(*slabs) & F.col("t_slab").isin(*slabs)).cast("long") if slabs else zero
            bin_ = bin_of(F.col("distance"), F.array(*[F.lit(e) for e in interior])).alias("bin")
            links = self.linked().select("source_type", "target_type", bin_, zero.alias("n"), both(train).alias("k"), zero.alias("test_n"), both(test).alias("test_k"))
            sums = pairs.unionByName(links)
        return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).where("n > 0 OR test_n > 0")


def _over(table: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(Tile(batch, row) for batch in batches for row in range(batch.num_rows))

    return table.mapInArrow(run, schema)


def _filled(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])


def _by_types(tile: Tile, s: np.ndarray, t: np.ndarray, types: int, edges: np.ndarray, slabs: frozenset[int]) -> np.ndarray:
    """Pairs of a tile with both ends in these slabs, by the codes of types and the bin. A tile above the diagonal also
    counts the pairs of its mirror image."""
    bins, (a, b) = len(edges) + 1, tile.inside(slabs)
    n = np.zeros(types * types * bins, np.int64)
    if not len(a) or not len(b):
        return n
    width = [float(max(tile.s[c].max(initial=-np.inf), tile.t[c].max(initial=-np.inf)) - min(tile.s[c].min(initial=np.inf), tile.t[c].min(initial=np.inf))) for c in "xyz"]
    of = _Bins(edges, float(np.sqrt(sum(w * w for w in width)))).of
    column = t[b] * bins
    for rows, d in tile.measured(a, b):
        key = of(d)
        key += (s[a[rows]] * (types * bins))[:, None]
        key += column[None, :]
        n += np.bincount(key.ravel(), minlength=len(n))
    kept = np.zeros(len(s), bool), np.zeros(len(t), bool)
    kept[0][a], kept[1][b] = True, True
    p, q = tile.same()
    p, q = p[kept[0][p] & kept[1][q]], q[kept[0][p] & kept[1][q]]
    n = n - np.bincount((s[p] * types + t[q]) * bins + of(tile.distance(p, q)), minlength=len(n))
    return n + n.reshape(types, types, bins).swapaxes(0, 1).ravel() if tile.i < tile.j else n


def among(tile: Tile, panel: Panel, slabs: frozenset[int] | None) -> np.ndarray | None:
    """Which pairs have both ends in these slabs; None: all."""
    if slabs is None:
        return None
    s, t = (np.isin(end["slab"], list(slabs)) for end in (tile.s, tile.t))
    return s[panel.source] & t[panel.target]


def tiled(nodes: DataFrame, counts: DataFrame | None = None, *, block: int = BLOCK, within: bool = False) -> Tiles:
    """nodes(id, type, x, y, z, and slab where they have one) and counts(pre, post, synapse_count) as tiles; no edges without
    counts. within: blocks are dealt inside slabs, and only tiles of one slab are made."""
    spark, n = nodes.sparkSession, nodes.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, min(n, max(min(ceil(n / block), MAX_BLOCKS), isqrt(8 * cores) + 1)))
    slab = F.col("slab").cast("int") if "slab" in nodes.columns else F.lit(0)
    nodes = nodes.select(F.col("id").cast("long").alias("id"), F.col("type").cast("string").alias("type"), *[F.col(a).cast("double").alias(a) for a in "xyz"], slab.alias("slab"))
    counts = spark.createDataFrame([], "pre long, post long, synapse_count long") if counts is None else counts
    edge = F.struct(*[F.col(c).cast("long").alias(c) for c in ("pre", "post", "synapse_count")])
    if within:
        blocks = max(1, ceil(blocks / 2))  # of a slab
        links = graph.connected_pairs(nodes, counts, n).where("s_slab = t_slab").select(F.col("source").alias("pre"), F.col("target").alias("post"), "synapse_count", F.col("s_slab").alias("slab")).distinct()
    of = lambda c: (F.shiftright(F.shiftrightunsigned(F.xxhash64(F.col(c).cast("long")), 33) * blocks, 31).cast("int") + (F.col("slab") * blocks if within else 0)).cast("int")
    packed = nodes.where("id IS NOT NULL").groupBy(of("id").alias("block")).agg(F.array_sort(F.collect_list(F.struct(*_NODE))).alias("r"))  # about `block` nodes, in id order
    side = lambda end, key: packed.select(F.col("block").alias(key), *[F.col(f"r.{c}").alias(f"{end}_{c}") for c in _NODE])
    dealt = (links if within else counts).select(of("pre").alias("i"), of("post").alias("j"), edge.alias("e"))

    def listed(i, j) -> DataFrame:
        rows = dealt.select((F.col(i) if isinstance(i, str) else i).alias("i"), (F.col(j) if isinstance(j, str) else j).alias("j"), "e").groupBy("i", "j").agg(F.collect_list("e").alias("e"))  # at most a tile's pairs
        return rows.select("i", "j", F.col("e.pre").alias("e_pre"), F.col("e.post").alias("e_post"), F.col("e.synapse_count").alias("e_count"))

    first = (F.col("i") - F.col("i") % blocks).cast("int") if within else F.lit(0)
    # merge joins: rows are arrays, whose size Spark takes for that of an element, so it would broadcast large tables
    both = side("s", "i").withColumn("j", F.explode(F.sequence(first, (first + (blocks - 1)).cast("int")))).join(side("t", "j").hint("merge"), "j")
    parts = min(blocks * blocks, max(4 * cores, blocks * blocks // 8))
    upper = side("s", "i").withColumn("j", F.explode(F.sequence(F.col("i"), (first + (blocks - 1)).cast("int")))).join(side("t", "j").hint("merge"), "j")
    ways = listed(F.least("i", "j"), F.greatest("i", "j"))
    more = max(parts, min(blocks * (blocks + 1), 16 * cores))  # large tiles: few to a task, so that tasks end together
    with_edges = lambda df, edges, parts: df.join(edges.hint("merge"), ["i", "j"], "left").repartition(parts)
    return Tiles(with_edges(both, listed("i", "j"), parts), with_edges(upper, ways, more), n, parts, upper.repartition(parts), nodes, counts)
