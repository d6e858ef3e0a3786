"""Transparent edge models: fitting is an aggregation, prediction a column or a small join.

Every model has fit(pairs) -> model, predict(pairs) -> pairs with `p`, model_bits. Rates are smoothed by one half;
keys and bins not seen in training get the global rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticebits.functions.columns import bin_of, smoothed_rate
from latticebits.operators import graph, selection
from latticebits.operators.tiles import Tiles

BITS_PER_NUMBER = 64


def rate():
    return smoothed_rate(F.sum("connected"), F.count("*"))


def _global_rate(pairs: DataFrame) -> float:
    row = pairs.agg(F.count("*").alias("n"), rate().alias("p")).first()
    if not row["n"]:
        raise ValueError("a model can't be fitted to no pairs")
    return row["p"]


def exact_quantiles(df: DataFrame, column: str, levels: list[float]) -> list[float] | None:
    """Exact linear quantiles of a column without nulls, None without rows: two passes for some ten million rows."""
    return selection.quantiles(df, column, levels)


def distance_edges(pairs: DataFrame, bins: int) -> list[float]:
    """Exact linear quantiles at i/bins; a last edge that isn't above the first is put one above it."""
    return _rising(exact_quantiles(pairs, "distance", [i / bins for i in range(bins + 1)]))


def tile_edges(tiles: Tiles, bins: int, slabs: frozenset[int] | None = None) -> list[float]:
    """distance_edges() of the pairs of tiled nodes with both ends in these slabs."""
    return _rising(tiles.quantiles([i / bins for i in range(bins + 1)], slabs))


def _rising(edges: list[float] | None) -> list[float]:
    if edges is None:
        raise ValueError("a model can't be fitted to no pairs")
    for i in range(1, len(edges)):
        edges[i] = max(edges[i], edges[i - 1])
    if edges[-1] <= edges[0]:
        edges[-1] = edges[0] + 1.0
    return edges


def _interior(edges: list[float]):
    return F.array(*[F.lit(e) for e in edges[1:-1]])


@dataclass(frozen=True)
class GlobalRate:
    p: float
    name = "global"

    @classmethod
    def fit(cls, pairs: DataFrame) -> GlobalRate:
        return cls(_global_rate(pairs))

    def predict(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("p", F.lit(self.p))

    @property
    def model_bits(self) -> int:
        return BITS_PER_NUMBER


@dataclass(frozen=True)
class KeyedRate:
    """Rates by keys; `edges` are set where a distance bin is one of them. The rate table is as small as its keys."""

    name: str
    keys: tuple[str, ...]
    rates: DataFrame
    n_rates: int
    fallback: float
    edges: tuple[float, ...] = ()
    full: bool = False  # every bin counts as a parameter, trained or not

    @classmethod
    def fit(cls, pairs: DataFrame, name: str, *, types: bool, bins: int | None = None) -> KeyedRate:
        edges = tuple(distance_edges(pairs, bins)) if bins else ()
        keys = ("source_type", "target_type") * types + ("distance_bin",) * bool(bins)
        counts = cls._binned(pairs, edges).groupBy(*keys).agg(F.sum("connected").alias("k"), F.count("*").alias("n"))
        rows = counts.collect()  # one per key: types squared times bins
        if not rows:
            raise ValueError("a model can't be fitted to no pairs")
        table = pairs.sparkSession.createDataFrame(rows, counts.schema).withColumn("p", smoothed_rate(F.col("k"), F.col("n"))).drop("k", "n")
        fallback = (sum(r["k"] for r in rows) + 0.5) / (sum(r["n"] for r in rows) + 1.0)
        return cls(name, keys, table, len(rows), fallback, edges, not types)

    @staticmethod
    def _binned(pairs: DataFrame, edges: tuple[float, ...]) -> DataFrame:
        return pairs.withColumn("distance_bin", bin_of(F.col("distance"), _interior(list(edges)))) if edges else pairs

    def predict(self, pairs: DataFrame) -> DataFrame:
        rates = F.broadcast(self.rates) if self.n_rates <= graph.BROADCAST_ROWS else self.rates
        found = self._binned(pairs, self.edges).join(rates, list(self.keys), "left")
        return found.withColumn("p", F.coalesce("p", F.lit(self.fallback))).drop("distance_bin")

    @property
    def model_bits(self) -> int:
        n = len(self.edges) - 1 if self.full else self.n_rates
        return BITS_PER_NUMBER * (n + len(self.edges) + (0 if self.full else 1))


def distance_binned(pairs: DataFrame, bins: int = 12) -> KeyedRate:
    return KeyedRate.fit(pairs, "distance", types=False, bins=bins)


def type_pair(pairs: DataFrame) -> KeyedRate:
    return KeyedRate.fit(pairs, "type_pair", types=True)


def type_distance(pairs: DataFrame, bins: int = 12) -> KeyedRate:
    return KeyedRate.fit(pairs, "type_distance", types=True, bins=bins)
