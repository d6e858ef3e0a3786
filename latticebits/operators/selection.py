"""Exact selection by rank: the value at a rank, and the rows before it, without sorting the table.

A mergeable quantile sketch brackets every wanted rank between two values of the table; one pass then counts the rows
below, at and between the bracket's ends and takes along only what lies between them, where that is little. So two
passes find any rank of some ten million rows; of more, the rows between the ends are bracketed again, and each such
round leaves about a five-hundredth. A sketch's luck decides how many rounds there are, never the result.

Rows that tie with the value at a cut are ranked by the keys behind it, and only they (see ranking.py).

Values are doubles without nulls and NaN; they are only compared, so their range doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticebits.operators.ranking import ranked

#: A sketch of this size is off by some two ten-thousandths of the ranks; MARGIN is looked at on either side.
SKETCH, MARGIN = 16_384, 0.001
#: Different values between two ends that are few enough to come to the driver, for each wanted rank.
FEW = 20_000


@dataclass(frozen=True)
class Found:
    """The value at a rank from 0, the rows below it and the rows that have it."""

    value: float
    below: int
    equal: int


@dataclass
class _Span:
    """Rows strictly between two values, the rows at or below the lower one, and the wanted ranks among them."""

    low: float
    high: float
    before: int
    rows: int
    ranks: list[int]

    def levels(self) -> list[float]:
        """Where a sketch of these rows is asked: on either side of each rank."""
        middle = [(r - self.before + 0.5) / self.rows for r in self.ranks]
        return [min(1.0, max(0.0, m + side)) for m in middle for side in (-MARGIN, MARGIN)]

    def holds(self, v: Column) -> Column:
        inside = F.lit(True)
        if self.low > -inf:
            inside = inside & (v > F.lit(self.low))
        return inside & (v < F.lit(self.high)) if self.high < inf else inside


def _sketched(df: DataFrame, spans: list[_Span] | None, wanted) -> tuple[list[_Span], list[list[float]]]:
    """Spans (one of the whole table, where none are given) with the values at their levels, one pass."""
    v = F.col("v")
    inside = [v] if spans is None else [F.when(s.holds(v), v) for s in spans]
    row = df.agg(F.count(v).alias("n"), *[F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(f"s{k}") for k, x in enumerate(inside)]).first()
    if spans is None:
        spans = [_Span(-inf, inf, 0, row["n"], wanted(row["n"]))] if row["n"] else []
    spans = [s for s in spans if s.ranks]
    if not spans:
        return [], []
    asked = [F.kll_sketch_get_quantile_double(F.lit(row[f"s{k}"]), F.array(*[F.lit(q) for q in s.levels()])).alias(f"q{k}") for k, s in enumerate(spans)]
    return spans, [list(q) for q in df.sparkSession.range(1).select(*asked).first()]


def _zones(span: _Span, values: list[float]) -> tuple[list[float], list[_Span], list[bool]]:
    """The different cuts of a span, what lies between them (rows not known yet), and which of these is taken along:
    where a wanted rank ought to be and rows ought to be few."""
    at: dict[float, tuple[float, float]] = {}
    for level, value in zip(span.levels(), values):
        if span.low < value < span.high:
            a, b = at.get(value, (level, level))
            at[value] = min(a, level), max(b, level)
    cuts = sorted(at)
    ends = [span.low, *cuts, span.high]
    marks = [(0.0, 0.0), *[at[c] for c in cuts], (1.0, 1.0)]
    between, taken = [], []
    for i in range(len(ends) - 1):
        between.append(_Span(ends[i], ends[i + 1], 0, 0, []))
        a, b = marks[i][0], marks[i + 1][1]
        hit = any(a <= (r - span.before + 0.5) / span.rows <= b for r in span.ranks)
        taken.append(span.rows <= FEW or hit and (b - a) * span.rows <= FEW)
    return cuts, between, taken


def at_ranks(df: DataFrame, value: str | Column, ranks) -> tuple[int, dict[int, Found]]:
    """The number of rows and what stands at each rank from 0; `ranks` is a list, or a function of the number of rows."""
    df = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))
    v = F.col("v")
    total = 0

    def wanted(n: int) -> list[int]:
        nonlocal total
        total = n
        own = sorted(set(ranks(n) if callable(ranks) else ranks))
        if any(not 0 <= r < n for r in own):
            raise ValueError(f"ranks must be from 0 to {n - 1}")
        return own

    found: dict[int, Found] = {}
    spans, values = _sketched(df, None, wanted)
    while spans:
        split = [_zones(s, q) for s, q in zip(spans, values)]
        zones = [z for _, between, _ in split for z in between]
        taken = [k for k, t in enumerate(t for *_, taken in split for t in taken) if t]
        cuts = [c for own, *_ in split for c in own]
        zone = F.coalesce(*[F.when(z.holds(v), k) for k, z in enumerate(zones)], F.when(v.isin(*cuts), -1) if cuts else F.lit(None).cast("int"))
        placed = df.select(zone.alias("z"), v).where("z IS NOT NULL")
        rows = placed.select("z", F.when(F.col("z").isin(-1, *taken), v).alias("v")).groupBy("z", "v").agg(F.count("*").alias("n"))
        counts: dict[int, dict[float | None, int]] = {}
        for r in rows.collect():  # a row a zone and a cut, and FEW values or so of each zone that is taken along
            counts.setdefault(r["z"], {})[r["v"]] = r["n"]
        opened: list[_Span] = []
        number = 0
        for span, (own, between, _) in zip(spans, split):
            upto = span.before
            for i, zone_ in enumerate(between):
                here = counts.get(number, {})
                size = sum(here.values())
                inside = [r for r in span.ranks if upto <= r < upto + size]
                if inside and None in here:
                    opened.append(_Span(zone_.low, zone_.high, upto, size, inside))
                elif inside:
                    _settle(found, inside, upto, sorted(here.items()))
                upto, number = upto + size, number + 1
                if i < len(own):
                    n = counts.get(-1, {}).get(own[i], 0)
                    _settle(found, span.ranks, upto, [(own[i], n)])
                    upto += n
        spans, values = _sketched(df, opened, wanted) if opened else ([], [])
    return total, found


def _settle(found: dict[int, Found], ranks: list[int], below: int, values: list[tuple[float, int]]) -> None:
    for value, n in values:
        found.update({r: Found(value, below, n) for r in ranks if below <= r < below + n})
        below += n


def quantiles(df: DataFrame, value: str | Column, levels: list[float]) -> list[float] | None:
    """Exact linear quantiles, None without rows."""
    n, found = at_ranks(df, value, lambda n: [r for level in levels for r in (int(level * (n - 1)), min(int(level * (n - 1)) + 1, n - 1))])
    if not n:
        return None
    out = []
    for level in levels:
        spot = level * (n - 1)
        a, b, share = found[int(spot)].value, found[min(int(spot) + 1, n - 1)].value, spot - int(spot)
        out.append(a + (b - a) * share if b - a < inf else a * (1 - share) + b * share)
    return out


def with_first(df: DataFrame, value: Column, keys: list[str | Column], count, name: str) -> DataFrame:
    """df with a boolean column that holds for exactly the `count` first rows by (value, keys); `count` is a number or a
    function of the number of rows. df is read three times: keep what is dear to build."""
    first = 0

    def last(n: int) -> list[int]:
        nonlocal first
        first = min(n, count(n) if callable(count) else count)
        return [first - 1] if 0 < first < n else []

    n, found = at_ranks(df, value, last)
    if not found:
        return df.withColumn(name, F.lit(0 < first == n))
    (cut,) = found.values()
    at, needed = F.lit(cut.value), first - cut.below
    if needed == cut.equal:
        return df.withColumn(name, value <= at)
    ties, _ = ranked(df.where(value == at), *keys, name="__rank")
    return df.where(value != at).withColumn(name, value < at).unionByName(ties.withColumn(name, F.col("__rank") <= needed).drop("__rank"))


def first_rows(df: DataFrame, value: Column, keys: list[str | Column], count) -> DataFrame:
    """Exactly the `count` first rows by (value, keys)."""
    return with_first(df, value, keys, count, "__first").where("__first").drop("__first")
