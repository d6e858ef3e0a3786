"""Nodes, events and the candidate-pair relation."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticebits.functions import checks
from latticebits.functions.columns import coerced_double, coerced_id, is_finite, is_neuron, known_type, length3, normal_type, voxel_nm

MAX_NODES, MAX_PAIRS = 5_000, 5_000_000
#: Tables of so many rows at most (some MB) are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The same for rows of three numbers: their broadcast spares a shuffle of the wide pair table.
BROADCAST_COUNTS = 1_000_000
#: Pairs that a task of the pair table makes, about: some 500 MB of its file.
TASK_PAIRS = 50_000_000


@dataclass(frozen=True)
class Graph:
    """nodes(id, type, x, y, z) and pairs(source, target, source_type, target_type, distance, synapse_count, connected, sx..tz)."""

    nodes: DataFrame
    pairs: DataFrame


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, given only after the size is checked (the count stops at the bound)."""
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def unique_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once; all rows of other keys go."""
    once = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, list(keys), "left_semi")


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def clean_nodes(df: DataFrame, *, id: str, type: str, x: str, y: str, z: str) -> DataFrame:
    """Text or typed node columns as nodes(id, type, x, y, z): ids and coordinates coerced, bad rows dropped, types
    normalised, ids that occur more than once dropped altogether."""
    checks.require_columns(df, [id, type, x, y, z], "node table")
    rows = df.select(coerced_id(F.col(id)).alias("id"), normal_type(F.col(type)).alias("type"), *[coerced_double(F.col(c)).alias(a) for c, a in ((x, "x"), (y, "y"), (z, "z"))])
    return unique_rows(rows.dropna(subset=["id", "x", "y", "z"]).where("id > 0"), "id")


def strict_nodes(df: DataFrame, *, id: str, type: str, x: str, y: str, z: str) -> DataFrame:
    """Typed node columns as nodes, where anything bad is an error: repeated or non-positive ids, coordinates that aren't finite."""
    checks.require_columns(df, [id, type, x, y, z], "node table")
    rows = df.select(F.col(id).cast("bigint").alias("id"), known_type(F.col(type)).alias("type"), *[F.col(c).cast("double").alias(a) for c, a in ((x, "x"), (y, "y"), (z, "z"))])
    bad = rows.agg(F.count_if(F.col("id").isNull() | (F.col("id") <= 0)).alias("ids"), F.count_if(~(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))).alias("places"), (F.count("*") - F.count_distinct("id")).alias("repeats")).first()
    if bad["ids"] or bad["places"] or bad["repeats"]:
        raise ValueError(f"node table: {bad['ids']} bad ids, {bad['places']} coordinates that aren't finite, {bad['repeats']} repeated ids")
    return rows


def clean_events(df: DataFrame, pre: str | None = None, post: str | None = None) -> DataFrame:
    """events(pre, post): endpoint columns found by name, ids coerced, bad rows and loops dropped."""
    pre, post = pre or checks.endpoint_column(df.columns, "pre"), post or checks.endpoint_column(df.columns, "post")
    rows = df.select(coerced_id(F.col(pre)).alias("pre"), coerced_id(F.col(post)).alias("post")).dropna()
    return rows.where("pre > 0 AND post > 0 AND pre <> post")


def endpoints(events: DataFrame) -> DataFrame:
    return events.select(F.col("pre").alias("id")).union(events.select(F.col("post").alias("id"))).distinct()


def nodes_with_events(nodes: DataFrame, events: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Nodes that are an endpoint of an event; then the max_nodes least ids, three at least."""
    kept = nodes.join(endpoints(events), "id", "left_semi")
    if max_nodes is None:
        return kept
    if max_nodes < 3:
        raise ValueError("max_nodes must be at least 3")
    return kept.orderBy("id").limit(max_nodes)


def events_between(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with both ends among the nodes: two semi joins, before anything is expanded."""
    ids = small(nodes.select("id"))
    return events.join(ids, F.col("pre") == F.col("id"), "left_semi").join(ids, F.col("post") == F.col("id"), "left_semi")


def events_outside(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events of which an end isn't a node."""
    ids = nodes.select("id")
    return events.join(ids, F.col("pre") == F.col("id"), "left_anti").unionByName(events.join(ids, F.col("pre") == F.col("id"), "left_semi").join(ids, F.col("post") == F.col("id"), "left_anti"))


def pair_counts(events: DataFrame) -> DataFrame:
    """(pre, post, synapse_count)."""
    return events.groupBy("pre", "post").agg(F.count("*").alias("synapse_count"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Partial counts of parts, added up."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("pre", "post").agg(F.sum("synapse_count").alias("synapse_count"))


def candidate_pairs(nodes: DataFrame, *, max_pairs: int | None = MAX_PAIRS, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """All ordered pairs of different nodes with types, places and distance.

    Quadratic by definition, so bounded beforehand, by the limits of an export unless others (or None) are given. One side
    is broadcast where it is small, and the streamed side is dealt out first, to as many tasks as the pairs ask for: a pair
    table takes its partitions."""
    n = nodes.count()
    if max_nodes is not None and n > max_nodes:
        raise ValueError(f"{n} nodes, more than {max_nodes}")
    if max_pairs is not None:
        checks.require_pairs_within(n, max_pairs)
    side = lambda end, axis: nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), *[F.col(c).alias(f"{axis}{c}") for c in "xyz"])
    spread = max(1, nodes.sparkSession.sparkContext.defaultParallelism, ceil(n * n / TASK_PAIRS))
    left = side("source", "s").repartition(spread, "source")
    right = side("target", "t")
    pairs = left.crossJoin(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("shuffle_replicate_nl")).where("source <> target")
    d = length3(*[F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"])
    return pairs.select("source", "target", "source_type", "target_type", d.alias("distance"), "sx", "sy", "sz", "tx", "ty", "tz")


def labelled_pairs(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with synapse_count, 0 where there are none, and connected."""
    per = counts.select(F.col("pre").alias("source"), F.col("post").alias("target"), "synapse_count")
    n = F.coalesce("synapse_count", F.lit(0).cast("bigint"))
    return pairs.join(small(per, BROADCAST_COUNTS), ["source", "target"], "left").withColumn("synapse_count", n).withColumn("connected", (n > 0).cast("int"))


def pair_relation(nodes: DataFrame, counts: DataFrame, *, max_pairs: int | None = MAX_PAIRS, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """The labelled candidate pairs within an export's limits, tile by tile: no pair is shuffled."""
    from latticebits.operators.tiles import tiled

    n = nodes.count()
    if max_nodes is not None and n > max_nodes:
        raise ValueError(f"{n} nodes, more than {max_nodes}")
    if max_pairs is not None:
        checks.require_pairs_within(n, max_pairs)
    return tiled(nodes, counts).pairs()


def connected_pairs(nodes: DataFrame, counts: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """The rows of labelled_pairs() that have an edge, by two joins from the counts, with s_slab and t_slab where nodes have
    a slab. n_nodes: their number where it is known; few nodes are sent to every executor."""
    slabs = [("slab", "_slab")] if "slab" in nodes.columns else []
    hint = F.broadcast if n_nodes is not None and n_nodes <= BROADCAST_ROWS else lambda df: df
    side = lambda end, axis: hint(nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), *[F.col(c).alias(f"{axis}{c}") for c in "xyz"], *[F.col(c).alias(f"{axis}{a}") for c, a in slabs]))
    edges = counts.where("pre <> post AND synapse_count > 0").select(F.col("pre").alias("source"), F.col("post").alias("target"), "synapse_count")
    d = length3(*[F.col(f"t{c}") - F.col(f"s{c}") for c in "xyz"])
    both = edges.join(side("source", "s"), "source").join(side("target", "t"), "target")
    return both.select("source", "target", "source_type", "target_type", d.alias("distance"), "sx", "sy", "sz", "tx", "ty", "tz", "synapse_count", F.lit(1).alias("connected"), *[f"{axis}_slab" for _ in slabs for axis in "st"])


def build_graph(nodes: DataFrame, events: DataFrame, *, max_nodes: int | None = None, max_pairs: int = MAX_PAIRS, only_with_events: bool = True) -> Graph:
    """nodes and events as in clean_nodes and clean_events, to the labelled pair relation."""
    kept = nodes_with_events(nodes, events, max_nodes) if only_with_events or max_nodes else nodes
    counts = pair_counts(events_between(events, kept))
    return Graph(kept, pair_relation(kept, counts, max_pairs=max_pairs))


def eligible_neurons(somas: DataFrame, *, id: str = "c3_rep_manual", label: str = "celltype", axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Neuron-labelled rows with a finite id that no other neuron-labelled row has, whole ids, places in nm.

    A cell that is labelled as a neuron once and otherwise elsewhere stays; order is (x, id)."""
    checks.require_columns(somas, [id, label, *axes], "soma table")
    number = F.col(id).try_cast("decimal(38,6)") if dict(somas.dtypes)[id] == "string" else F.col(id)
    rows = somas.where(is_neuron(F.col(label)) & is_finite(F.col(id).try_cast("double")) & (F.col(id).try_cast("double") > 0)).withColumn("__id", number)
    rows = unique_rows(rows, "__id")
    for axis in axes:
        rows = rows.where(is_finite(F.col(axis).try_cast("double")))
    checks.require_integral(rows, "__id", "soma table")
    places = [voxel_nm(F.col(a).try_cast("double"), i).cast("bigint").alias(n) for i, (a, n) in enumerate(zip(axes, ("x_nm", "y_nm", "z_nm")))]
    return rows.select(F.col("__id").cast("bigint").alias("id"), F.upper(F.trim(F.col(label))).alias("type"), *places)


#: The strategy that counts where none is named. Fixed value.
STRICT_STRATEGIES = ("axon_fully_extended",)


def current_nodes(proofread: DataFrame, *, strategies: tuple[str, ...] | list[str] | None = STRICT_STRATEGIES, require_dendrite_status: bool = True, require_current_valid_id: bool = True) -> DataFrame:
    """Proofread cells of these strategies (None: of any) with a true axon status, finite places and a positive id, and
    as asked a true dendrite status and a current id; of each id the row that sorts first by id and place."""
    from latticebits.functions.columns import status_true

    if strategies is not None and not strategies:
        raise ValueError("one strategy at least is needed")
    rows = proofread.where(status_true(F.col("status_axon")))
    if require_dendrite_status:
        rows = rows.where(status_true(F.col("status_dendrite")))
    if strategies is not None:
        rows = rows.where(F.col("strategy_axon").isin(*strategies))
    if require_current_valid_id:
        rows = rows.where(coerced_id(F.col("valid_id")) == coerced_id(F.col("pt_root_id")))
    rows = rows.withColumn("id", coerced_id(F.col("pt_root_id"))).where("id > 0")
    places = [coerced_double(F.col(f"pt_position_{a}")).alias(a) for a in "xyz"]
    return first_rows(rows.select("id", *places, "strategy_axon").dropna(subset=["x", "y", "z"]), ["id"], ["id", "x", "y", "z", F.asc_nulls_first("strategy_axon")])


def typed_nodes(nodes: DataFrame, types: DataFrame, *, max_nodes: int | None = None) -> DataFrame:
    """nodes with the type of ids that have one row in types, one to one; then the max_nodes least ids."""
    once = unique_rows(types.select(coerced_id(F.col("pt_root_id")).alias("id"), known_type(F.col("cell_type")).alias("type")), "id")
    checks.require_unique(nodes, "id", what="node table")
    both = nodes.join(once, "id")
    return both if max_nodes is None else both.orderBy("id").limit(max_nodes)
