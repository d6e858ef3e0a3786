"""Remote tables, shards and listings behind small protocols: whoever has a network injects a client."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.functions import checks
from latticebits.operators import graph


class TableClient(Protocol):
    """Versioned tables. Filters and columns are the client's to push down; a Parquet client leaves them to Catalyst."""

    def versions(self) -> list[int]: ...
    def tables(self, version: int) -> list[str]: ...
    def table(self, name: str, version: int) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetClient:
    """root/v<version>/<table>.parquet"""

    spark: SparkSession
    root: str
    known: tuple[int, ...]
    names: tuple[str, ...]

    def versions(self) -> list[int]:
        return list(self.known)

    def tables(self, version: int) -> list[str]:
        return list(self.names)

    def table(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version}/{name}.parquet")


@dataclass(frozen=True)
class ExportConfig:
    """What an export reads and how much of it; bounds are checked at once."""

    version: int
    node_table: str = "proofreading_status"
    type_table: str = "cell_types"
    event_table: str = "synapses"
    strategies: tuple[str, ...] | None = graph.STRICT_STRATEGIES
    max_nodes: int = 500
    max_pairs: int = 5_000_000
    lookup_batch: int = 500
    require_dendrite_status: bool = True
    require_current_valid_id: bool = True

    def __post_init__(self):
        if self.version <= 0:
            raise ValueError("a positive version must be pinned")
        if self.strategies is not None and not self.strategies:
            raise ValueError("strategies must name one at least, or be None for all")
        if not all((self.node_table, self.type_table, self.event_table)):
            raise ValueError("tables must be named")
        if not 2 <= self.max_nodes <= graph.MAX_NODES:
            raise ValueError(f"max_nodes must be 2 to {graph.MAX_NODES}")
        if self.max_pairs < 2:
            raise ValueError("max_pairs must be at least 2")
        if not 1 <= self.lookup_batch <= 5000:
            raise ValueError("lookup_batch must be 1 to 5000")


def connect(make: Callable[[], TableClient], version: int) -> TableClient:
    """A client from a caller's factory, which alone handles credentials, with the pinned version there.

    Whatever goes wrong inside is reported without its text, which could hold a token."""
    try:
        client = make()
        known = version in client.versions()
    except ImportError:
        raise RuntimeError("the table client's package is not installed") from None
    except Exception as e:
        raise RuntimeError(f"the table client could not be set up ({type(e).__name__}); check its credentials where it keeps them") from None
    if not known:
        raise ValueError(f"version {version} isn't there")
    return client


def in_nanometres(df: DataFrame, columns: tuple[str, ...], resolution: tuple[float, float, float]) -> DataFrame:
    """Places in voxels of a stated resolution as nanometres: x, y and z columns in this order."""
    if len(columns) != 3 or any(r <= 0 for r in resolution):
        raise ValueError("three columns and a positive resolution are needed")
    return df.withColumns({c: F.col(c).cast("double") * F.lit(float(r)) for c, r in zip(columns, resolution)})


def restricted(df: DataFrame, column: str | None = None, values: list | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A bounded read of a table: rows of listed values, some columns, at most so many rows; all of it pushed down."""
    if column is not None:
        df = df.where(F.col(column).isin(list(values or [])))
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def export_graph(client: TableClient, config: ExportConfig) -> graph.Graph:
    """Proofread nodes with one type each, the first max_nodes by id; events among them; all candidate pairs."""
    nodes = graph.current_nodes(client.table(config.node_table, config.version), strategies=config.strategies, require_dendrite_status=config.require_dendrite_status, require_current_valid_id=config.require_current_valid_id)
    typed = graph.typed_nodes(nodes, client.table(config.type_table, config.version), max_nodes=config.max_nodes).withColumnRenamed("strategy_axon", "strategy")
    events = graph.events_between(graph.clean_events(client.table(config.event_table, config.version)), typed)
    return graph.Graph(typed, graph.pair_relation(typed, graph.pair_counts(events), max_pairs=config.max_pairs))


def export(client: TableClient, config: ExportConfig, path: str) -> dict:
    """export_graph, written with its manifest and validated from what was written."""
    from latticebits.sources import tables

    g = export_graph(client, config)
    tables.save_export(g, path, asdict(config))
    return tables.validate_export(g.nodes.sparkSession, path)


def batched_types(lookup: Callable[[list[int]], DataFrame], nodes: DataFrame, max_nodes: int, batch: int) -> DataFrame:
    """typed_nodes for a service that takes id lists: batches in id order until max_nodes have a type. Bounded by the
    config's max_nodes and what lacks a type before it."""
    found: DataFrame | None = None
    ids: list[int] = []
    rows = nodes.select("id").orderBy("id").toLocalIterator()
    done = False
    while not done:
        ids = [r["id"] for _, r in zip(range(batch), rows)]
        done = len(ids) < batch
        if ids:
            part = graph.typed_nodes(nodes.where(F.col("id").isin(ids)), lookup(ids))
            found = part if found is None else found.unionByName(part)
            done = done or found.limit(max_nodes).count() >= max_nodes
    if found is None:
        raise ValueError("no nodes")
    return found.orderBy("id").limit(max_nodes)


#: Columns that an export needs of each table. Fixed values.
NEEDED = {
    "node": ("pt_root_id", "valid_id", "status_axon", "status_dendrite", "strategy_axon", "pt_position_x", "pt_position_y", "pt_position_z"),
    "type": ("pt_root_id", "cell_type"),
    "event": ("pre_pt_root_id", "post_pt_root_id"),
}


def installed_version(package: str) -> str | None:
    from importlib.metadata import PackageNotFoundError, version

    try:
        return version(package)
    except PackageNotFoundError:
        return None


def doctor(client: TableClient, config: ExportConfig) -> dict:
    """A bounded look before an export: version, tables, columns, and whether a few rows come back. Names no credential."""
    versions = client.versions()
    if config.version not in versions:
        raise ValueError(f"version {config.version} isn't there")
    names = set(client.tables(config.version))
    wanted = {"node": config.node_table, "type": config.type_table, "event": config.event_table}
    missing = sorted(set(wanted.values()) - names)
    if missing:
        raise ValueError(f"tables are missing: {', '.join(missing)}")
    report: dict = {"version": config.version, "packages": {n: installed_version(n) for n in ("pyspark", "numpy")}, "tables": {}}
    for role, limit in (("node", 5), ("type", 1), ("event", 1)):
        df = checks.require_columns(client.table(wanted[role], config.version), NEEDED[role], wanted[role])
        n = df.limit(limit).count()
        if not n:
            raise ValueError(f"{wanted[role]} gave no rows")
        report["tables"][wanted[role]] = {"columns": sorted(df.columns), "probed": n}
    return report


# ---- shards


def shard_name(index: int, count: int = 166) -> str:
    if not 0 <= index < count:
        raise ValueError(f"shards go from 0 to {count - 1}")
    return f"export{index:012d}.json"


def assigned_shards(part: int, parts: int, count: int = 166) -> list[int]:
    """The shards of one of several parts: those with this remainder."""
    if parts < 1 or not 0 <= part < parts:
        raise ValueError("the part must be below the number of parts")
    return list(range(part, count, parts))


def shard_manifest(sizes: list[int]) -> list[dict]:
    """(name, bytes) of the shards of a release whose sizes are known; sizes are the caller's to pin."""
    if any(n <= 0 for n in sizes):
        raise ValueError("shard sizes must be positive")
    return [{"shard": i, "name": shard_name(i, len(sizes)), "bytes": n} for i, n in enumerate(sizes)]


def head(ask: Callable[[], dict]) -> dict:
    """What a HEAD request tells of an object, through ask(), which gives its headers; a failure is reported, not raised."""
    try:
        headers = {k.lower(): v for k, v in ask().items()}
    except Exception as e:  # a report of what is there
        return {"available": False, "error_type": type(e).__name__, "content_length": None}
    length = headers.get("content-length")
    return {"available": True, "content_length": int(length) if length is not None else None} | {n.replace("-", "_"): headers.get(n) for n in ("content-type", "etag", "last-modified", "accept-ranges")}


def download(fetch: Callable[[], bytes], path: str, size: int, *, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> None:
    """A file of a known size through fetch(), kept if it is there already; a failed or short try waits twice as long, 16 s
    at most; the name appears only when all is written."""
    if os.path.exists(path) and os.path.getsize(path) == size:
        return
    for attempt in range(retries):
        try:
            data = fetch()
            if len(data) != size:
                raise OSError(f"{len(data)} bytes of {size}")
            with open(f"{path}.part", "wb") as f:
                f.write(data)
            os.replace(f"{path}.part", path)
            return
        except OSError:
            if attempt == retries - 1:
                raise
            sleep(min(16.0, 2.0**attempt))


def listing(page: Callable[[str | None], tuple[list[dict], str | None]], spark: SparkSession) -> DataFrame:
    """(name, size) of all pages of an object listing."""
    rows, token = [], None
    while True:
        items, token = page(token)
        rows += [(i["name"], str(i["size"])) for i in items]
        if not token:
            return spark.createDataFrame(rows, "name string, size string")
