"""Tables of a service as a Spark data source: what a scan filters and selects is asked of the service.

A service holds versioned tables and answers bounded questions (columns, listed values of columns, a row limit). The
source hands `IN` and `=` filters of a query to it, cuts long value lists into batches, each a partition of its own, and
leaves every other filter to Spark. looked_up() asks for the rows of ids that are rows themselves, however many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

BATCH = 500


class TableService(Protocol):
    """Picklable: tasks ask it."""

    def schema(self, table: str, version: int) -> StructType: ...

    def splits(self, table: str, version: int) -> Sequence[Any]:
        """Parts that a whole scan is cut into."""

    def read(self, table: str, version: int, *, columns: list[str], among: dict[str, list], limit: int | None, split: Any = None) -> Iterator[pa.RecordBatch]:
        """Rows whose columns hold one of the listed values, of one part or (None) of all, at most so many."""


@dataclass(frozen=True)
class FolderService:
    """root/<table>.parquet, read through pyarrow: files are the splits."""

    root: str

    def _dataset(self, table: str):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return ds.dataset(f"{at}/{table}.parquet", filesystem=system, format="parquet")

    def schema(self, table: str, version: int) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._dataset(table).schema)

    def splits(self, table: str, version: int) -> Sequence[Any]:
        return [(k, g) for k, f in enumerate(self._dataset(table).get_fragments()) for g in range(f.num_row_groups)]

    def read(self, table: str, version: int, *, columns: list[str], among: dict[str, list], limit: int | None, split: Any = None) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        data = self._dataset(table)
        wanted = None
        for name, values in among.items():
            one = ds.field(name).isin(pa.array(values, data.schema.field(name).type))
            wanted = one if wanted is None else wanted & one
        if split is not None:
            data = list(data.get_fragments())[split[0]].subset(row_group_ids=[split[1]])
        left = limit
        for batch in data.to_batches(columns=columns, filter=wanted):
            batch = batch if left is None else batch.slice(0, left)
            left = None if left is None else left - batch.num_rows
            if batch.num_rows:
                yield batch
            if left == 0:
                return


@dataclass
class _Part(InputPartition):
    split: Any
    among: dict[str, list]


class _Reader(DataSourceReader):
    def __init__(self, service: TableService, table: str, version: int, columns: list[str], limit: int | None, batch: int):
        self.service, self.table, self.version, self.columns, self.limit, self.batch = service, table, version, columns, limit, batch
        self.among: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None or name in self.among:
                yield f
                continue
            self.among[name] = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]

    def partitions(self) -> Sequence[InputPartition]:
        long = max((n for n, v in self.among.items() if len(v) > self.batch), key=lambda n: len(self.among[n]), default=None)
        if long is None:
            return [_Part(s, self.among) for s in self.service.splits(self.table, self.version)] or [_Part(None, self.among)]
        values = sorted(set(self.among[long]))
        return [_Part(None, {**self.among, long: values[k : k + self.batch]}) for k in range(0, len(values), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.service.read(self.table, self.version, columns=self.columns, among=partition.among, limit=self.limit, split=partition.split)


def remote_table(spark: SparkSession, service: TableService, table: str, version: int, *, columns: list[str] | None = None, limit: int | None = None, batch: int = BATCH) -> DataFrame:
    """A table of a service; filters that follow are pushed to it. limit: rows that are wanted at most, no part gives more."""
    schema = service.schema(table, version)
    columns = columns or schema.names
    missing = [c for c in columns if c not in schema.names]
    if missing:
        raise ValueError(f"{table} has no column {', '.join(missing)}")
    kept = StructType([schema[c] for c in columns])

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return "latticebits_remote"

        def schema(self) -> StructType:
            return kept

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(service, table, version, columns, limit, batch)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Remote)
    rows = spark.read.format("latticebits_remote").load()
    return rows if limit is None else rows.limit(limit)


def looked_up(ids: DataFrame, service: TableService, table: str, version: int, key: str, *, columns: list[str] | None = None, batch: int = BATCH) -> DataFrame:
    """The rows of a table whose key is among ids (one column, repeats and nulls allowed), asked for batch by batch.

    Ids are range-partitioned, so each question holds neighbouring keys; tasks ask, and the driver sees no id."""
    schema = service.schema(table, version)
    columns = columns or schema.names
    kept = StructType([schema[c] for c in columns])
    wanted = ids.toDF(key).dropna().distinct().repartitionByRange(key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list]:
            held: list = []
            for b in batches:
                held += b.column(0).to_pylist()
                while len(held) >= batch:
                    yield held[:batch]
                    held = held[batch:]
            if held:
                yield held

        for values in parts():
            yield from service.read(table, version, columns=columns, among={key: values}, limit=None)

    return wanted.mapInArrow(ask, kept)


def first_typed(nodes: DataFrame, service: TableService, table: str, version: int, *, key: str, label: str, max_nodes: int, batch: int = BATCH) -> DataFrame:
    """The max_nodes least ids of nodes that have exactly one row in a table, with its label as `type`.

    Nodes are numbered by id and asked for in rounds that double, each counted once; the first rounds are enough where
    most nodes have a type, and the last takes what is left."""
    from latticebits.functions.columns import known_type
    from latticebits.operators import graph
    from latticebits.operators.ranking import checkpointed, ranked

    rows, n = ranked(nodes, "id", name="__rank")
    found: DataFrame | None = None
    done, size, have = 0, max(batch, 2 * max_nodes), 0
    while done < n and have < max_nodes:
        part = rows.where(F.col("__rank").between(done + 1, done + size)).drop("__rank")
        types = looked_up(part.select("id"), service, table, version, key, columns=[key, label], batch=batch)
        once = graph.unique_rows(types.select(F.col(key).cast("bigint").alias("id"), known_type(F.col(label)).alias("type")), "id")
        typed = checkpointed(part.join(once, "id"))
        have += typed.count()
        found = typed if found is None else found.unionByName(typed)
        done, size = done + size, 2 * size
    if found is None:
        raise ValueError("no nodes")
    return found.orderBy("id").limit(max_nodes)
