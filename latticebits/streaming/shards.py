"""Shards of a release as a stream whose offsets are shards: counted exactly once, however often a run stops.

A batch is the next `per_batch` shards, each a partition that a task fetches. A batch first writes its counts and then
its report, both under the name of the shard it goes up to and both written over if the batch runs again; the report
tells the source where the next batch ends. So a run that stops anywhere goes on with the shard after the last report,
and counts and reports are those of a run that never stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from latticebits.operators import graph
from latticebits.sources import records

LINES = "shard int, n_bytes long, value string"
BATCH_LINES = 8192


@dataclass(frozen=True)
class Shard:
    index: int
    name: str
    n_bytes: int


class ShardStore(Protocol):
    """Picklable: tasks fetch from it."""

    def lines(self, shard: Shard) -> Iterator[bytes]: ...


@dataclass(frozen=True)
class FolderStore:
    root: str

    def lines(self, shard: Shard) -> Iterator[bytes]:
        system, at = _system(self.root)
        with system.open_input_stream(f"{at}/{shard.name}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (line + b"\n" for line in whole)
            if rest:
                yield rest


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed_shards(folder: str, suffix: str = "") -> list[Shard]:
    """The files of a folder in the order of their names, with their sizes."""
    from pyarrow import fs

    system, at = _system(folder)
    files = sorted((f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[:1] not in "._"), key=lambda f: f.base_name)
    return [Shard(i, f.base_name, f.size) for i, f in enumerate(files)]


def finished(out: str) -> int:
    """Shards before the first that no report covers."""
    from pyarrow import fs

    system, at = _system(f"{out}/reports")
    if system.get_file_info(at).type != fs.FileType.Directory:
        return 0
    return max((int(f.path.split("upto=")[1].split("/")[0]) for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.base_name == "_SUCCESS" and "upto=" in f.path), default=0)


@dataclass
class _Part(InputPartition):
    shard: Shard


class _Stream(DataSourceStreamReader):
    def __init__(self, shards: Sequence[Shard], store: ShardStore, out: str, per_batch: int):
        self.shards, self.store, self.out, self.per_batch = shards, store, out, per_batch

    def initialOffset(self) -> dict:
        return {"shard": 0}

    def latestOffset(self) -> dict:
        return {"shard": min(len(self.shards), finished(self.out) + self.per_batch)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Part(s) for s in self.shards[start["shard"] : end["shard"]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shard, seen, held = partition.shard, 0, []

        def made(values: list[str | None], n_bytes: int) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([shard.index] * n, pa.int32()), pa.array([n_bytes] * n, pa.int64()), pa.array(values, pa.string())], ["shard", "n_bytes", "value"])

        for line in self.store.lines(shard):
            seen += len(line)
            if text := line.decode().strip():
                held.append(text)
            if len(held) >= BATCH_LINES:
                yield made(held, 0)
                held = []
        if held:
            yield made(held, 0)
        if seen != shard.n_bytes:
            raise ValueError(f"{shard.name} has {seen} bytes, {shard.n_bytes} were expected")
        yield made([None], seen)  # closes the shard, also one without records

    def commit(self, end: dict) -> None:
        pass


def extract(spark: SparkSession, shards: Sequence[Shard], store: ShardStore, ids: DataFrame, out: str, *, per_batch: int = 8, most_batches: int | None = None, before_report: Callable[[int], None] | None = None) -> bool:
    """Pair counts of the records of all shards with both ends among ids, batch by batch, below out; whether all are done.

    A later call goes on where an earlier one stopped, for whatever reason. most_batches ends a call early;
    before_report(upto) is called between a batch's counts and its report."""
    if [s.index for s in shards] != list(range(len(shards))) or per_batch < 1:
        raise ValueError("shards must be numbered from 0, and a batch must have one at least")
    shape = spark.createDataFrame([], LINES).schema

    class Shards(DataSource):
        @classmethod
        def name(cls) -> str:
            return "latticebits_shards"

        def schema(self) -> StructType:
            return shape

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Stream(shards, store, out, per_batch)

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            closed = rows.groupBy("shard").agg(F.max("n_bytes").alias("n_bytes"), F.count("value").alias("records")).orderBy("shard").collect()  # a row a shard of the batch
            if not closed:
                return
            upto = closed[-1]["shard"] + 1
            counts = records.selected_counts(records.endpoints_of(rows.where("value IS NOT NULL")), ids)
            counts.write.mode("overwrite").parquet(f"{out}/counts/upto={upto}")
            if before_report:
                before_report(upto)
            report = [([r["shard"] for r in closed], sum(r["n_bytes"] for r in closed), sum(r["records"] for r in closed))]
            spark.createDataFrame(report, "shards array<int>, bytes long, records long").coalesce(1).write.mode("overwrite").json(f"{out}/reports/upto={upto}")
        finally:
            rows.unpersist()

    spark.dataSource.register(Shards)
    turns = 0
    while finished(out) < len(shards) and (most_batches is None or turns < most_batches):
        stream = spark.readStream.format("latticebits_shards").load()
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        turns += 1
    return finished(out) >= len(shards)


def extracted_counts(spark: SparkSession, out: str) -> DataFrame:
    """(pre, post, synapse_count) of all batches that have a report, added up."""
    done = spark.read.schema("upto int, shards array<int>").json(f"{out}/reports").select("upto").distinct()
    parts = spark.read.parquet(f"{out}/counts").join(F.broadcast(done), "upto", "left_semi")  # a row a batch
    return graph.merged_counts(parts.select("pre", "post", "synapse_count"))


def extracted_parts(spark: SparkSession, out: str) -> DataFrame:
    """(part, shards, bytes, records) of the reports, as workflows.audit_parts() takes them."""
    return spark.read.schema("upto int, shards array<int>, bytes long, records long").json(f"{out}/reports").withColumnRenamed("upto", "part")
