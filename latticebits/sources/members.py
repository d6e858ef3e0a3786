"""A sorted, gzipped CSV as files that are written together or not at all.

Rows are numbered in a stated order and cut into members of a fixed number of rows, a gzip file each without time or
name inside. So equal rows give equal bytes whatever the partitions, and the members one after another (the first holds
the header) are one valid gzip file. Tasks write members under a staging name; the commit moves them to their places and
then writes the list of them, and an abort removes what was staged. No row passes through the driver.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from latticebits.operators.ranking import ranked

MEMBER_ROWS = 1_000_000
LIST = "members.json"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _packed(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


@dataclass
class _Staged(WriterCommitMessage):
    members: list[tuple[int, str, int]]  # number, staged name, rows


class _Writer(DataSourceArrowWriter):
    """Batches hold a column __member and then those of the file; the rows of a member come together, in order."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.stage = path, names, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import csv

        system, at = _system(self.path)
        system.create_dir(f"{at}/{self.stage}")
        out: list[tuple[int, str, int]] = []
        number, rows, text = None, 0, io.BytesIO()

        def close() -> None:
            nonlocal rows, text
            if number is not None:
                name = f"{self.stage}/{number:08d}-{uuid.uuid4().hex}"  # a task that runs again writes another name
                with system.open_output_stream(f"{at}/{name}", compression=None) as f:
                    f.write(_packed(text.getvalue()))
                out.append((number, name, rows))
            rows, text = 0, io.BytesIO()

        for batch in iterator:
            member = batch.column(0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(member):
                if member[lo] != number:
                    close()
                    number = int(member[lo])
                hi = lo + int((member[lo:] == number).sum())  # members are sorted
                csv.write_csv(pa.Table.from_batches([batch.slice(lo, hi - lo)]).drop_columns(["__member"]), text, csv.WriteOptions(include_header=False, quoting_style="needed"))
                rows, lo = rows + hi - lo, hi
        close()
        return _Staged(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _system(self.path)
        staged = sorted(m for message in messages if message is not None for m in message.members)
        if [m[0] for m in staged] != list(range(len(staged))):
            raise RuntimeError("members are missing or repeat")
        listed = [{"name": "00000000-header.csv.gz", "rows": 0}]
        with system.open_output_stream(f"{at}/{listed[0]['name']}", compression=None) as f:
            f.write(_packed((",".join(f'"{n}"' if set(n) & set(',"\n') else n for n in self.names) + "\n").encode()))
        for number, name, rows in staged:
            listed.append({"name": f"{number + 1:08d}.csv.gz", "rows": rows})
            system.move(f"{at}/{name}", f"{at}/{listed[-1]['name']}")
        self._clear()
        with system.open_output_stream(f"{at}/{LIST}") as f:
            f.write(json.dumps(listed, indent=2).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = _system(self.path)
        if system.get_file_info(f"{at}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.stage}")


def write_members(df: DataFrame, path: str, *order: str | Column, member_rows: int = MEMBER_ROWS) -> int:
    """df as members at path (a new folder on a file system that driver and executors share); how many rows."""
    from pyarrow import fs

    system, at = _system(path)
    if system.get_file_info(f"{at}/{LIST}").type != fs.FileType.NotFound:
        raise ValueError(f"{path} holds members already")
    names = df.columns
    rows, n = ranked(df, *order, name="__rank")
    member = F.call_function("div", F.col("__rank") - 1, F.lit(member_rows))
    placed = rows.withColumn("__member", member).repartition("__member").sortWithinPartitions("__member", "__rank").select("__member", *[F.col(f"`{c}`") for c in names])
    shape = placed.schema

    class Members(DataSource):
        @classmethod
        def name(cls) -> str:
            return "latticebits_members"

        def schema(self) -> StructType:
            return shape

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            return _Writer(path, names)

    system.create_dir(at)
    df.sparkSession.dataSource.register(Members)
    placed.write.format("latticebits_members").mode("append").save()
    return n


def listed_members(path: str) -> list[dict]:
    """The members of a finished write, header first."""
    system, at = _system(path)
    with system.open_input_stream(f"{at}/{LIST}") as f:
        return json.loads(f.read())


def read_members(spark, path: str, schema: str) -> DataFrame:
    """The rows of the members under a schema, the header left out."""
    names = [m["name"] for m in listed_members(path) if m["rows"]]
    return spark.read.schema(schema).csv([f"{path}/{n}" for n in names], mode="FAILFAST", escape='"') if names else spark.createDataFrame([], schema)
