"""Texts staged as chunks, and questions that chunks ask about keys of the whole corpus.

stage() writes documents as rows of whole documents of a few MB (chunk, ids, ends, data), once, in the shared folder.
A chunk is the unit of every later pass: whichever task reads it, again after a loss too, sees the same bytes. A pass
may send, for each bucket of keys, one packed binary of what it asks; a bucket answers each chunk with one packed
binary; answers are written by chunk part to the shared folder, where the next pass over the chunks reads its own.
So neither texts nor keys travel as rows of their own, and texts are not shuffled.

Chunks and buckets grow with the square root of the corpus once it is large, so the number of messages, chunks times
buckets, grows in proportion to the corpus and each keeps some hundreds of bytes: 8 MB buckets and 2 MB chunks up to
about 80 GB of text, 28 and 7 MB at 1 TB, 283 and 71 MB at 100 TB.

Answers are read with pyarrow's file systems from the shared folder's URI (file, hdfs, s3, gs, abfs), those of SLICE
chunks at a time.

Defined results: null texts are empty texts, null doc_ids stay null (and compare as LAST); repeated rows are texts of
their own; an empty table has no chunks; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import memory, shared

CHUNK_BYTES, CHUNK_DOCS = 2 << 20, 16384
BUCKET_BYTES, MIN_BUCKETS = 8 << 20, 64
#: A bucket has at least the square root of so many times the corpus, in bytes; a chunk a quarter of that.
GROWTH = 800
#: Chunks whose answers share a folder: 2**SLICE.
SLICE = 3
#: Stands for a null doc_id in comparisons: later than every other.
LAST = 2**63 - 1
SCHEMA = "chunk long, n_bytes long, ids array<long>, ends array<long>, data binary"
ASK = "bucket int, chunk long, packed binary"
ANSWER = "slice long, chunk long, bucket int, packed binary"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """Few rows to an Arrow batch while plans over chunks (MBs each) run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Chunk:
    """Texts end to end, a line feed behind each; text d is data[begins[d]:ends[d]]."""

    id: int
    ids: pa.Array
    order: np.ndarray
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The text of every byte; separators count to the text before."""
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), self.ends + 1 - self.begins)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, ends = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
            data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
            yield Chunk(batch.column(0)[i].as_py(), ids, pc.fill_null(ids, LAST).to_numpy(), data, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends, ends)


@dataclass
class Corpus:
    spark: SparkSession
    path: str
    n_bytes: int
    n_buckets: int

    def scan(self, f: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches):
                yield from f(chunk)
                memory.after(len(chunk.data))

        return self.spark.read.schema(SCHEMA).parquet(self.path).mapInArrow(run, schema)

    def ask(self, ask: Callable[[Chunk], Iterator[tuple[int, bytes]]], answer: Callable[[int, list[bytes]], list[bytes]], name: str) -> str:
        """Where the answers are. ask gives (bucket, what it asks) for a chunk; answer gets a bucket and its questions,
        one of each chunk that has any, and gives as many answers."""

        def asked(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            for bucket, packed in ask(chunk):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk.id], pa.int64()), pa.array([packed], pa.binary())], ["bucket", "chunk", "packed"])

        def answered(group: pa.Table) -> pa.Table:
            replies = answer(group.column("bucket")[0].as_py(), group.column("packed").to_pylist())
            memory.after(group.nbytes)
            chunk = group.column("chunk")
            return pa.table({"slice": pa.array(chunk.to_numpy() >> SLICE, pa.int64()), "chunk": chunk, "bucket": group.column("bucket"), "packed": pa.array(replies, pa.binary())})

        path = shared.new_path(self.spark, name)
        with small_batches(self.spark):
            self.scan(asked, ASK).groupBy("bucket").applyInArrow(answered, ANSWER).repartition("slice").write.partitionBy("slice").option("compression", "zstd").parquet(path)
        return path


class Answers:
    """Answers to chunks, those of the slice read last kept."""

    def __init__(self, path: str):
        self.path, self.slice, self.found = path, -1, {}

    def of(self, chunk: int) -> dict[int, bytes]:
        """By bucket."""
        if chunk >> SLICE != self.slice:
            import pyarrow.dataset as ds
            from pyarrow import fs

            self.slice, self.found = chunk >> SLICE, {}
            system, at = fs.FileSystem.from_uri(shared.arrow_uri(f"{self.path}/slice={self.slice}"))
            if system.get_file_info(at).type == fs.FileType.Directory:
                for row in ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["chunk", "bucket", "packed"]).to_pylist():
                    self.found.setdefault(row["chunk"], {})[row["bucket"]] = row["packed"]
        return self.found.get(chunk, {})


def stage(docs: DataFrame) -> Corpus:
    """docs (doc_id, text) as chunks; null text counts as empty."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1), F.lit(0))).first()[0]
    bucket_bytes = max(BUCKET_BYTES, isqrt(GROWTH * n_bytes))
    chunk_bytes = max(CHUNK_BYTES, bucket_bytes // 4)
    chunk_docs = CHUNK_DOCS * max(1, chunk_bytes // CHUNK_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        size = count = 0

        def made() -> pa.RecordBatch:
            nonlocal chunk, size, count
            texts = pa.concat_arrays([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held])) - 1
            data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), b"\n")[0].as_buffer().to_pybytes() + b"\n"
            ids = pa.concat_arrays([h[0] for h in held])
            row = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.astype(np.int64)], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["chunk", "n_bytes", "ids", "ends", "data"])
            chunk, size, count = chunk + 1, 0, 0
            held.clear()
            return row

        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            lo = 0
            while lo < len(texts):
                hi = min(len(texts), lo + 1 + int(np.searchsorted(np.cumsum(sizes[lo:]), chunk_bytes - size)), lo + chunk_docs - count)
                held.append((batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), sizes[lo:hi]))
                size, count, lo = size + int(sizes[lo:hi].sum()), count + hi - lo, hi
                if size >= chunk_bytes or count >= chunk_docs:
                    yield made()
        if held:
            yield made()

    staged = shared.new_path(spark, "chunks")
    rows.mapInArrow(cut, SCHEMA).write.option("compression", "zstd").parquet(staged)
    return Corpus(spark, staged, n_bytes, max(MIN_BUCKETS, -(-n_bytes // bucket_bytes)))


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane: near-empty high planes shrink in the shuffle's compression."""
    return np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T).tobytes()


def from_planes(packed: bytes | memoryview, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def by_bucket(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted bucket column."""
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if cut[b] < cut[b + 1]:
            yield b, slice(int(cut[b]), int(cut[b + 1]))
