"""Token-ID output: documents to directly addressable files in ascending doc_id order, and back.

Layout of a folder: `data` holds plain binary files, one a writing task, of segments end to end; a segment of whole
documents is a code of dac.py, stored as it is. `index` is a Parquet table (part, seg, part_start, n_tokens, file,
offset, size, doc_ids, doc_lengths) with a row a segment, `parts` one of (part, base, n_tokens) with a row a task. Parts
follow each other in doc_id order (a range partitioning), segments within a part likewise. Where a part begins in the
corpus is the sum of the tokens of the parts before it, so no task needs to know another's counts while it writes.
A task that is run again writes a file of another name, and only what it commits to the index is ever read.

token_at() finds its segment in the two tables and then reads a few bytes of one file: no block is decoded.

Defined results: null text counts as empty (only the end id); null doc_id comes first; rows with one doc_id are
documents of their own, in the order of their texts; an empty table gives empty tables and no rows; extra columns
are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticebits.llm import dac, shared, tokens

SEGMENT_TOKENS = 1 << 18
#: Characters of a text that, behind doc_id, deal rows to parts: rows of one (or no) doc_id are many tasks' work.
HEAD = 16

INDEX = "part int, seg int, part_start long, n_tokens long, file string, offset long, size long, doc_ids array<long>, doc_lengths array<long>"
PARTS = "part int, base long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _opened(path: str, name: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(shared.arrow_uri(f"{path}/data/{name}"))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, *, segment_tokens: int = SEGMENT_TOKENS, end_id: int = tokens.END_ID) -> None:
    """Encode every whole text of docs (doc_id, text) and write the files at path."""
    tokenizer_path = tokenizer_path or tokens.default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path, end_id)
        part, seg, begun, offset = TaskContext.get().partitionId(), 0, 0, 0
        name, out = f"{part:06d}-{uuid.uuid4().hex}.dac", None
        ids: list[int | None] = []
        coded: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal seg, begun, size, offset, out
            if out is None:
                system, at = _opened(path, name)
                system.create_dir(at.rsplit("/", 1)[0])
                out = system.open_output_stream(at)
            code = dac.encode(np.frombuffer(b"".join(coded), "<u4"))
            out.write(code)
            lengths = [len(c) // 4 for c in coded]
            values = (part, seg, begun, size, name, offset, len(code), ids, lengths)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in INDEX.split(", ")])
            seg, begun, size, offset = seg + 1, begun + size, 0, offset + len(code)
            ids.clear()
            coded.clear()
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                for doc_id, got in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1))):
                    ids.append(doc_id)
                    coded.append(got)
                    size += len(got) // 4
                    if size >= segment_tokens:
                        yield segment()
        if coded:
            yield segment()
        if out is not None:
            out.close()

    rows = shared.columns(docs, "doc_id", "text")
    ordered = rows.repartitionByRange(shared.null_first("doc_id"), F.substring("text", 1, HEAD).asc_nulls_first()).sortWithinPartitions(shared.null_first("doc_id"), shared.null_first("text"))
    ordered.mapInArrow(encode, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    totals = _index(docs.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row a part
    totals.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"), "n_tokens").coalesce(1).write.parquet(f"{path}/parts")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Broadcast: one row per written part, so at most the number of shuffle partitions of the writing job."""
    base = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "base")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for start, file, offset, size, doc_ids, lengths in zip(*(batch.column(i) for i in range(6))):
                if file.as_py() != name:
                    name = file.as_py()
                    system, at = _opened(path, name)
                    source = system.open_input_file(at)
                code = source.read_at(size.as_py(), offset.as_py())
                doc_ids, lengths = doc_ids.values, np.asarray(lengths.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                raw = memoryview(dac.Reader(code).decode().tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(begins + start.as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = _index(spark, path).join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "file", "offset", "size", "doc_ids", "doc_lengths")
    return placed.mapInArrow(decode, READ_SCHEMA)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of the corpus: a row of each table, then a few bytes of one file."""
    part = spark.read.schema(PARTS).parquet(f"{path}/parts").where((F.col("base") <= position) & (F.col("base") + F.col("n_tokens") > position)).first()
    if part is None:
        raise IndexError(position)
    left = position - part["base"]
    row = _index(spark, path).where((F.col("part") == part["part"]) & (F.col("part_start") <= left) & (F.col("part_start") + F.col("n_tokens") > left)).select("part_start", "file", "offset").first()
    system, at = _opened(path, row["file"])
    with system.open_input_file(at) as source:
        return dac.Reader(lambda i, n: source.read_at(n, row["offset"] + i))[left - row["part_start"]]


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-ids")
    write_ids(shared.documents(spark, sf_dir), path)
    return read_ids(spark, path)
