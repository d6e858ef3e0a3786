"""Vector codes from product codebooks, trained by Lloyd rounds that move only differences.

Components become integers and every vector is cut into PARTS parts with a codebook each. Vectors are packed once into
blocks in the shared folder. A round reads the blocks, assigns their parts to the codebooks, and writes the assignments
by block beside what they changed: for each part that went from one entry to another the vector part is taken from the
old entry's sum and added to the new one's, added up in the block. Only these integers are shuffled, and the driver adds
them to the running sums (PARTS times ENTRIES vector parts, whatever the table's size), from which the next codebooks
come. A task finds the assignments of the round before in the shared folder, those of 2**SLICE blocks at a time, so
neither vectors nor assignments are shuffled, and a task that is run again finds the same.

Rounds that change no codebook would repeat themselves and are left out. Blocks grow with the square root of the table
once it is large, and with them the number of files of a round stays in proportion to that root.

Arithmetic is exact: doubles where all partial sums stay below 2**53, 64-bit integers below 2**62, Python's integers
beyond; sums travel as limbs of 18 digits where they could leave 64 bits.

Defined results: vectors that are null, empty or hold a null or non-finite component (or one whose scaled value is not
finite) go; the length is that of the smallest kept vec_id (null last; of equal ids the vector that sorts first), vectors
of another length go, and where it isn't a multiple of PARTS all do; of fewer vectors than ENTRIES the codebooks have as
many entries; repeated rows count each; null vec_ids stay null; an error outside of 64 bits is reported as the largest
value inside; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import chunks, memory, shared
from latticebits.llm.topk import fitted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
BLOCK_BYTES, LEAST_ROWS = 8 << 20, 1024
#: A block has at least the square root of so many times the table, in bytes of doubles.
GROWTH = 64
#: Blocks whose assignments share a folder: 2**SLICE.
SLICE = 3
LIMB = 10**18
#: Tables of labels of so many rows at most are sent to every executor.
BROADCAST_LABELS = 200_000
_MOST = 2**63 - 1
MOVED = "slice long, block long, codes binary, keys array<long>, amounts array<long>"


def whole_vectors(embeddings: DataFrame, scale: float = SCALE, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every usable vector, as doubles without a fraction."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger ones have no fraction
    return rows.where((F.size("x") > 0) & fine).select("vec_id", "label", F.transform("x", whole).alias("v"))


def _kind(bound: int) -> type:
    return float if bound < 2**53 else np.int64 if bound < 2**62 else object


def _narrow(data: np.ndarray) -> np.ndarray:
    """Whole doubles in the fewest bytes that hold them."""
    most = np.abs(data).max(initial=0.0)
    return data.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


@dataclass
class Codebooks:
    """Entries of each part, as Python integers, and the arithmetic in which distances to them are exact."""

    entries: list[list[list[int]]]
    most: int

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def kind(self) -> type:
        return _kind(4 * len(self.entries) * self.width * (self.most + 1) ** 2)

    def arrays(self) -> list[np.ndarray]:
        kind = self.kind()
        return [np.array(e, dtype=object if kind is object else kind) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def assign(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each vector (ties to the lower), and the squared distances added up."""
    codes, errors, width = np.zeros((len(vectors), len(books)), np.uint8), 0, books[0].shape[1]
    for p, book in enumerate(books):
        own = vectors[:, p * width : (p + 1) * width]
        away = (book * book).sum(axis=1)[None, :] - 2 * (own @ book.T)  # less the vector's own square, the same for all
        codes[:, p] = away.argmin(axis=1)
        errors = errors + away[np.arange(len(own)), codes[:, p]] + (own * own).sum(axis=1)
    return codes, errors


def moved(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, n_entries: int, limbs: int) -> tuple[list[int], list[int]]:
    """Sparse plus and minus contributions of the parts whose entry changed: keys count (part, entry, place, limb),
    place 0 the number of parts and the others their components."""
    keys, amounts = [], []
    width = vectors.shape[1] // new.shape[1]
    for p in range(new.shape[1]):
        changed = slice(None) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        own, now, was = vectors[changed, p * width : (p + 1) * width], new[changed, p], None if old is None else old[changed, p]
        for e in range(n_entries):
            to = now == e
            n, total = int(to.sum()), own[to].sum(axis=0)
            if was is not None:
                gone = was == e
                n, total = n - int(gone.sum()), total - own[gone].sum(axis=0)
            for place, x in enumerate([n, *(total.tolist() if np.ndim(total) else [0] * width)]):
                x = int(x)
                for limb in range(limbs):
                    x, part = (0, x) if limb == limbs - 1 else divmod(x, LIMB)
                    if part:
                        keys.append(((p * n_entries + e) * (width + 1) + place) * limbs + limb)
                        amounts.append(part)
    return keys, amounts


class _Before:
    """Assignments of the round before, those of the slice read last kept."""

    def __init__(self, path: str | None):
        self.path, self.slice, self.found = path, -1, {}

    def of(self, block: int, parts: int) -> np.ndarray | None:
        if self.path is None:
            return None
        if block >> SLICE != self.slice:
            import pyarrow.dataset as ds
            from pyarrow import fs

            self.slice = block >> SLICE
            system, at = fs.FileSystem.from_uri(shared.arrow_uri(f"{self.path}/slice={self.slice}"))
            rows = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["block", "codes"])
            self.found = dict(zip(rows.column("block").to_pylist(), rows.column("codes").to_pylist()))
        return np.frombuffer(self.found[block], np.uint8).reshape(-1, parts)


def _packed(vectors: DataFrame, size: int, block_rows: int) -> DataFrame:
    """vectors (vec_id, label, v) as blocks of rows."""
    label = vectors.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            nonlocal block, n
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            tight = _narrow(data)
            one = pa.array([0, n], pa.int32())
            columns = [pa.array([block], pa.int64()), pa.array([str(int(np.abs(data).max(initial=0.0)))]), pa.array([tight.dtype.str]), pa.ListArray.from_arrays(one, rows.column(0)), pa.ListArray.from_arrays(one, rows.column(1)), pa.array([tight.tobytes()], pa.binary())]
            held.clear()
            block, n = block + 1, 0
            return pa.RecordBatch.from_arrays(columns, ["block", "most", "kind", "ids", "labels", "data"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                piece = batch.slice(lo, block_rows - n)
                held.append(piece)
                lo, n = lo + piece.num_rows, n + piece.num_rows
                if n >= block_rows:
                    yield made()
        if n:
            yield made()

    return vectors.mapInArrow(pack, f"block long, most string, kind string, ids array<long>, labels array<{label}>, data binary")


def _blocks(batches: Iterator[pa.RecordBatch], size: int, kind: type) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each block's row, number and vectors in an arithmetic."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("data")[i].as_buffer(), np.dtype(batch.column("kind")[i].as_py())).reshape(-1, size)
            yield batch.slice(i, 1), batch.column("block")[i].as_py(), fitted(data, kind)
            memory.after(data.nbytes)


@dataclass
class Trained:
    """Packed vectors, their final codebooks and how many part assignments changed in each round."""

    blocks: DataFrame
    books: Codebooks
    size: int
    changed: list[int]

    def coded(self) -> DataFrame:
        """(vec_id, label, code, error) of every vector."""
        size, books = self.size, self.books

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = books.arrays()
            for row, _, vectors in _blocks(batches, size, books.kind()):
                codes, errors = assign(vectors, arrays)
                text = codes.tobytes().hex()
                step = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids")[0].values, row.column("labels")[0].values, pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array([min(int(e), _MOST) for e in errors.tolist()], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

        label = self.blocks.schema["labels"].dataType.elementType.simpleString()
        with chunks.small_batches(self.blocks.sparkSession, 1):
            return shared.written(self.blocks.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "codes", result=True)


def train(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int | None = None) -> Trained | None:
    """Codebooks of vectors (vec_id, label, v), None where there are no vectors. Runs inside a scratch()."""
    spark = vectors.sparkSession
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    head = vectors.orderBy(*order).limit(1).collect()
    if not head or len(head[0]["v"]) % parts:
        return None
    size = len(head[0]["v"])
    vectors = vectors.where(F.size("v") == size)
    first = vectors.orderBy(*order).limit(entries).collect()
    width, n_entries = size // parts, len(first)
    if block_rows is None:
        block_rows = max(LEAST_ROWS, max(BLOCK_BYTES, isqrt(GROWTH * 8 * size * vectors.count())) // (8 * size))
    with chunks.small_batches(spark, min(block_rows, 10_000)):
        blocks = shared.written(_packed(vectors, size, block_rows), "vector-blocks")
    most = int(blocks.agg(F.max(F.struct(F.length("most"), "most")).alias("m")).first()["m"]["most"])
    bound = block_rows * (most + 1)
    limbs = 1 if bound < 2**62 else -(-len(str(bound)) // 18)
    books = Codebooks([[[int(x) for x in row["v"][p * width : (p + 1) * width]] for row in first] for p in range(parts)], most)
    sums = [[[0] * (width + 1) for _ in range(n_entries)] for _ in range(parts)]
    before: str | None = None
    changed: list[int] = []
    for _ in range(rounds):
        path = shared.new_path(spark, "assignments")

        def step(batches: Iterator[pa.RecordBatch], books: Codebooks = books, before: str | None = before) -> Iterator[pa.RecordBatch]:
            arrays, earlier = books.arrays(), _Before(before)
            # sums of a block need no more room than distances where blocks are small against squares
            kind = _kind(max(bound, 4 * size * (most + 1) ** 2))
            for _, block, x in _blocks(batches, size, kind):
                new, _ = assign(x, [fitted(a, kind) for a in arrays])
                keys, amounts = moved(x, earlier.of(block, parts), new, n_entries, limbs)
                yield pa.RecordBatch.from_arrays([pa.array([block >> SLICE], pa.int64()), pa.array([block], pa.int64()), pa.array([new.tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([amounts], pa.list_(pa.int64()))], ["slice", "block", "codes", "keys", "amounts"])

        with chunks.small_batches(spark, 1):
            blocks.select("block", "kind", "data").mapInArrow(step, MOVED).write.partitionBy("slice").option("compression", "zstd").parquet(path)
        moves = spark.read.schema(MOVED).parquet(path).select(F.explode(F.arrays_zip("keys", "amounts")).alias("m")).groupBy(F.col("m.keys").alias("key")).agg(F.sum(F.col("m.amounts").cast("decimal(38,0)")).alias("amount"))
        for key, amount in moves.collect():  # at most PARTS * ENTRIES vector parts
            at, limb = divmod(key, limbs)
            entry, place = divmod(at, width + 1)
            sums[entry // n_entries][entry % n_entries][place] += int(amount) * LIMB**limb
        new = [[[x // total[0] for x in total[1:]] if total[0] else old for total, old in zip(*both)] for both in zip(sums, books.entries)]
        changed.append(sum(a != b for was, now in zip(books.entries, new) for a, b in zip(was, now)))
        before, books = path, Codebooks(new, most)
        if not changed[-1]:
            break
    return Trained(blocks, books, size, changed)


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, label, v)."""
    spark = vectors.sparkSession
    with shared.scratch(spark):
        trained = train(vectors, **options)
        if trained is None:
            return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        rows = trained.coded()
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(trained.books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(whole_vectors(shared.table(spark, sf_dir, "embeddings")))


ORACLE_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x, len(x) // 8 AS w
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT r, part, x[part * w + 1 : (part + 1) * w] AS x, w FROM v, range(8) t(part)),
cb AS (
  SELECT 0 AS i, part, r - 1 AS entry, x AS c FROM p WHERE r <= 16
  UNION ALL
  SELECT cb.i + 1, cb.part, cb.entry, coalesce(n.c, cb.c)
  FROM cb LEFT JOIN (
    SELECT part, entry, list(CAST(floor(CAST(s - ((s % n + n) % n) AS DOUBLE) / n) AS DOUBLE) ORDER BY pos) AS c
    FROM (SELECT part, entry, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT p.r, p.part, p.w, any_value(p.x) AS x, arg_min(b.entry, (list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c), b.entry)) AS entry FROM p JOIN cb b ON p.part = b.part GROUP BY p.r, p.part, p.w) a, range(1, a.w + 1) t(pos)
          GROUP BY part, entry, pos)
    GROUP BY part, entry) n ON cb.part = n.part AND cb.entry = n.entry
  WHERE cb.i < 6),
f AS MATERIALIZED (SELECT part, entry, c FROM cb WHERE i = 6),
a AS (SELECT r, part, min(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, f.c) + list_inner_product(f.c, f.c)) AS e, arg_min(entry, (list_inner_product(f.c, f.c) - 2 * list_inner_product(p.x, f.c), entry)) AS entry FROM p JOIN f USING (part) GROUP BY r, part),
g AS MATERIALIZED (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(e) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) FROM f) AS codebooks_sha256
FROM v JOIN g USING (r)
"""
