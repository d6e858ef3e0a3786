"""Exact top-k inner-product search with a KD-tree per shard.

Every shard builds a KD-tree over its vectors: the dimension of largest extent is split at the median position until
a leaf holds at most LEAF vectors, and every node keeps the tight bounding box of what it holds. Trees are built once
and written. A query walks a tree best-first by the largest inner product that a node's box allows, and stops when no
open node can reach its k-th score so far. That k-th score starts from a bounded probe of the table; after a first round
over one of FIRST shards the best k of each query are merged and the others start from what these have reached.

Queries lie in the shared folder as blocks of about BLOCK, packed by tasks; each shard's task reads one block after the
other. So the driver sees no query, and a task holds one tree and one block.

Products are exact: doubles where every partial sum stays below 2**53, 64-bit integers below 2**62, Python's integers
beyond.

Defined results: vectors that are null, empty, or hold a null or non-finite component (or one whose scaled value is not
finite), and rows of null id, take no part; every query row is searched for itself, also where its id repeats, among all
rows but itself, so also among others of its id; ties go to the smaller id; vectors of another length than the query's
are not comparable and left out; rows are ranked by their exact scores, of which one outside of
64 bits is reported as the nearest value inside; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticebits.llm import chunks, shared

LEAF = 256
BLOCK = 4096
#: Vectors of the probe, of at most PROBE_BYTES of components.
PROBE, PROBE_BYTES = 2048, 4 << 20
SHARD_ROWS = 50_000
#: One of so many shards is searched in the first round.
FIRST = 8
FOUND = "query_row long, query_id long, vec_id long, score long, beyond binary, reached double"
_MOST = 2**63 - 1


def fitted(a: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles in the arithmetic `kind`: float, np.int64 or object (Python's integers)."""
    return np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape) if kind is object else a.astype(kind)


def arithmetic(size: int, a: np.ndarray, b: np.ndarray) -> type:
    """The fastest arithmetic in which products of rows of a and b, `size` long, are exact."""
    largest = size * (int(np.abs(a).max(initial=0.0)) + 1) * (int(np.abs(b).max(initial=0.0)) + 1)
    return float if largest < 2**53 else np.int64 if largest < 2**62 else object


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


class KDTree:
    """rows, ids and vectors of whole numbers in leaf order, nodes (begin, end, left, right) with their boxes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        nodes: list[tuple[int, int, int, int]] = []
        low, high = [], []

        def build(begin: int, end: int) -> int:
            own = vectors[order[begin:end]]
            me = len(nodes)
            lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            nodes.append((begin, end, -1, -1))
            if end - begin > leaf:
                axis, mid = int((hi / 2 - lo / 2).argmax()), (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, axis], mid)]
                nodes[me] = (begin, end, build(begin, begin + mid), build(begin + mid, end))
            return me

        if len(ids):
            build(0, len(ids))
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order].astype(np.float64)
        self.nodes = np.array(nodes, dtype=np.int64).reshape(-1, 4)
        self.low, self.high = (np.array(x, dtype=np.float64).reshape(len(nodes), -1) for x in (low, high))
        self._kept: dict[type, tuple[np.ndarray, ...]] = {}

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows, ids=self.ids, vectors=self.vectors, nodes=self.nodes, low=self.low, high=self.high)
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> KDTree:
        tree = object.__new__(cls)
        with np.load(io.BytesIO(packed)) as parts:
            tree.rows, tree.ids, tree.vectors, tree.nodes, tree.low, tree.high = (parts[n] for n in ("rows", "ids", "vectors", "nodes", "low", "high"))
        tree._kept = {}
        return tree

    def within(self, kind: type) -> tuple[np.ndarray, ...]:
        """Vectors and boxes in an arithmetic."""
        if kind not in self._kept:
            self._kept = {kind: tuple(fitted(a, kind) for a in (self.vectors, self.low, self.high))}
        return self._kept[kind]

    def bounds(self, queries: np.ndarray, kind: type = float) -> np.ndarray:
        """The largest inner product that each node's box allows each query."""
        _, low, high = self.within(kind)
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor: float, kind: type = float) -> list[tuple[int, int]]:
        """The k best (score, id) with a score of at least floor, ties to smaller ids, without the row own."""
        vectors, nodes = self.within(kind)[0], self.nodes
        best_scores, best_ids = np.zeros(0, vectors.dtype), np.zeros(0, dtype=np.int64)
        kth, opened = (int(floor) if np.isfinite(floor) else float(floor)) if kind is object else floor, [(-bound[0], 0)]
        while opened and -opened[0][0] >= kth:
            _, node = heapq.heappop(opened)
            begin, end, left, right = nodes[node].tolist()
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(opened, (-bound[child], child))
                continue
            scores = vectors[begin:end] @ query
            keep = np.asarray(scores >= kth, dtype=bool) & (self.rows[begin:end] != own)
            if keep.any():
                best_scores, best_ids = np.concatenate([best_scores, scores[keep]]), np.concatenate([best_ids, self.ids[begin:end][keep]])
                if len(best_ids) > k:
                    top = _top(best_scores, best_ids, k)
                    best_scores, best_ids = best_scores[top], best_ids[top]
                if len(best_ids) == k:
                    kth = max(kth, best_scores.min())
        return [(int(s), int(i)) for s, i in zip(best_scores, best_ids)]


def quantised(embeddings: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector, as doubles without a fraction."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger ones have no fraction
    return rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & fine).select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _trees(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """(size, tree): the vectors of each task by length, shard_rows to a tree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        rows: dict[int, int] = {}

        def made(size: int) -> pa.RecordBatch:
            tree = KDTree(*(np.concatenate(c) for c in zip(*held.pop(size))))
            rows[size] = 0
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([tree.pack()], pa.binary())], ["size", "tree"])

        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == size))
                for lo in range(0, part.num_rows, shard_rows):
                    piece = part.slice(lo, shard_rows)
                    held.setdefault(size, []).append((piece.column(0).to_numpy(), piece.column(1).to_numpy(), _matrix(piece.column(2), size)))
                    rows[size] = rows.get(size, 0) + piece.num_rows
                    if rows[size] >= shard_rows:
                        yield made(size)
        for size in list(held):
            yield made(size)

    return vectors.mapInArrow(build, "size int, tree binary")


def _blocks(queries: DataFrame, probe: DataFrame, k: int, n_blocks: int, path: str) -> None:
    """Queries (row, vec_id, v, reached) packed by length and block at path, each with the score that k rows reach at least."""
    seen = probe.collect()  # a bounded probe
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["v"]) for r in seen}:
        rows = [r for r in seen if len(r["v"]) == size]
        by_size[size] = np.array([r["row"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        own_rows, ids, size = group.column("row").to_numpy(), group.column("vec_id").to_numpy(), group.column("size")[0].as_py()
        own = _matrix(group.column("v").combine_chunks(), size)
        floors = group.column("reached").to_numpy().copy()
        probe_rows, probe_vectors = by_size.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
        if len(probe_rows) > k and arithmetic(size, own, probe_vectors) is float:
            scores = own @ probe_vectors.T
            scores[own_rows[:, None] == probe_rows[None, :]] = -np.inf
            floors = np.maximum(floors, np.partition(scores, len(probe_rows) - k, axis=1)[:, -k])
        out = io.BytesIO()
        np.savez(out, rows=own_rows, ids=ids, vectors=own, floors=floors)
        return pa.table({"size": pa.array([size], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int32()), "packed": pa.array([out.getvalue()], pa.binary())})

    placed = queries.select("row", "vec_id", "v", "reached", F.size("v").alias("size"), F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    placed.groupBy("size", "block").applyInArrow(pack, "size int, block int, packed binary").write.partitionBy("size").parquet(path)


def _beyond(score: int) -> bytes | None:
    """What orders scores outside of 64 bits: sign, length and digits, so that larger scores compare as larger binaries."""
    if -_MOST - 1 <= score <= _MOST:
        return None
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    plain = len(digits).to_bytes(4, "big") + digits
    return b"\1" + plain if score > 0 else b"\0" + bytes(255 - b for b in plain)


def _searched(trees: DataFrame, blocks: str, k: int) -> DataFrame:
    """FOUND: of every tree the best k of every query of its length, one block of queries after another."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for size, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                system, at = fs.FileSystem.from_uri(shared.arrow_uri(f"{blocks}/size={size}"))
                if system.get_file_info(at).type != fs.FileType.Directory:
                    continue
                tree = KDTree.unpack(packed.as_buffer().to_pybytes())
                for part in ds.dataset(at, filesystem=system, format="parquet").to_batches(columns=["packed"], batch_size=1, batch_readahead=1, fragment_readahead=1):
                    for block in part.column(0):
                        with np.load(io.BytesIO(block.as_buffer().to_pybytes())) as q:
                            rows, ids, vectors, floors = q["rows"], q["ids"], q["vectors"], q["floors"]
                        kind = arithmetic(size, vectors, tree.vectors)
                        own = fitted(vectors, kind)
                        bounds = tree.bounds(own, kind)
                        out = [(int(rows[i]), int(ids[i]), v, s) for i in range(len(ids)) for s, v in tree.search(own[i], bounds[i], int(rows[i]), k, floors[i], kind)]
                        scores = [s for *_, s in out]
                        # as doubles rounded down, so that they are reached for certain
                        reached = np.array([_down(s) for s in scores])
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array([o[c] for o in out], pa.int64()) for c in range(3)], pa.array([min(max(s, -_MOST - 1), _MOST) for s in scores], pa.int64()), pa.array([_beyond(s) for s in scores], pa.binary()), pa.array(reached, pa.float64())],
                            ["query_row", "query_id", "vec_id", "score", "beyond", "reached"],
                        )

    return trees.select("size", "tree").mapInArrow(search, FOUND)


def _down(score: int) -> float:
    if -(2**53) <= score <= 2**53:
        return float(score)
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else float("-inf")


def top_k(vectors: DataFrame, is_query: Column, k: int, *, block: int = BLOCK, probe: int = PROBE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors (vec_id, v); is_query tells from vec_id which rows are queries."""
    spark = vectors.sparkSession
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.when(F.col("score") > 0, F.col("beyond")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("beyond")).desc_nulls_first(), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    with shared.scratch(spark):
        vectors = shared.written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast("array<double>").alias("v")), "vectors")
        queries = vectors.where(is_query)
        n, n_queries, longest = vectors.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        n_blocks = max(1, -(-n_queries // block))
        probe = max(1, min(probe, PROBE_BYTES // (8 * longest)))
        drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(min(1.0, probe / max(1, n)) * (1 << 20)))).limit(4 * probe)
        with chunks.small_batches(spark, shard_rows):
            trees = shared.written(_trees(vectors, shard_rows).withColumn("turn", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(FIRST)) == 0), "trees")
        blocks = shared.new_path(spark, "query-blocks")
        _blocks(queries.withColumn("reached", F.lit(float("-inf"))), drawn, k, n_blocks, blocks)
        found = None
        if trees.select("size").count() >= 2 * FIRST:  # of fewer, all are searched at once
            with chunks.small_batches(spark, 1):
                found = shared.written(best(_searched(trees.where("turn"), blocks, k)).drop("rank"), "found")
            merged = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("reached")).alias("least")).withColumnRenamed("query_row", "row")
            trees, blocks = trees.where("NOT turn"), shared.new_path(spark, "query-blocks")
            _blocks(queries.join(merged, "row", "left").withColumn("reached", F.coalesce("least", F.lit(float("-inf")))), drawn, k, n_blocks, blocks)
        with chunks.small_batches(spark, 1):
            rest = _searched(trees, blocks, k)
            out = best(rest if found is None else found.unionByName(rest)).select("query_id", "rank", "vec_id", "score")
            return shared.written(out, "top-k", result=True)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
