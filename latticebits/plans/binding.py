"""The relations of the domain over the tables of a scale-factor folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.operators import graph, splits
from latticebits.operators.tiles import Tiles, tiled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads back: below spark.checkpoint.dir, which only a local master may lack."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="latticebits-files-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"{own}/files"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(id, type, x, y, z) from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("id"), F.col("label").cast("string").alias("type"), *[(F.col("embedding")[i].cast("double") * 1e6).alias(a) for i, a in enumerate("xyz")])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(pre, post), loops included, from lineitem."""
    n = table(spark, sf_dir, "embeddings").count()
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n + 1).alias("pre"), (F.col("l_partkey") % n + 1).alias("post"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_counts(events(spark, sf_dir).where("pre <> post"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an export's limits: however large the table, all its pairs."""
    return graph.candidate_pairs(nodes(spark, sf_dir), max_pairs=None, max_nodes=None)


def tiles(spark: SparkSession, sf_dir: str, slabs: bool = False) -> Tiles:
    own = nodes(spark, sf_dir)
    return tiled(splits.slabs(own) if slabs else own, counts(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).pairs()


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that have an edge, from the edges: no pair of all is built for them."""
    return graph.connected_pairs(nodes(spark, sf_dir), counts(spark, sf_dir))


def slabbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_parts(pairs(spark, sf_dir), splits.slabs(nodes(spark, sf_dir)).select("id", "slab"), "slab")


#: The same in DuckDB.
SQL = """
nodes AS (SELECT vec_id + 1 AS id, CAST(label AS VARCHAR) AS type, CAST(embedding[1] AS DOUBLE) * 1e6 AS x, CAST(embedding[2] AS DOUBLE) * 1e6 AS y, CAST(embedding[3] AS DOUBLE) * 1e6 AS z FROM embeddings),
ev AS (SELECT l_orderkey % n + 1 AS pre, l_partkey % n + 1 AS post FROM lineitem, (SELECT count(*) AS n FROM embeddings)),
cnt AS (SELECT pre, post, count(*) AS synapse_count FROM ev WHERE pre <> post GROUP BY pre, post),
cand AS (SELECT a.id AS source, b.id AS target, a.type AS source_type, b.type AS target_type,
         sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS distance,
         a.x AS sx, a.y AS sy, a.z AS sz, b.x AS tx, b.y AS ty, b.z AS tz FROM nodes a JOIN nodes b ON a.id <> b.id),
pairs AS (SELECT cand.*, coalesce(synapse_count, 0) AS synapse_count, CAST(coalesce(synapse_count, 0) > 0 AS INTEGER) AS connected
          FROM cand LEFT JOIN cnt ON cand.source = cnt.pre AND cand.target = cnt.post),
slab AS (SELECT id, CAST(ntile(5) OVER (ORDER BY x, id) - 1 AS INTEGER) AS slab FROM nodes),
sp AS (SELECT pairs.*, s.slab AS s_slab, t.slab AS t_slab FROM pairs JOIN slab s ON pairs.source = s.id JOIN slab t ON pairs.target = t.id)
"""
