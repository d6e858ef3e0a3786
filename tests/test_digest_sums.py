"""Digests of tables add up those of rows: no row is shuffled."""

import random

from pyspark.sql import functions as F

from latticebits.operators import digest, graph, tiles
from latticebits.sources import tables


def test_digests_shuffle_no_rows(spark):
    df = spark.range(1000).selectExpr("id % 300 AS a", "CAST(id AS double) / 7 AS b", "IF(id % 5 = 0, NULL, CONCAT('t', id % 9)) AS c", "id % 2 = 0 AS d", "CAST(IF(id = 3, 'NaN', '0') AS double) AS e", "array(id) AS f")
    want = digest.table_digest(df)
    plan = digest._lanes(df)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "functions=[partial_count(1)" in plan  # what is sent is a line a task
    assert want == digest.table_digest(df.repartition(7, "c").select("f", "e", "d", "c", "b", "a"))
    for other in (df.withColumn("a", F.col("a") + (F.col("b") > 140).cast("int")), df.union(df.limit(1)), df.withColumn("c", F.coalesce("c", F.lit(""))), df.withColumnRenamed("a", "g"), df.limit(0)):
        assert digest.table_digest(other) != want
    assert digest.table_digest(df.limit(0)) == digest.table_digest(df.where("a < 0"))
    assert digest.table_digest(df.selectExpr("CAST(a AS int) AS a", "b", "c", "d", "e", "f")) == want


def test_nulls_are_told_by_their_columns(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert digest.table_digest(df.where("b = 2")) != digest.table_digest(spark.createDataFrame([(2, None)], "a int, b int"))
    assert digest.table_digest(df) != digest.table_digest(spark.createDataFrame([(None, 1), (2, None)], "a int, b int"))


def test_an_export_takes_few_bytes_a_pair(spark, tmp_path):
    """Before, as many as a file of the cross join, and a digest that shuffled a line of 64 letters for each."""
    r = random.Random(5)
    nodes = spark.createDataFrame([(i, r.choice("abc"), *(r.uniform(0, 1e6) for _ in "xyz")) for i in range(1500)], "id long, type string, x double, y double, z double")
    tables.save_export(graph.Graph(nodes, tiles.tiled(nodes).pairs()), str(tmp_path), {})
    graph.candidate_pairs(nodes).write.parquet(str(tmp_path / "join"))
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("pairs", "join")}
    assert size["pairs"] < 0.75 * size["join"]
    assert tables.validate_export(spark, str(tmp_path))["pairs"] == 1500 * 1499
