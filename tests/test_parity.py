"""Smaller parts of the surface: probes, manifests, clients, part reports, sinks, quantiles, a second solver."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import latticebits
from latticebits.functions import columns as c
from latticebits.operators import digest, graph, logistic, models, selection, workflows
from latticebits.sources import records, services, tables


def test_package_surface():
    assert {"code_length", "per_positive", "per_sample"} == set(latticebits.__all__)
    import latticebits.sources as s

    assert all(hasattr(s, n) for n in s.__all__)


def test_bad_lines_are_numbered(spark, tmp_path):
    for name, lines in (("a", ['{"x": 1}', "", "[1]", '{"x": 2}', "{"]), ("b", ['{"x": 1}'] * 40 + ["no"])):
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = [(r.file[-6:], r.line) for r in records.bad_lines(spark, str(tmp_path)).orderBy("file", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.json", 3), ("a.json", 5), ("b.json", 41)]


def test_a_probe_reads_the_head_only(spark, tmp_path, monkeypatch):
    taken = []
    head = records._head
    monkeypatch.setattr(records, "HEAD_BYTES", 64)
    monkeypatch.setattr(records, "_head", lambda path, size: (taken.append(size), head(path, size))[1])
    record = json.dumps({"name": "é" * 200, "n": 1})
    for text, kind in ((f"[{record}, " + "9" * 100_000, "array"), (record + "\n" + "x" * 100_000, "lines"), (json.dumps({"a": 1, "b": [2]}, indent=2), "object"), ("﻿" + record, "lines")):
        (tmp_path / "p.json").write_text(text)
        assert records.first_record(spark, str(tmp_path / "p.json"))[1] == kind
    assert max(taken) < 10_000
    with gzip.open(tmp_path / "q.json.gz", "wt") as f:
        f.write(record)
    assert records.first_record(spark, str(tmp_path / "q.json.gz"))[0]["n"] == 1
    for bad in ("", "[1]", "3", '{"a": '):
        (tmp_path / "p.json").write_text(bad)
        with pytest.raises(ValueError):
            records.first_record(spark, str(tmp_path / "p.json"))


def test_clients_tell_no_secret():
    class Client:
        def versions(self):
            return [3]

    assert services.connect(Client, 3)
    with pytest.raises(ValueError):
        services.connect(Client, 4)

    def broken():
        raise KeyError("token-123")

    def absent():
        raise ImportError("token-123")

    for make in (broken, absent):
        with pytest.raises(RuntimeError) as e:
            services.connect(make, 3)
        assert "token-123" not in str(e.value) and e.value.__suppress_context__
    for bad in ({"strategies": ()}, {"node_table": ""}):
        with pytest.raises(ValueError):
            services.ExportConfig(3, **bad)


def test_bounded_reads_and_units(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in range(10)], "id long, x double, y double, z double")
    assert [tuple(r) for r in services.in_nanometres(df, ("x", "y", "z"), (8, 8, 33)).where("id = 2").collect()] == [(2, 16.0, 8.0, 66.0)]
    with pytest.raises(ValueError):
        services.in_nanometres(df, ("x", "y", "z"), (8, 0, 33))
    assert services.restricted(df, "id", [1, 2, 99], ["id"], 5).count() == 2 and services.restricted(df, limit=3).count() == 3


def test_heads_and_manifests():
    assert services.head(lambda: {"Content-Length": "12", "ETag": "e"}) == {"available": True, "content_length": 12, "content_type": None, "etag": "e", "last_modified": None, "accept_ranges": None}
    assert services.head(lambda: 1 / 0) == {"available": False, "error_type": "ZeroDivisionError", "content_length": None}
    assert services.shard_manifest([5, 7])[1] == {"shard": 1, "name": services.shard_name(1, 2), "bytes": 7}
    with pytest.raises(ValueError):
        services.shard_manifest([5, 0])
    assert services.installed_version("no-such-package") is None and services.installed_version("pyspark")


def test_part_reports(spark, tmp_path):
    def report(i, **other):
        r = {"part_index": i, "part_count": 2, "frozen_node_sha256": "s", "assigned_shards": [i, i + 2], "assigned_source_bytes": 10, "records_seen": 5, "shards": [{"shard_index": i, "expected_bytes": 5, "observed_bytes": 5}]}
        (tmp_path / f"part_{i}.json").write_text(json.dumps(r | other, indent=1))

    report(0)
    with pytest.raises(ValueError):
        workflows.read_part_reports(spark, str(tmp_path), 2, "s")
    report(1)
    parts = workflows.read_part_reports(spark, str(tmp_path), 2, "s")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    counts = spark.createDataFrame([(1, 2, 3)], "pre long, post long, synapse_count long")
    assert workflows.audit_parts(parts, counts, nodes, 4)["bytes"] == 20
    for bad in ({"part_count": 3}, {"frozen_node_sha256": "t"}, {"shards": [{"shard_index": 1, "expected_bytes": 5, "observed_bytes": 4}]}):
        report(1, **bad)
        with pytest.raises(ValueError):
            workflows.read_part_reports(spark, str(tmp_path), 2, "s")


def test_cohort_sink(spark, tmp_path):
    from latticebits.operators import bridge

    values = {f: 1 for f in bridge.COHORT_FIELDS}
    rows = spark.createDataFrame([tuple(str(values[f] + k) if k else "1" for f in bridge.COHORT_FIELDS) for k in (3, 0, 2)], ", ".join(f"{f} string" for f in bridge.COHORT_FIELDS))
    sha = tables.write_cohort(rows.repartition(3), str(tmp_path / "c.csv"))
    lines = (tmp_path / "c.csv").read_text().splitlines()
    assert lines[0] == ",".join(bridge.COHORT_FIELDS) and lines[1:] == sorted(lines[1:]) and len(lines) == 4
    assert sha == digest.sha256_file(tmp_path / "c.csv") == tables.write_cohort(rows, str(tmp_path / "d.csv"))
    assert len(digest.md5_file(tmp_path / "c.csv")) == 32


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], list(range(5000)), [7.0] * 4000 + [1.0, 9.0], [10.0**k for k in range(-20, 20)] * 30, [-5.0, -5.0, 0.0, 1e300]])
def test_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(selection, "FEW", 50)
    monkeypatch.setattr(selection, "MARGIN", 0.02)
    levels = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "d double").repartition(3)
    assert models.exact_quantiles(df, "d", levels) == pytest.approx(np.quantile(np.array(values, dtype=float), levels).tolist(), rel=1e-12)
    assert models.exact_quantiles(df.where("false"), "d", levels) is None


def test_partial_sums_of_many_tasks(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 97 + 1.0).alias("distance"), *[F.lit(0.0).alias(f"s{a}") for a in "xyz"], *[(F.col("id") % k + 0.5).alias(f"t{a}") for a, k in zip("xyz", (7, 11, 13))], (F.col("id") % 97 < 30).cast("int").alias("connected"))
    one = logistic.fit(rows, "relative", 1.0)
    monkeypatch.setattr(logistic, "DRIVER_PARTS", 1)
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 100)
    assert np.allclose(logistic.fit(rows, "relative", 1.0).coefficients, one.coefficients, atol=1e-8)


def test_solver_against_mllib(spark):
    """The library's own logistic regression minimises the same objective (mean loss, penalty over the rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    nodes = spark.createDataFrame([(i, "unknown", float(20 * i), float(11 * (i % 5)), float(13 * (i % 4))) for i in range(40)], "id long, type string, x double, y double, z double")
    pairs = graph.candidate_pairs(nodes).withColumn("connected", ((F.col("distance") < 90) | ((F.col("source") * F.col("target")) % 11 == 3)).cast("int")).cache()
    n = pairs.count()
    ours = logistic.fit(pairs, "relative", 1.0)
    rows = pairs.select(F.col("connected").cast("double").alias("label"), *[v.alias(k) for k, v in c.geometry_features("relative").items()])
    rows = VectorAssembler(inputCols=list(c.geometry_features("relative")), outputCol="features").transform(rows)
    other = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=True, tol=1e-12, maxIter=500).fit(rows)
    raw = ours.coefficients[1:] / ours.scales
    assert np.allclose(raw, other.coefficients.toArray(), rtol=2e-2, atol=1e-4)
    assert ours.coefficients[0] - raw @ ours.means == pytest.approx(other.intercept, rel=1e-2)
