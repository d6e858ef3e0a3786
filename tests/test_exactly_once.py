"""Shards counted exactly once over stops, and members that are written together or not at all."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from latticebits.operators import workflows
from latticebits.sources import members, tables
from latticebits.streaming import shards


@pytest.fixture
def release(tmp_path):
    os.makedirs(tmp_path / "in")
    want = {}
    for k in range(7):
        with open(tmp_path / "in" / f"export{k:03d}.json", "w") as f:
            for i in range(0 if k == 3 else 40 + k):  # one shard is empty
                pre, post = (i * k) % 9, i % 5
                f.write(json.dumps({"pre_synaptic_site": {"neuron_id": str(pre)}, "post_synaptic_partner": {"neuron_id": str(post)}}) + "\n" * (1 + i % 2))
                if 0 < pre < 8 and 0 < post < 8:
                    want[pre, post] = want.get((pre, post), 0) + 1
    return str(tmp_path / "in"), want


def counted(spark, out):
    return {(int(r["pre"]), int(r["post"])): r["synapse_count"] for r in shards.extracted_counts(spark, out).collect()}


def reports(spark, out):
    return sorted((r["part"], r["shards"], r["bytes"], r["records"]) for r in shards.extracted_parts(spark, out).collect())


def test_a_stopped_run_goes_on(spark, release, tmp_path):
    folder, want = release
    listed, store, ids = shards.listed_shards(folder), shards.FolderStore(folder), spark.range(1, 8)
    assert shards.extract(spark, listed, store, ids, str(tmp_path / "whole"), per_batch=3)
    assert counted(spark, str(tmp_path / "whole")) == want
    out = str(tmp_path / "stopped")
    assert not shards.extract(spark, listed, store, ids, out, per_batch=3, most_batches=1)

    def stop(upto):
        raise RuntimeError(f"stopped before the report up to {upto}")

    with pytest.raises(Exception):
        shards.extract(spark, listed, store, ids, out, per_batch=3, before_report=stop)
    assert shards.finished(out) == 3 and len(os.listdir(f"{out}/counts")) == 2  # counts without a report don't count
    assert sum(counted(spark, out).values()) < sum(want.values())
    assert shards.extract(spark, listed, store, ids, out, per_batch=3)
    assert counted(spark, out) == want and reports(spark, out) == reports(spark, str(tmp_path / "whole"))
    assert [r[0] for r in reports(spark, out)] == [3, 6, 7] and sum(r[2] for r in reports(spark, out)) == sum(s.n_bytes for s in listed)
    audit = workflows.audit_parts(shards.extracted_parts(spark, out), shards.extracted_counts(spark, out), ids, len(listed))
    assert audit["shards"] == 7 and audit["synapses"] + audit["loop_synapses"] == sum(want.values())


def test_a_short_shard_is_an_error(spark, release, tmp_path):
    folder, _ = release
    listed = shards.listed_shards(folder)
    wrong = [*listed[:2], shards.Shard(2, listed[2].name, listed[2].n_bytes + 1)]
    with pytest.raises(Exception, match="bytes"):
        shards.extract(spark, wrong, shards.FolderStore(folder), spark.range(1, 8), str(tmp_path / "o"), per_batch=3)
    assert shards.finished(str(tmp_path / "o")) == 0
    with pytest.raises(ValueError):
        shards.extract(spark, listed[1:], shards.FolderStore(folder), spark.range(1, 8), str(tmp_path / "p"))


def joined(path):
    return b"".join(open(f"{path}/{m['name']}", "rb").read() for m in members.listed_members(path))


def test_members_are_one_file_whatever_the_partitions(spark, tmp_path):
    rows = [(i * 7919 % 1000, i % 3, 'say "x", y' if i % 100 == 0 else f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    paths = [str(tmp_path / n) for n in ("one", "many")]
    assert members.write_members(df.coalesce(1), paths[0], "a", "b", member_rows=130) == 1000
    assert members.write_members(df.repartition(9), paths[1], "a", "b", member_rows=130) == 1000
    assert joined(paths[0]) == joined(paths[1])
    lines = gzip.decompress(joined(paths[0])).decode().split("\n")
    assert lines[0] == "a,b,t" and len(lines) == 1002 and [m["rows"] for m in members.listed_members(paths[0])] == [0, *[130] * 7, 90]
    assert sorted(os.listdir(paths[0])) == sorted([m["name"] for m in members.listed_members(paths[0])] + [members.LIST])
    back = members.read_members(spark, paths[0], "a long, b long, t string")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(ValueError):
        members.write_members(df, paths[0], "a", "b")
    assert members.write_members(df.where("false"), str(tmp_path / "none"), "a", "b") == 0
    assert gzip.decompress(joined(str(tmp_path / "none"))) == b"a,b,t\n"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "bad")
    good = spark.range(500).select("id", F.col("id").alias("v"))
    writer = members._Writer(path, ["id", "v"])
    import pyarrow as pa

    os.makedirs(path)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 2]), pa.array([1, 2, 3]), pa.array([1, 2, 3])], ["__member", "id", "v"])
    message = writer.write(iter([batch]))
    assert os.listdir(path) == [writer.stage]
    with pytest.raises(RuntimeError):
        writer.commit([message])  # member 1 is missing
    writer.abort([message])
    assert not os.path.exists(f"{path}/{members.LIST}") and os.listdir(path) == []
    assert members.write_members(good, path, "id", member_rows=100) == 500


def test_edge_and_candidate_members(spark, tmp_path):
    from latticebits.operators import graph, tiles

    counts = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (2, 2, 4)], "pre long, post long, synapse_count long")
    assert tables.write_sparse_edge_members(counts, str(tmp_path / "e")) == {"edges": 2, "synapses": 5, "loop_synapses": 4}
    assert gzip.decompress(joined(str(tmp_path / "e"))) == b"pre_id,post_id,synapse_count\n1,2,3\n2,1,2\n"
    nodes = spark.createDataFrame([(i, "t", float(i), 0.0, 0.0) for i in (1, 2, 3)], "id long, type string, x double, y double, z double")
    g = graph.Graph(nodes, tiles.tiled(nodes, counts).pairs())
    assert tables.write_candidate_members(g, str(tmp_path / "c")) == 6
    with pytest.raises(ValueError):
        tables.write_candidate_members(graph.Graph(nodes, g.pairs.limit(5)), str(tmp_path / "d"))
    assert not os.path.exists(tmp_path / "d")
