"""A service's tables as a data source: what it is asked, and what comes back."""

import json
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from latticebits.sources import remote

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no path to this file


class Recorder(remote.FolderService):
    """A folder that writes down every question, one file each, as tasks ask in processes of their own."""

    def read(self, table, version, *, columns, among, limit, split=None):
        import uuid

        with open(f"{self.root}/asked/{uuid.uuid4().hex}", "w") as f:
            json.dump({"columns": columns, "among": among, "limit": limit, "split": split}, f)
        yield from super().read(table, version, columns=columns, among=among, limit=limit, split=split)


@pytest.fixture
def service(tmp_path):
    os.makedirs(tmp_path / "asked")
    rows = [(i, ["a", "b", None][i % 3], i % 7) for i in range(1000)] + [(5, "again", 1), (None, "none", 2)]
    ids, types, sizes = zip(*rows)
    pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "type": pa.array(types), "size": pa.array(sizes, pa.int32())}), tmp_path / "types.parquet", row_group_size=300)
    return Recorder(str(tmp_path))


def asked(service):
    out = []
    for name in os.listdir(f"{service.root}/asked"):
        with open(f"{service.root}/asked/{name}") as f:
            out.append(json.load(f))
        os.remove(f"{service.root}/asked/{name}")
    return out


def test_filters_columns_and_limits_reach_the_service(spark, service):
    table = remote.remote_table(spark, service, "types", 3, columns=["id", "size"])
    assert table.columns == ["id", "size"]
    got = table.where(F.col("size").isin(2, 4) & (F.col("id") > 900)).collect()
    assert sorted(r["id"] for r in got) == [i for i in range(901, 1000) if i % 7 in (2, 4)]
    said = asked(service)
    assert len(said) == 4 and all(sorted(q["among"]["size"]) == [2, 4] and q["columns"] == ["id", "size"] and list(q["among"]) == ["size"] for q in said)
    assert table.where("size = 3").count() == sum(i % 7 == 3 for i in range(1000)) and all(q["among"] == {"size": [3]} for q in asked(service))
    assert remote.remote_table(spark, service, "types", 3, limit=5).count() == 5 and all(q["limit"] == 5 for q in asked(service))
    with pytest.raises(ValueError):
        remote.remote_table(spark, service, "types", 3, columns=["other"])


def test_long_lists_are_asked_in_batches(spark, service):
    wanted = [i for i in range(0, 1500, 2)]
    got = remote.remote_table(spark, service, "types", 3, columns=["id"], batch=100).where(F.col("id").isin(wanted)).collect()
    assert sorted(r["id"] for r in got) == [i for i in wanted if i < 1000]
    said = asked(service)
    assert len(said) == 8 and all(len(q["among"]["id"]) <= 100 and q["split"] is None for q in said)


def test_ids_that_are_rows(spark, service):
    ids = spark.range(0, 2000, 3).select("id").union(spark.range(30).select("id")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got = remote.looked_up(ids, service, "types", 3, "id", columns=["id", "type"], batch=64)
    want = [i for i in range(1000) if i % 3 == 0 or i < 30] + [5]
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert all(len(q["among"]["id"]) <= 64 for q in asked(service))
    assert remote.looked_up(ids.where("false"), service, "types", 3, "id").collect() == [] and asked(service) == []


def test_only_as_many_types_as_needed(spark, service):
    nodes = spark.range(10_000).select("id", (F.col("id") * 2.0).alias("x"))
    got = remote.first_typed(nodes, service, "types", 3, key="id", label="type", max_nodes=40, batch=20)
    # id 5 has two rows; every third type is null, which is unknown
    assert [(r["id"], r["x"]) for r in got.orderBy("id").collect()] == [(i, 2.0 * i) for i in range(42) if i != 5][:40]
    assert sum(len(q["among"]["id"]) for q in asked(service)) < 400
    few = remote.first_typed(nodes.where("id > 990"), service, "types", 3, key="id", label="type", max_nodes=400, batch=20)
    assert few.count() == 9
