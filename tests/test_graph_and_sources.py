import gzip
import hashlib
import io
import json
import pickle
import tarfile

import pytest
from pyspark.sql import functions as F

from latticebits.functions import checks
from latticebits.functions import columns as c
from latticebits.operators import bridge, digest, graph, profile, validate
from latticebits.sources import archive, records, rois, services, tables
from latticebits.streaming import pair_counts as streaming

BIG = 864691135771728459


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- graph


def test_small_graph(spark):
    nodes = graph.strict_nodes(spark.createDataFrame([(30, 3.0, 4.0, 0.0, None), (10, 0.0, 0.0, 0.0, "a"), (20, 3.0, 0.0, 0.0, "b")], "i long, x double, y double, z double, t string"), id="i", type="t", x="x", y="y", z="z")
    events = spark.createDataFrame([(10, 20), (10, 20), (20, 30), (10, 10), (10, 99)], "pre_pt_root_id long, post_pt_root_id long")
    g = graph.build_graph(nodes, graph.clean_events(events))
    got = {(r["source"], r["target"]): r for r in g.pairs.collect()}
    assert len(got) == 6 and got[(10, 20)]["synapse_count"] == 2 and got[(20, 30)]["connected"] == 1 and got[(30, 10)]["synapse_count"] == 0
    assert got[(10, 30)]["distance"] == 5.0 and got[(10, 30)]["target_type"] == "unknown"
    with pytest.raises(ValueError):
        graph.candidate_pairs(nodes, max_pairs=5)
    with pytest.raises(ValueError):
        graph.strict_nodes(nodes.union(nodes), id="id", type="type", x="x", y="y", z="z")
    assert graph.build_graph(nodes, graph.clean_events(events.where("false")), only_with_events=False).pairs.where("connected = 1").isEmpty()
    assert rows(validate.orphan_pairs(graph.pair_counts(graph.clean_events(events)), nodes)) == [(10, 99, 1)]
    assert graph.events_outside(graph.clean_events(events), nodes).count() == 1
    assert validate.violations(nodes, g.pairs).where("violations > 0").isEmpty()
    assert validate.require_valid(nodes, g.pairs)["pairs"] == 6


def test_csv_graph(spark, tmp_path):
    (tmp_path / "n.csv").write_text(f"pt_root_id,cell_type,soma_x_nm,soma_y_nm,soma_z_nm\n{BIG},e,0,0,0\n{BIG + 1}, I ,3,4,0\n7,g,1,1,1\n7,g,1,1,1\nx,e,0,0,0\n8,,nan,0,0\n9,,5,5,5\n11,e,2,2,2\n")
    (tmp_path / "e.csv").write_text(f"pre_root_id,post_root_id\n{BIG},{BIG + 1}\n{BIG},{BIG + 1}\n{BIG + 1},9\n9,9\n9,500\n11,{BIG}\n")
    g = tables.node_event_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert rows(g.nodes.select("id", "type")) == [(9, "unknown"), (11, "excitatory"), (BIG, "excitatory"), (BIG + 1, "inhibitory")]
    assert g.pairs.count() == 12 and g.pairs.agg(F.sum("connected"), F.sum("synapse_count")).first()[:] == (3, 4)
    assert tables.node_event_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"), max_nodes=3).nodes.count() == 3
    with pytest.raises(ValueError):
        checks.endpoint_column(["pre_root_alpha_id", "pre_root_beta_id"], "pre")
    with pytest.raises(ValueError):
        tables.text_csv(spark, str(tmp_path / "n.csv"), ["a"])


def test_eligible_neurons(spark):
    somas = spark.createDataFrame(
        [(30.0, "PYRAMIDAL", 2, 1, 1), (30.0, "ASTROCYTE", 9, 9, 9), (20.0, "interneuron ", 1, 2, 3), (10.0, "PYRAMIDAL", 3, 1, 1), (40.0, "PYRAMIDAL", 5, 1, 1), (40.0, "SPINY_STELLATE", 5, 1, 1), (None, "PYRAMIDAL", 5, 1, 1), (60.0, "GLIA", 5, 1, 1)],
        "c3_rep_manual double, celltype string, x long, y long, z long",
    )
    got = graph.eligible_neurons(somas).orderBy("x_nm", "id").collect()
    assert [(r["id"], r["x_nm"], r["y_nm"], r["z_nm"]) for r in got] == [(20, 8, 16, 99), (30, 16, 8, 33), (10, 24, 8, 33)]
    with pytest.raises(ValueError):
        graph.eligible_neurons(somas.withColumn("c3_rep_manual", F.col("c3_rep_manual") + 0.5))


def test_parsing(spark):
    one = spark.range(1)
    value = lambda x: one.select(x).first()[0]
    assert [value(c.status_true(F.lit(s))) for s in ("t", " TRUE ", "1", "yes", "f", None)] == [True] * 4 + [False] * 2
    assert [value(c.coerced_id(F.lit(s))) for s in (str(BIG), "10.0", "10.5", "x", None)] == [BIG, 10, None, None, None]
    assert [value(c.coerced_double(F.lit(s))) for s in ("1.5", "inf", "nan", "x")] == [1.5, None, None, None]
    ids = spark.createDataFrame([('{"k": 5}',), ('{"k": " 7 "}',), ('{"k": 5.0}',), ('{"k": true}',), ('{"k": null}',), ("{}",), ('{"k": "x"}',), ('{"k": 18446744073709551615}',)], "v string")
    assert [None if r[0] is None else int(r[0]) for r in ids.select(c.json_identity(F.parse_json("v"), "$.k")).collect()] == [5, 7, None, None, None, None, None, 2**64 - 1]
    assert value(c.exact_integer(F.lit("12"))) == 12 and value(c.session_of(F.lit("9-scan-4"))) == (9, 4) and value(c.session_of_path(F.lit("a_ses-9-scan-4_b"))) == (9, 4)
    for bad in (c.exact_integer(F.lit("012")), c.exact_integer(F.lit("1.0")), c.exact_integer(F.lit("0"), 1), c.exact_integer(F.lit(None).cast("string")), c.session_of(F.lit("9-4")), c.session_of_path(F.lit("x"))):
        with pytest.raises(Exception):
            value(bad)
    assert [value(c.source_choice(F.lit(n))) for n in (1, 2 * 1024**3 + 1)] == ["single-file", "shards"]


def test_profile(spark):
    df = spark.createDataFrame([(10, 1.0, "a"), (20, float("nan"), "b"), (20, None, None)], "neuron_id long, x double, t string")
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert got["x"]["finite"] == 1 and got["x"]["nulls"] == 1 and got["t"]["distinct"] == 2
    assert rows(profile.value_counts(df, "t")) == [("<NA>", 1), ("a", 1), ("b", 1)] and profile.label_counts(df, "t", 1) is None
    assert rows(profile.repeated_ids(df, "neuron_id")) == [(1, 2)]
    assert rows(profile.object_summary(spark.createDataFrame([("p/a", "100"), ("p/b", "250"), ("q", "9")], "name string, size string"), "p/")) == [(2, 350, 100, 250)]
    assert checks.column_roles(["soma_x_nm", "cell_type", "neuron_id"]) == {"coordinate": ["soma_x_nm"], "label": ["cell_type"], "id": ["cell_type", "neuron_id"]}


# ---- records and shards


def record(pre, post):
    return json.dumps({"pre_synaptic_site": {"neuron_id": pre}, "post_synaptic_partner": {"neuron_id": post}, "confidence": 0.5})


def test_records(spark, tmp_path):
    lines = [record("1", 2), record(1, 2), record(2, 2), record(None, 2), '{"pre_synaptic_site": {}}', record(1, 9), ""]
    (tmp_path / "a.json").write_text("\n".join(lines))
    text = records.json_lines(spark, str(tmp_path / "a.json"))
    assert text.count() == 6
    ends = records.endpoints_of(text)
    ids = spark.createDataFrame([(1,), (2,)], "id long").select(F.col("id").cast("decimal(20,0)"))
    assert rows(records.diagnostics(ends, ids)) == [(6, 2, 3, 1, 2)]
    assert [(int(a), int(b), n) for a, b, n in rows(records.selected_counts(ends, ids))] == [(1, 2, 2), (2, 2, 1)]
    (tmp_path / "b.json").write_text("[1]\n")
    with pytest.raises(Exception):
        records.json_lines(spark, str(tmp_path / "b.json")).select("record").collect()
    assert records.probe(spark, str(tmp_path / "a.json"))["format"] == "lines"
    (tmp_path / "c.json").write_text("[" + record(1, 2) + "]")
    probe = records.probe(spark, str(tmp_path / "c.json"))
    assert probe["format"] == "array" and probe["schema"]["confidence"] == "number" and "0.5" not in json.dumps(probe)
    (tmp_path / "d.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        records.probe(spark, str(tmp_path / "d.json"))


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([record(1, 2), record(1, 2), record(2, 3)]))
    got = streaming.drain(spark, str(tmp_path / "in"), str(tmp_path / "ck"), "streamed_counts")
    assert [(int(a), int(b), n) for a, b, n in rows(got)] == [(1, 2, 2), (2, 3, 1)]


def test_shards_and_download(tmp_path, spark):
    assert services.shard_name(7) == "export000000000007.json" and len(services.assigned_shards(1, 4)) == 42
    assert sorted(s for p in range(4) for s in services.assigned_shards(p, 4)) == list(range(166))
    tries, slept = [], []

    def fetch():
        tries.append(1)
        return b"abc" if len(tries) == 3 else b"a"

    services.download(fetch, str(tmp_path / "x"), 3, sleep=slept.append)
    assert (tmp_path / "x").read_bytes() == b"abc" and slept == [1.0, 2.0]
    services.download(fetch, str(tmp_path / "x"), 3)
    assert len(tries) == 3
    with pytest.raises(OSError):
        services.download(lambda: b"", str(tmp_path / "y"), 3, sleep=lambda s: None)
    pages = {None: ([{"name": "a", "size": 1}], "t"), "t": ([{"name": "b", "size": 2}], None)}
    assert rows(services.listing(pages.get, spark)) == [("a", "1"), ("b", "2")]
    parts = spark.createDataFrame([([0, 2], 5, 1), ([1], 6, 2)], "shards array<int>, bytes long, records long")
    assert rows(validate.part_audit(parts, 3)) == [(3, True, 11, 3)] and rows(validate.part_audit(parts, 4))[0][1] is False
    with pytest.raises(ValueError):
        validate.require_equal({"a": 1}, {"a": 2})


# ---- pinned files, sinks


def test_counts_and_candidates(spark, tmp_path):
    for k, text in enumerate(("1,2,3\n2,2,4\n", "1,2,1\n3,1,1\n")):
        (tmp_path / f"p{k}.csv").write_text("pre_id,post_id,synapse_count\n" + text)
    counts = tables.read_pair_counts(spark, [str(tmp_path / "p0.csv"), str(tmp_path / "p1.csv")])
    assert rows(counts) == [(1, 2, 4), (2, 2, 4), (3, 1, 1)]
    assert tables.write_sparse_edges(counts, str(tmp_path / "e.gz")) == {"edges": 2, "synapses": 5, "loop_synapses": 4}
    first = (tmp_path / "e.gz").read_bytes()
    tables.write_sparse_edges(counts.repartition(3), str(tmp_path / "e.gz"))
    assert (tmp_path / "e.gz").read_bytes() == first and gzip.decompress(first).decode().splitlines()[1] == "1,2,4"
    tables.write_pair_counts(counts, str(tmp_path / "out"))
    assert rows(tables.read_pair_counts(spark, str(tmp_path / "out"))) == rows(counts)
    (tmp_path / "bad.csv").write_text("pre_id,post_id,synapse_count\n1,2,0\n")
    with pytest.raises(Exception):
        tables.read_pair_counts(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "n.csv").write_text("c3_rep_manual,celltype,x_nm,y_nm,z_nm\n1,A,0,0,0\n2,B,3,4,0\n3,A,0,0,12\n")
    nodes = spark.createDataFrame([(1, "A", 0.0, 0.0, 0.0), (2, "B", 3.0, 4.0, 0.0), (3, "A", 0.0, 0.0, 12.0)], "id long, type string, x double, y double, z double")
    g = graph.Graph(nodes, graph.labelled_pairs(graph.candidate_pairs(nodes), counts.where("pre <> post")))
    assert tables.write_candidates(g, str(tmp_path / "c.csv.gz")) == 6
    pins = {"node_sha256": digest.sha256_file(tmp_path / "n.csv"), "candidate_sha256": digest.sha256_file(tmp_path / "c.csv.gz")}
    totals = {"nodes": 3, "pairs": 6, "connected": 2, "synapses": 5}
    again = tables.pinned_candidates(spark, str(tmp_path / "n.csv"), str(tmp_path / "c.csv.gz"), **pins, totals=totals)
    assert {(r["source"], r["target"]): r["distance"] for r in again.pairs.collect()}[(1, 3)] == 12.0
    with pytest.raises(ValueError):
        tables.pinned_candidates(spark, str(tmp_path / "n.csv"), str(tmp_path / "c.csv.gz"), **pins, totals=totals | {"synapses": 6})
    with pytest.raises(ValueError):
        tables.pinned_candidates(spark, str(tmp_path / "n.csv"), str(tmp_path / "c.csv.gz"), **pins | {"node_sha256": "0"}, totals=totals)
    ids = tables.frozen_ids(spark, str(tmp_path / "n.csv"), "c3_rep_manual", pins["node_sha256"], 3)
    assert ids.count() == 3
    with pytest.raises(ValueError):
        tables.frozen_ids(spark, str(tmp_path / "n.csv"), "c3_rep_manual", pins["node_sha256"], 4)


def test_freeze(spark, tmp_path):
    somas = spark.createDataFrame([(100 + i, "PYRAMIDAL", i, 0, 0) for i in range(10)], "c3_rep_manual long, celltype string, x long, y long, z long")
    report = tables.freeze_nodes(somas, str(tmp_path / "f.csv"), expected_eligible=10, count=4)
    assert report["selected"] == 4 and [line.split(",")[0] for line in (tmp_path / "f.csv").read_text().splitlines()[1:]] == ["103", "104", "105", "106"]
    with pytest.raises(ValueError):
        tables.freeze_nodes(somas, str(tmp_path / "f.csv"), expected_eligible=9, count=4)


def test_sidecar(spark, tmp_path):
    names = tables.sidecar_columns(b"id,bigint\nvalid,boolean\n", {"valid", "id"})
    assert names == ["id", "valid"]
    for bad in (b"id,bigint\n", b"id,a\nid,a\n", b"id,a\nvalid,b\nx,c\n"):
        with pytest.raises(ValueError):
            tables.sidecar_columns(bad, {"valid", "id"})
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(f"{BIG},t\n".encode()))
    assert rows(tables.headerless_csv(spark, str(tmp_path / "d.csv.gz"), names)) == [(str(BIG), "t")]
    (tmp_path / "s.csv.gz").write_bytes(gzip.compress(b"1\n"))
    (tmp_path / "u.csv.gz").write_bytes(gzip.compress(b"1,\xff\n"))
    (tmp_path / "b.csv.gz").write_bytes(b"not gzip")
    for name in ("s", "u", "b"):
        with pytest.raises(Exception):
            tables.headerless_csv(spark, str(tmp_path / f"{name}.csv.gz"), names).collect()


def test_digests(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "i int, s string")
    assert digest.table_digest(df) == digest.table_digest(df.repartition(3)) != digest.table_digest(df.distinct())
    assert digest.table_digest(df) != digest.table_digest(df.fillna(""))
    sha = hashlib.sha1(b"blob 3\0abc").hexdigest()
    assert digest.git_blob_sha1(b"abc") == sha == spark.createDataFrame([(bytearray(b"abc"),)], "c binary").select(digest.git_blob_column(F.col("c"))).first()[0]
    assert digest.id_manifest(spark.createDataFrame([(2,), (1,), (2,)], "x int"))[1] == hashlib.sha256(b"1\n2\n").hexdigest()


# ---- service


@pytest.fixture
def client(spark, tmp_path):
    spark.createDataFrame([(i, i if i != 40 else 99, "t", "true" if i != 50 else "f", "full", float(i), 0.0, 0.0) for i in (10, 20, 30, 40, 50)], "pt_root_id long, valid_id long, status_axon string, status_dendrite string, strategy_axon string, pt_position_x double, pt_position_y double, pt_position_z double").write.parquet(f"{tmp_path}/v3/proofreading_status.parquet")
    spark.createDataFrame([(10, "a"), (20, "b"), (20, "c"), (30, None)], "pt_root_id long, cell_type string").write.parquet(f"{tmp_path}/v3/cell_types.parquet")
    spark.createDataFrame([(10, 30), (10, 20), (30, 30)], "pre_pt_root_id long, post_pt_root_id long").write.parquet(f"{tmp_path}/v3/synapses.parquet")
    return services.ParquetClient(spark, str(tmp_path), (3,), ("proofreading_status", "cell_types", "synapses"))


def test_export(client, spark, tmp_path):
    config = services.ExportConfig(3, strategies=("full",))
    manifest = services.export(client, config, str(tmp_path / "out"))
    assert (manifest["nodes"], manifest["pairs"], manifest["connected"], manifest["synapses"]) == (2, 2, 1, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/out/pairs").where("connected = 1").select("source", "target", "distance")) == [(10, 30, 20.0)]
    spark.read.parquet(f"{tmp_path}/out/pairs").withColumn("distance", F.lit(1.0)).write.parquet(f"{tmp_path}/other")
    import shutil

    shutil.rmtree(tmp_path / "out/pairs")
    shutil.copytree(tmp_path / "other", tmp_path / "out/pairs")
    with pytest.raises(ValueError):
        tables.validate_export(spark, str(tmp_path / "out"))
    g = services.export_graph(client, config)
    tables.save_export(g, str(tmp_path / "odd"), {"strategies": ["clean"]})
    with pytest.raises(ValueError, match="strategy"):
        tables.validate_export(spark, str(tmp_path / "odd"))
    for bad in ({"version": 0}, {"version": 1, "max_nodes": 1}, {"version": 1, "max_pairs": 1}, {"version": 1, "lookup_batch": 0}):
        with pytest.raises(ValueError):
            services.ExportConfig(**bad)


def test_batched_lookup_stops_early(client, spark):
    nodes = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in (10, 20, 30, 40, 50)], "id long, x double, y double, z double")
    asked = []

    def lookup(ids):
        asked.append(ids)
        return client.table("cell_types", 3)

    assert [r["id"] for r in services.batched_types(lookup, nodes, 2, 2).orderBy("id").collect()] == [10, 30] and asked == [[10, 20], [30, 40]]


def test_doctor(client):
    assert services.doctor(client, services.ExportConfig(3))["tables"]["proofreading_status"]["probed"] == 5
    with pytest.raises(ValueError, match="version"):
        services.doctor(client, services.ExportConfig(4))
    with pytest.raises(ValueError, match="missing"):
        services.doctor(client, services.ExportConfig(3, event_table="none"))


def test_cli(client, tmp_path, capsys):
    from latticebits import cli

    assert cli.main(["doctor", str(tmp_path), "--version", "3"]) == 0
    assert cli.main(["export", str(tmp_path), "--version", "3", "--strategy", "full", "--output", str(tmp_path / "o")]) == 0
    assert cli.main(["export", str(tmp_path), "--version", "3", "--output", str(tmp_path / "p")]) == 1  # no node has the strict strategy
    assert cli.main(["validate", str(tmp_path / "o")]) == 0
    assert cli.main(["doctor", str(tmp_path), "--version", "9"]) == 1
    capsys.readouterr()
    assert cli.main(["synthetic-baselines", "--pairs", "3000", "--output", str(tmp_path / "r.json")]) == 0
    assert len(json.loads((tmp_path / "r.json").read_text())) == 4


# ---- bridges


def test_bridge(spark):
    roi = spark.createDataFrame([("a", f"PlaneSegmentation{k}", k, 100 + k, 9, 4, 1) for k in range(1, 7)], rois.SCHEMA)
    units = spark.createDataFrame([(9, 4, 1, 100 + k, k) for k in range(1, 6)], "session int, scan_idx int, field int, mask_id int, unit_id int")
    release = spark.createDataFrame([(1, 9001, 0.0, 0.0, 0.0), (2, 9001, 0.0, 0.0, 0.0), (3, 9002, 0.0, 0.0, 0.0), (3, 9002, 0.0, 0.0, 0.0), (4, 9003, 0.0, 0.0, 0.0), (4, 9004, 0.0, 0.0, 0.0)], "unit_id int, pt_root_id long, x double, y double, z double")
    got, report = bridge.bridge(roi, units, release, "release")
    assert [r["pt_root_id"] for r in got.collect()] == [9002]
    assert report == {"rois": 6, "unmapped_rois": 1, "unmatched": (1, 1), "ambiguous": (1, 1), "duplicate_roots": 1, "duplicate_rows": 2, "cohort": 1}
    clash = units.union(spark.createDataFrame([(9, 4, 1, 101, 77)], units.schema))
    assert bridge.conflicting_keys(clash).count() == 1
    with pytest.raises(Exception):
        bridge.map_rois_to_units(roi, clash).collect()


def test_release_rows(spark):
    text = spark.createDataFrame([("7", "5", "t", "9", "4", "1", "2", "3"), ("8", "0", "f", "1", "1", "1", "2", "3")], "unit_id string, pt_root_id string, valid string, session string, scan_idx string, pt_position_x string, pt_position_y string, pt_position_z string")
    assert rows(bridge.release_rows(text, 9, 4)) == [(7, 5, 1.0, 2.0, 3.0)]
    with pytest.raises(Exception):
        bridge.release_rows(text, 1, 1).collect()


def test_overlap(spark):
    a = archive.id_table(spark, [335, 2, 1])
    b = spark.range(1, 335).select(F.col("id").cast("decimal(20,0)"))
    assert rows(bridge.overlap_counts(a, b)) == [(2, 1, 332)]
    assert bridge.require_distinct_ids(a, "segment_id").count() == 3
    for bad in ([1.5], [1, 1], [0], [True], [[1]], [2**64]):
        with pytest.raises(ValueError):
            archive.positive_ids(bad)


class Spy(list):
    reads = 0

    def __getitem__(self, i):
        Spy.reads += 1
        return super().__getitem__(i)


def tree(session="9-scan-4", planes=None):
    return {"session_id": session, "processing": {"ophys": {"ImageSegmentation": planes or {"PlaneSegmentation2": {"id": [5, 6], "image_mask": Spy([1])}, "PlaneSegmentation1": {"id": [3]}}}}}


def test_rois(spark):
    got = rows(rois.roi_table(spark, {"x.nwb": tree()}))
    assert got == [("x.nwb", "PlaneSegmentation1", 0, 3, 9, 4, 1), ("x.nwb", "PlaneSegmentation2", 0, 5, 9, 4, 2), ("x.nwb", "PlaneSegmentation2", 1, 6, 9, 4, 2)] and Spy.reads == 0
    assert list(rois.roi_rows(tree("bad"), "sub_ses-8-scan-2_x.nwb", session_from_path=True))[0][4:6] == (8, 2)
    for bad in (tree("x"), tree(planes={"Other": {"id": [1]}}), tree(planes={"PlaneSegmentation0": {"id": [1]}}), tree(planes={"PlaneSegmentation1": {"id": [1, 1]}}), tree(planes={"PlaneSegmentation1": {"id": [1.5]}})):
        with pytest.raises(ValueError):
            list(rois.roi_rows(bad, "x"))
    spark.dataSource.register(rois.RoiSource)
    assert spark.read.format("rois").option("paths", "a").load().columns[0] == "asset_path"


# ---- archives


def tar(members, kind=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            if kind:
                info.type = kind
                info.linkname = "x"
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = tar([("doc.pkl", b"1"), ("ids.pkl", b"2")])
    (tmp_path / "a.tar").write_bytes(tar([("z.txt", b"zz"), ("in.tar", inner)]))
    got = archive.inventory(spark, str(tmp_path / "a.tar"))
    assert [r["name"] for r in got.collect()] == ["in.tar", "in.tar::doc.pkl", "in.tar::ids.pkl", "z.txt"]
    kind = lambda d, s: archive.classify(got, d, s).first()["classification"]
    assert (kind(["none.pkl"], ["ids.pkl"]), kind(["doc.pkl"], ["ids.pkl"]), kind(["doc.pkl"], ["no.pkl"])) == ("hard-stop", "identity-source-available", "identity-source-entangled-with-functional-values")
    for bad in (tar([("../x", b"")]), tar([("/x", b"")]), tar([("x", b"")], tarfile.SYMTYPE), tar([("x", b""), ("x", b"")])):
        with pytest.raises(ValueError):
            archive.members(bad)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert archive.extract_member((tmp_path / "a.tar").read_bytes(), [("in.tar", len(inner), sha(inner)), ("ids.pkl", 1, sha(b"2"))]) == b"2"
    with pytest.raises(ValueError):
        archive.extract_member((tmp_path / "a.tar").read_bytes(), [("in.tar", 1, sha(inner))])


def test_pickles(spark):
    import numpy as np
    import pandas as pd

    assert archive.positive_ids(archive.restricted_load(pickle.dumps(np.array([3, 1], dtype=np.uint64)))) == [3, 1]
    with pytest.raises(pickle.UnpicklingError):
        archive.restricted_load(pickle.dumps(pytest.raises))
    data = pickle.dumps(pd.DataFrame({"a": [1]}))
    assert archive.pickled_table(spark, data, size=len(data), git_sha1=digest.git_blob_sha1(data)).count() == 1
    with pytest.raises(ValueError):
        archive.pickled_table(spark, data, size=1, git_sha1="")


def test_npz(spark, tmp_path):
    import numpy as np

    np.savez_compressed(tmp_path / "g.npz", node_ids=[1, 2], coordinates=[[0, 0, 0], [3, 4, 0]], source=[1, 2], target=[2, 1], source_type=["a", "b"], target_type=["b", "a"], distance=[5.0, 5.0], synapse_count=[1, 0], connected=[1, 0])
    g = tables.import_npz(spark, str(tmp_path / "g.npz"))
    assert validate.require_valid(g.nodes, g.pairs)["synapses"] == 1
    np.savez_compressed(tmp_path / "h.npz", node_ids=[1])
    with pytest.raises(ValueError):
        tables.import_npz(spark, str(tmp_path / "h.npz"))
