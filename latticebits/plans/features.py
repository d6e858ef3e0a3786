"""More registered queries: cleaning, keys, bridges and sources over whole test tables, with their oracle SQL."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from latticebits.functions import columns as c
from latticebits.operators import bridge, degree, distortion, graph, models, nested_cv, profile, ranking, splits
from latticebits.plans import binding as b
from latticebits.plans.binding import table
from latticebits.plans.catalogue import EDGES, query, rounded
from latticebits.sources import archive, members, remote, tables
from latticebits.streaming import shards

# ---- cleaning and keys


@query("SELECT pre, post, count(*) AS n FROM (SELECT l_orderkey AS pre, CASE WHEN l_linenumber % 5 > 0 THEN l_partkey END AS post FROM lineitem) WHERE pre > 0 AND post > 0 AND pre <> post GROUP BY ALL", bound=False)
def clean_event_counts(spark, d):
    """Endpoint columns by their names, ids as text, bad ones dropped."""
    bad = F.when(F.col("l_linenumber") % 5 > 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).otherwise("none")
    events = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("pre_pt_root_id"), bad.alias("post_pt_root_id"), "l_tax")
    return graph.clean_events(events).groupBy("pre", "post").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey > 2 THEN c_mktsegment END, 'unknown') AS type FROM customer", bound=False)
def known_types(spark, d):
    return table(spark, d, "customer").select("c_custkey", c.known_type(F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment"))).alias("type"))


@query(f"SELECT vec_id, {', '.join(f'round(CAST(embedding[{k + 1}] AS DOUBLE) * {v!r}, 6) AS {a}' for k, (a, v) in enumerate(zip('xyz', c.VOXEL_NM)))} FROM embeddings", bound=False)
def voxel_places(spark, d):
    places = [F.round(c.voxel_nm(F.col("embedding")[k].cast("double"), k), 6).alias(a) for k, a in enumerate("xyz")]
    return table(spark, d, "embeddings").select("vec_id", *places)


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS session, CAST(l_partkey % 9 AS INTEGER) AS scan, CAST(l_suppkey % 40 AS INTEGER) AS path_session FROM lineitem", bound=False)
def session_ids(spark, d):
    name = F.concat(F.col("l_linenumber").cast("string"), F.lit("-scan-"), (F.col("l_partkey") % 9).cast("string"))
    path = F.concat(F.lit("sub-1/sub-1_ses-"), (F.col("l_suppkey") % 40).cast("string"), F.lit("-scan-"), (F.col("l_partkey") % 9).cast("string"), F.lit("_image.nwb"))
    own, there = c.session_of(name), c.session_of_path(path)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", own["session"].alias("session"), there["scan_idx"].alias("scan"), there["session"].alias("path_session"))


@query("SELECT o_orderkey + 1 AS id, o_custkey AS whole FROM orders", bound=False)
def exact_ids(spark, d):
    rows = bridge.require_distinct_ids(table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("id"), "o_custkey"), "id")
    return rows.select(F.col("id").cast("bigint").alias("id"), c.exact_integer(F.col("o_custkey").cast("string"), 0, "o_custkey").alias("whole"))


@query("SELECT o_orderkey, CASE WHEN n > 0 AND n <= 2147483648 THEN 'single-file' ELSE 'shards' END AS source FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 5000000 END AS n FROM orders)", bound=False)
def source_choices(spark, d):
    size = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey") * 5_000_000)
    return table(spark, d, "orders").select("o_orderkey", c.source_choice(size).alias("source"))


@query("SELECT count(*) AS repeated_ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)", bound=False)
def repeated_ids(spark, d):
    return profile.repeated_ids(table(spark, d, "lineitem"), "l_partkey")


_TYPES = "SELECT c_custkey AS pt_root_id, c_mktsegment AS cell_type FROM customer UNION ALL SELECT c_custkey, 'again' FROM customer WHERE c_custkey % 7 = 0"


@query(f"SELECT s_suppkey AS id, any_value(cell_type) AS type FROM supplier JOIN ({_TYPES}) ON s_suppkey = pt_root_id GROUP BY s_suppkey HAVING count(*) = 1", bound=False)
def typed_nodes(spark, d):
    """Nodes with the type of ids that have one row, one to one."""
    types = spark.sql(_TYPES.replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))
    return graph.typed_nodes(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), types).select("id", "type")


_SOMAS = "SELECT CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE c_custkey END AS c3_rep_manual, CASE c_nationkey % 4 WHEN 0 THEN 'pyramidal' WHEN 1 THEN ' Interneuron ' WHEN 2 THEN 'glia' END AS celltype, c_custkey * 2 AS x, c_nationkey AS y, c_custkey % 100 AS z FROM customer"
_NEURONS = ", ".join(f"'{x}'" for x in c.NEURON_LABELS)


@query(
    f"""SELECT c3_rep_manual AS id, upper(trim(celltype)) AS type, CAST(x * {c.VOXEL_NM[0]!r} AS BIGINT) AS x_nm FROM
        (SELECT *, count(*) OVER (PARTITION BY c3_rep_manual) AS n FROM ({_SOMAS}) WHERE upper(trim(celltype)) IN ({_NEURONS})) WHERE n = 1""",
    bound=False,
)
def eligible_neurons(spark, d):
    return graph.eligible_neurons(spark.sql(_SOMAS.replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))).select("id", "type", "x_nm")


# ---- bridges and comparisons


@query("SELECT l_orderkey AS unit_id, l_partkey + 1 AS pt_root_id, l_quantity * 1.0 AS x FROM lineitem WHERE l_linenumber = 3 AND l_suppkey % 5 = 2", bound=False)
def scan_release_rows(spark, d):
    """The release rows of one scan, from text columns."""
    text = lambda e, n: F.expr(e).cast("string").alias(n)
    release = table(spark, d, "lineitem").select(text("l_orderkey", "unit_id"), text("l_partkey + 1", "pt_root_id"), F.lit(" T ").alias("valid"), text("l_linenumber", "session"), text("l_suppkey % 5", "scan_idx"), *[text("l_quantity", f"pt_position_{a}") for a in "xyz"])
    return bridge.release_rows(release, 3, 2).select("unit_id", "pt_root_id", "x")


_FOLDS = "SELECT outer_slab, family, a, a + CASE WHEN outer_slab > 4 THEN 0.5 ELSE 0.05 END AS b FROM (SELECT l_linenumber AS outer_slab, l_returnflag AS family, sum(l_quantity) AS a FROM lineitem GROUP BY ALL)"


@query(f"SELECT outer_slab, family, round(abs(a - b), 6) AS difference_bits, abs(a - b) <= 0.1 AS equal FROM ({_FOLDS})", bound=False)
def solver_gaps(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("outer_slab"), F.col("l_returnflag").alias("family")).agg(F.sum("l_quantity").alias("residual_bits"))
    other = rows.withColumn("residual_bits", F.col("residual_bits") + F.when(F.col("outer_slab") > 4, 0.5).otherwise(0.05))
    return rounded(nested_cv.equivalence_rows(rows, other).select("outer_slab", "family", "difference_bits", "equal"), "difference_bits")


@query(
    """SELECT CASE WHEN count(DISTINCT CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN p END) < 2 THEN 'hard-stop' WHEN count(*) FILTER (WHERE p = '5-LOW') > 0 THEN 'identity-source-available' ELSE 'identity-source-entangled-with-functional-values' END AS classification
       FROM (SELECT trim(o_orderpriority) AS p FROM orders)""",
    bound=False,
)
def archive_class(spark, d):
    """Members named after order priorities: which documented ones are there, and a separate one."""
    rows = table(spark, d, "orders").select(F.concat(F.lit("outer.tar::part/"), F.trim("o_orderpriority")).alias("name"), F.lit("file").alias("kind"))
    return archive.classify(rows, ["1-URGENT", "2-HIGH"], ["5-LOW"]).select("classification")


# ---- pairs


@query(f", tr AS (SELECT * FROM pairs), e AS (SELECT {EDGES} AS edges) SELECT CAST(len(list_filter(edges, lambda x: x <= distance)) AS INTEGER) AS bin, count(*) AS pairs, CAST(sum(connected) AS BIGINT) AS edges_there FROM pairs, e GROUP BY 1")
def distance_bins(spark, d):
    """Pairs and edges of every distance bin, counted in the tiles."""
    every = frozenset([0])  # nodes without slabs are all in slab 0
    with b.tiles(spark, d).kept() as kept:
        counts = ranking.checkpointed(kept.binned(models.tile_edges(kept, 12)[1:-1], every, frozenset()))
    return counts.groupBy("bin").agg(F.sum("n").alias("pairs"), F.sum("k").alias("edges_there"))


@query(
    """, te AS (SELECT * FROM sp WHERE s_slab = 4 AND t_slab = 4), o AS (SELECT source AS id, sum(connected) AS d FROM te GROUP BY source), i AS (SELECT target AS id, sum(connected) AS d FROM te GROUP BY target)
    SELECT CAST((o.d + 0.5) * (i.d + 0.5) AS DOUBLE) AS w, count(*) AS n, CAST(sum(connected) AS BIGINT) AS k FROM te JOIN o ON te.source = o.id JOIN i ON te.target = i.id GROUP BY 1"""
)
def degree_weights(spark, d):
    """The degree codec's histogram of one slab, from its edges alone."""
    return degree.node_weights(splits.slabs(b.nodes(spark, d)).where("slab = 4"), b.counts(spark, d)).select(F.col("w").cast("double").alias("w"), "n", "k")


@query("SELECT source, target, row_number() OVER (ORDER BY synapse_count DESC, source, target) AS retention_rank FROM pairs WHERE connected = 1")
def retention_ranks(spark, d):
    p = b.positives(spark, d).withColumn("p", 1.0 / (1.0 + F.col("synapse_count")))
    return distortion.ranked_edges(p, "residual-first").select("source", "target", "retention_rank")


# ---- sources


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", bound=False)
def typed_gzip_scan(spark, d):
    path = b.folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.option("compression", "gzip").csv(path, header=True)
    return tables.typed_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double")


@query("SELECT o_orderstatus, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1", bound=False)
def remote_scan(spark, d):
    """A service's table: the columns and the listed values are asked of the service, splits are partitions."""
    orders = remote.remote_table(spark, remote.FolderService(d), "orders", 1, columns=["o_orderstatus", "o_custkey"])
    return orders.where(F.col("o_orderstatus").isin("F", "O", "P")).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("custkeys"))


@query("SELECT pre AS pre_id, post AS post_id, synapse_count FROM cnt")
def edge_members_scan(spark, d):
    """The sorted edges as gzip members, written by a transaction, read back."""
    path = b.folder(spark)
    tables.write_sparse_edge_members(b.counts(spark, d), path)
    return members.read_members(spark, path, "pre_id bigint, post_id bigint, synapse_count bigint")


#: Events of a shard: more events are more shards, and a batch takes as many as there are cores.
SHARD_EVENTS = 200_000


@query("SELECT pre, post, count(*) AS synapse_count FROM (SELECT user_id AS pre, CAST(json_extract_string(props, '$.k') AS BIGINT) AS post FROM events) WHERE pre <= 1000 AND post <= 1000 AND pre > 0 AND post > 0 GROUP BY ALL", bound=False)
def shard_stream_counts(spark, d):
    """Events as JSON shards, extracted as a stream of shards, in two calls of which the first stops early."""
    root, e = b.folder(spark), table(spark, d, "events")
    post = c.json_identity(F.try_parse_json("props"), "$.k").cast("bigint")
    line = F.to_json(F.struct(F.struct(F.col("user_id").alias("neuron_id")).alias("pre_synaptic_site"), F.struct(post.alias("neuron_id")).alias("post_synaptic_partner")))
    n = max(5, ceil(e.count() / SHARD_EVENTS))
    per_batch = max(2, min(n // 2, 2 * spark.sparkContext.defaultParallelism))
    e.select(line).repartition(n).write.text(f"{root}/shards")
    listed, store, ids = shards.listed_shards(f"{root}/shards"), shards.FolderStore(f"{root}/shards"), spark.range(1, 1001)
    shards.extract(spark, listed, store, ids, f"{root}/out", per_batch=per_batch, most_batches=1)
    shards.extract(spark, listed, store, ids, f"{root}/out", per_batch=per_batch)
    counts = shards.extracted_counts(spark, f"{root}/out")
    return counts.select(F.col("pre").cast("bigint").alias("pre"), F.col("post").cast("bigint").alias("post"), "synapse_count")
