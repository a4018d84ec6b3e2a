"""Sources, graph building and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.partition import partition_hash
from ..operators.state import reset_state
from ..plans.ordering import dense_ordinal
from ..plans.storage import new_path
from ..sources import io
from .common import (DAY, MID, PARTS, both_ways, event_edges, node_vectors, order_edges, query, sql_hash,
                     table, vectors, whole)

ROLL = "CASE WHEN ord * 100 < n * 70 THEN 0 WHEN ord * 100 < n * 85 THEN 1 ELSE 2 END"


def _rolled(spark, sf):
    """Events with ext_roll 0/1/2 at 70/85/100 % of their order."""
    ordered = dense_ordinal(event_edges(spark, sf), ["eid"])
    return ordered.withColumn("n", F.lit(ordered.count())).withColumn("ext_roll", F.expr(ROLL)).drop("n")


@query(f"SELECT src, dst, ts, eid, {ROLL} AS ext_roll FROM ev_ord, (SELECT count(*) AS n FROM ev)")
def read_edge_file(spark, sf):
    path = new_path(spark, "edge-file")
    (_rolled(spark, sf).select(F.col("eid").alias("Unnamed: 0"), "src", "dst", F.col("ts").alias("time"), "ext_roll")
     .write.option("header", True).csv(path))
    return io.read_edges(spark, path, time_type="bigint").select("src", "dst", "ts", "eid", "ext_roll")


@query(f"""SELECT eid, CASE {ROLL} WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
    FROM ev_ord, (SELECT count(*) AS n FROM ev)""")
def split_by_roll(spark, sf):
    parts = io.split_by_roll(_rolled(spark, sf))
    out = None
    for name, part in parts.items():
        part = part.select("eid", F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT eid, CASE WHEN ord < 4000 THEN 0 ELSE 1 + (ord - 4000) // 700 END AS chunk FROM ev_ord")
def edge_chunks(spark, sf):
    return io.edge_chunks(event_edges(spark, sf), 4000, 700).select("eid", "chunk")


@query(f"""SELECT eid, CASE {ROLL} WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
    ord % 2 AS rank FROM ev_ord, (SELECT count(*) AS n FROM ev)""")
def read_edge_shard(spark, sf):
    path = new_path(spark, "shards")
    names = F.array(*[F.lit(s) for s in io.SPLITS])
    rolled = _rolled(spark, sf).drop("ord").withColumn("split", F.get(names, F.col("ext_roll")))
    io.write_edge_shards(rolled, path, 2)
    out = None
    for split in io.SPLITS:
        for rank in range(2):
            part = io.read_edge_shard(spark, path, rank, split).select(
                "eid", F.lit(split).alias("split"), F.lit(rank).cast("bigint").alias("rank"))
            out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT vec_id AS id, i - 1 AS dim, round(CAST(embedding[i] AS DOUBLE), 6) AS value
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")
def read_features(spark, sf):
    path = new_path(spark, "features")
    vectors(spark, sf).withColumn("feat", F.transform("feat", lambda x: x.cast("double"))).write.parquet(path)
    nodes, _ = io.read_features(spark, node=path)
    return nodes.select("id", F.posexplode("feat").alias("dim", "v")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query(f"SELECT src, dst, ts, eid, {sql_hash('src')} % {PARTS} AS pid FROM ev")
def write_partitioned_edges(spark, sf):
    path = new_path(spark, "by-partition")
    edges = event_edges(spark, sf)
    io.write_partitioned_edges(edges, partition_hash(edges, PARTS), path)
    return spark.read.parquet(path).select("src", "dst", "ts", "eid", F.col("pid").cast("bigint").alias("pid"))


@query(f"SELECT node, {sql_hash('node')} % {PARTS} AS pid FROM (SELECT DISTINCT src AS node FROM ev)")
def read_partition_table(spark, sf):
    path = new_path(spark, "ptable")
    partition_hash(event_edges(spark, sf), PARTS).write.parquet(path)
    return io.read_partition_table(spark, path).select("node", F.col("pid").cast("bigint").alias("pid"))


@query("""SELECT id AS node, array_to_string([CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) FOR x IN feat], ',') AS mem, 7 AS mem_ts,
    array_to_string([CAST(round(CAST(x AS DOUBLE) * -1000000) AS BIGINT) FOR x IN feat], ',') AS mail, 9 AS mail_ts FROM nv""")
def snapshot_and_restore_state(spark, sf):
    """Whole memories and mails, over a later state that is not restored."""
    path = new_path(spark, "state")
    wide = node_vectors(spark, sf).select(F.col("id").alias("node"), F.transform("feat", lambda x: x.cast("double")).alias("mem"))
    state = wide.withColumns({"mem_ts": F.lit(7).cast("bigint"), "mail": F.transform("mem", lambda x: -x), "mail_ts": F.lit(9).cast("bigint")})
    io.snapshot_state(state, path, 1)
    io.snapshot_state(reset_state(state), path, 2)
    back = io.restore_state(spark, path, 1)
    return back.select("node", whole("mem").alias("mem"), "mem_ts", whole("mail").alias("mail"), "mail_ts")


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY ts, src, dst) - 1 AS new_eid FROM ev WHERE ts < {MID}),
    b AS (SELECT *, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY ts, src, dst) - 1 AS new_eid FROM ev
          WHERE ts >= {MID})
    SELECT src, dst, ts, new_eid AS eid FROM a UNION ALL SELECT src, dst, ts, new_eid FROM b""")
def append_edges(spark, sf):
    """Two batches without edge ids: numbering continues."""
    raw = event_edges(spark, sf).select("src", "dst", "ts")
    graph = G.append_edges(None, raw.filter(F.col("ts") < MID))
    return G.append_edges(graph, raw.filter(F.col("ts") >= MID)).select("src", "dst", "ts", "eid")


@query("SELECT src, dst, ts, eid FROM oe")
def assign_edge_ids(spark, sf):
    return order_edges(spark, sf).select("src", "dst", "ts", "eid")


@query("SELECT src, dst, ts, eid, seq FROM rv")
def add_reverse(spark, sf):
    return both_ways(spark, sf)


@query("SELECT src, dst, ts, eid FROM rv")
def temporal_sort(spark, sf):
    path = new_path(spark, "graph")
    G.write_graph(both_ways(spark, sf), path)
    return spark.read.parquet(path).select("src", "dst", "ts", "eid")


@query("""SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY ts DESC, seq DESC) - 1 AS slot,
    dst, ts, eid FROM rv""")
def temporal_neighbors(spark, sf):
    edges = both_ways(spark, sf)
    return G.temporal_neighbors(edges, G.nodes(edges))


@query("""SELECT c_custkey AS node, count(eid) AS degree FROM customer LEFT JOIN oe ON c_custkey = src
    GROUP BY c_custkey""")
def out_degree(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return G.out_degree(order_edges(spark, sf), customers)


@query("""SELECT 'num_vertices' AS metric, (SELECT count(*) FROM (SELECT src FROM rv UNION SELECT dst FROM rv)) AS value
    UNION ALL SELECT 'num_source_vertices', (SELECT count(DISTINCT src) FROM rv)
    UNION ALL SELECT 'num_edges', (SELECT count(DISTINCT eid) FROM rv)
    UNION ALL SELECT 'max_vertex_id', (SELECT max(greatest(src, dst)) FROM rv)""")
def graph_counts(spark, sf):
    return G.graph_counts(both_ways(spark, sf))


@query("SELECT src AS node FROM ev UNION SELECT dst FROM ev")
def nodes(spark, sf):
    return G.nodes(event_edges(spark, sf))


@query("SELECT DISTINCT src AS node FROM oe")
def src_nodes(spark, sf):
    return G.src_nodes(order_edges(spark, sf))


@query("SELECT DISTINCT eid FROM rv")
def edge_ids(spark, sf):
    return G.edge_ids(both_ways(spark, sf))


@query(f"SELECT src, dst, ts, eid FROM rv WHERE ts >= {MID}")
def retain_since(spark, sf):
    return G.retain_since(both_ways(spark, sf), MID).select("src", "dst", "ts", "eid")


@query("SELECT src, dst, ts, eid, seq FROM ev")
def archive_and_restore(spark, sf):
    path = new_path(spark, "archive")
    kept = G.archive_before(event_edges(spark, sf), MID, path)
    return G.restore_archive(kept, path)


@query(f"SELECT src, dst, ts, eid, seq FROM ev WHERE ts >= {MID - 3 * DAY}")
def restore_recent_archive(spark, sf):
    path = new_path(spark, "archive")
    kept = G.archive_before(event_edges(spark, sf), MID, path)
    return G.restore_archive(kept, path, since=MID - 3 * DAY)


@query("""WITH c AS (SELECT *, CASE WHEN ord < 4000 THEN 0 ELSE 1 + (ord - 4000) // 700 END AS chunk FROM ev_ord)
    SELECT chunk, count(*) AS num_edges, (SELECT count(*) FROM (SELECT src FROM c d WHERE d.chunk = c.chunk
      UNION SELECT dst FROM c d WHERE d.chunk = c.chunk)) AS num_nodes FROM c GROUP BY chunk""")
def edges_per_batch_stats(spark, sf):
    return G.edges_per_batch_stats(io.edge_chunks(event_edges(spark, sf), 4000, 700))
