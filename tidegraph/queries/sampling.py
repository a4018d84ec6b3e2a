"""Temporal neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import sampling as S
from ..plans.ordering import dense_ordinal
from ..plans.storage import freeze, new_path
from ..sources import io, ranked
from .common import (DAY, PARTS, SEED, both_ways, end_roots, event_edges, event_roots, item_ptable, order_edges,
                     query, sql_hash)

K = 10
OUT = ["rid", "slot", "root_node", "root_ts", "src_node", "eid", "edge_ts", "dt"]
SNAP = ["snapshot", *OUT]


def recent_sql(edges: str, roots: str, k: int = K, window: int | None = None, out_ts: str | None = None,
               where: str = "e.ts < r.ts") -> str:
    low = f"e.ts >= r.ts - {window}" if window else "e.ts >= 0"
    extra = f", {out_ts} AS out_ts" if out_ts else ""
    return f"""SELECT rid, slot, root_node, root_ts, src_node, eid, edge_ts, dt{', out_ts' if out_ts else ''} FROM (
        SELECT r.rid, row_number() OVER (PARTITION BY r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS slot,
        r.node AS root_node, r.ts AS root_ts, e.dst AS src_node, e.eid, e.ts AS edge_ts, r.ts - e.ts AS dt{extra}
        FROM {roots} r JOIN {edges} e ON e.src = r.node AND {where} AND {low}) WHERE slot < {k}"""


def snapshots_sql(edges: str, roots: str, k: int, count: int, window: int) -> str:
    return f"""SELECT snapshot, rid, slot, root_node, root_ts, src_node, eid, edge_ts, dt FROM (
        SELECT s.snapshot, r.rid, r.node AS root_node, r.ts AS root_ts, e.dst AS src_node, e.eid, e.ts AS edge_ts,
        r.ts - e.ts AS dt, row_number() OVER (PARTITION BY s.snapshot, r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS slot
        FROM {roots} r CROSS JOIN (SELECT unnest(range(0, {count})) AS snapshot) s JOIN {edges} e ON e.src = r.node
        AND e.ts < r.ts - ({count - 1} - s.snapshot) * {window}
        AND e.ts >= r.ts - ({count - 1} - s.snapshot) * {window} - {window}) WHERE slot < {k}"""


def uniform_sql(edges: str, roots: str, k: int, window: int | None, seed: int, hop: int = 0) -> str:
    low = f"e.ts >= r.ts - {window}" if window else "e.ts >= 0"
    return f"""WITH cand AS (SELECT r.rid, r.node, r.ts AS root_ts, e.dst, e.eid, e.ts,
        row_number() OVER (PARTITION BY r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS back,
        count(*) OVER (PARTITION BY r.rid) AS n
        FROM {roots} r JOIN {edges} e ON e.src = r.node AND e.ts < r.ts AND {low})
        SELECT rid, slot, node AS root_node, root_ts, dst AS src_node, eid, ts AS edge_ts, root_ts - ts AS dt
        FROM cand CROSS JOIN (SELECT unnest(range(0, {k})) AS slot) s
        WHERE back = {sql_hash(str(seed), str(hop), '0', 'rid', 'slot')} % n"""


@query(f"""SELECT rid, node, ts, snapshot, ts - (2 - snapshot) * {DAY} - {DAY} AS start, ts - (2 - snapshot) * {DAY} AS "end"
    FROM roots CROSS JOIN (SELECT unnest(range(0, 3)) AS snapshot)""")
def window_bounds(spark, sf):
    return S.window_bounds(event_roots(spark, sf), 3, DAY).withColumn("snapshot", F.col("snapshot").cast("bigint"))


def _long(df, columns=OUT):
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in columns])


@query(recent_sql("ev", "roots"))
def sample_recent(spark, sf):
    """For every event, the user's last 10 earlier items with elapsed time."""
    return _long(S.sample_recent(event_edges(spark, sf), event_roots(spark, sf), K))


@query(recent_sql("rv", "end_roots"))
def sample_recent_both_ways(spark, sf):
    return _long(S.sample_recent(both_ways(spark, sf), end_roots(spark, sf), K))


@query(recent_sql("ev", "roots"))
def sample_recent_hot_safe(spark, sf):
    """The plan for sources too large for one task, on the same data."""
    return _long(S.sample_recent(event_edges(spark, sf), event_roots(spark, sf), K, strategy="ranged"))


@query(recent_sql("rv", "end_roots", window=DAY))
def sample_recent_in_window(spark, sf):
    return _long(S.sample_recent(both_ways(spark, sf), end_roots(spark, sf), K, window=DAY))


@query(recent_sql("ev", "roots", 50))
def sample_recent_large_fanout(spark, sf):
    """Fanouts too large for lag columns are fetched by rank."""
    return _long(S.sample_recent(event_edges(spark, sf), event_roots(spark, sf), 50))


@query("WITH oes AS (SELECT *, eid AS seq FROM oe), o_roots AS (SELECT eid AS rid, src AS node, ts FROM oe) "
       + recent_sql("oes", "o_roots"))
def sample_recent_with_ties(spark, sf):
    """Day-grained order lines: many equal times."""
    edges = order_edges(spark, sf)
    roots = edges.select(F.col("eid").alias("rid"), F.col("src").alias("node"), "ts")
    return _long(S.sample_recent(edges, roots, K))


@query(uniform_sql("rv", "end_roots", K, None, SEED))
def sample_uniform(spark, sf):
    return _long(S.sample_uniform(S.rank_edges(both_ways(spark, sf)), end_roots(spark, sf), K, seed=SEED))


@query(uniform_sql("rv", "end_roots", K, 2 * DAY, SEED))
def sample_uniform_in_window(spark, sf):
    ranked = S.rank_edges(both_ways(spark, sf), window=2 * DAY)
    return _long(S.sample_uniform(ranked, end_roots(spark, sf), K, window=2 * DAY, seed=SEED))


@query(snapshots_sql("rv", "end_roots", 5, 3, DAY))
def sample_snapshots(spark, sf):
    return _long(S.sample_recent(both_ways(spark, sf), end_roots(spark, sf), 5, DAY, 3), SNAP)


HOP_OUT = ["hop", "rid", "slot", "root_node", "src_node", "eid", "out_ts", "dt"]


def hops_sql(first: str, second: str, k: int, out: str) -> str:
    """All rows of two hops; the second asks for the roots again and for what the first found."""
    rows = "rid, slot, root_node, src_node, eid, {out} AS out_ts, dt"
    return f"""WITH hop0 AS ({first}), span AS (SELECT max(rid) + 1 AS s FROM end_roots),
    front AS (SELECT rid, node, ts FROM end_roots UNION ALL
      SELECT s + rid * {k} + slot, src_node, {out} FROM hop0, span), hop1 AS ({second})
    SELECT 0 AS hop, {rows.format(out=out)} FROM hop0 UNION ALL SELECT 1, {rows.format(out=out)} FROM hop1"""


def _all_hops(layers, columns=HOP_OUT):
    out = None
    for layer in layers:
        out = layer if out is None else out.unionByName(layer)
    return _long(out, columns)


@query(hops_sql(recent_sql("rv", "end_roots", 5), recent_sql("rv", "front", 5), 5, "edge_ts"))
def sample_multi_hop(spark, sf):
    return _all_hops(S.sample_multi_hop(both_ways(spark, sf), end_roots(spark, sf), [5, 5]))


@query(hops_sql(recent_sql("rv", "end_roots", 5), recent_sql("rv", "front", 5), 5, "root_ts"))
def sample_with_root_time(spark, sf):
    """Sampled nodes are asked again at the root's time instead of the edge's."""
    return _all_hops(S.sample_multi_hop(both_ways(spark, sf), end_roots(spark, sf), [5, 5], prop_time=True))


@query(hops_sql(uniform_sql("rv", "end_roots", 3, None, SEED), uniform_sql("rv", "front", 3, None, SEED, 1), 3, "edge_ts"))
def sample_multi_hop_uniform(spark, sf):
    return _all_hops(S.sample_multi_hop(both_ways(spark, sf), end_roots(spark, sf), [3, 3], "uniform", seed=SEED))


def snapshot_hops_sql(how, k: int, count: int, window: int, out: str) -> str:
    """Two hops in snapshots: every snapshot's second hop starts from its own first one."""
    fronts = [f"""f{s} AS (SELECT rid, node, ts FROM end_roots UNION ALL
        SELECT s + rid * {k} + slot, src_node, {out} FROM s0, span WHERE snapshot = {s})""" for s in range(count)]
    later = [f"h{s} AS (SELECT * FROM ({how('rv', f'f{s}', k, count, window, 1)}) WHERE snapshot = {s})" for s in range(count)]
    rows = f"snapshot, rid, slot, root_node, src_node, eid, {out} AS out_ts, dt"
    union = " UNION ALL ".join(f"SELECT 1 AS hop, {rows} FROM h{s}" for s in range(count))
    return f"""WITH s0 AS ({how('rv', 'end_roots', k, count, window, 0)}), span AS (SELECT max(rid) + 1 AS s FROM end_roots),
        {', '.join([*fronts, *later])} SELECT 0 AS hop, {rows} FROM s0 UNION ALL {union}"""


def recent_in_snapshots(edges, roots, k, count, window, hop):
    return snapshots_sql(edges, roots, k, count, window)


def uniform_in_snapshots(edges: str, roots: str, k: int, count: int, window: int, hop: int) -> str:
    return f"""SELECT c.snapshot, rid, slot, node AS root_node, root_ts, dst AS src_node, eid, ts AS edge_ts, root_ts - ts AS dt
        FROM (SELECT s.snapshot, r.rid, r.node, r.ts AS root_ts, e.dst, e.eid, e.ts,
            row_number() OVER (PARTITION BY s.snapshot, r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS back,
            count(*) OVER (PARTITION BY s.snapshot, r.rid) AS n
            FROM {roots} r CROSS JOIN (SELECT unnest(range(0, {count})) AS snapshot) s JOIN {edges} e ON e.src = r.node
            AND e.ts < r.ts - ({count - 1} - s.snapshot) * {window}
            AND e.ts >= r.ts - ({count - 1} - s.snapshot) * {window} - {window}) c
        CROSS JOIN (SELECT unnest(range(0, {k})) AS slot) s
        WHERE back = {sql_hash(str(SEED), str(hop), 'c.snapshot', 'rid', 'slot')} % n"""


SNAP_HOPS = ["hop", "snapshot", *HOP_OUT[1:]]


@query(snapshot_hops_sql(recent_in_snapshots, 3, 2, DAY, "edge_ts"))
def sample_multi_hop_snapshots(spark, sf):
    return _all_hops(S.sample_multi_hop(both_ways(spark, sf), end_roots(spark, sf), [3, 3], snapshots=2, window=DAY), SNAP_HOPS)


@query(snapshot_hops_sql(uniform_in_snapshots, 3, 3, DAY // 4, "root_ts"))
def sample_uniform_snapshots_root_time(spark, sf):
    """Two uniform hops in three snapshots; sampled nodes are asked at the root's time."""
    return _all_hops(S.sample_multi_hop(both_ways(spark, sf), end_roots(spark, sf), [3, 3], "uniform", 3, DAY // 4, SEED,
                                        prop_time=True), SNAP_HOPS)


@query("SELECT * FROM (" + snapshots_sql("rv", "end_roots", 5, 3, DAY) + ") WHERE snapshot = 1")
def sample_layer(spark, sf):
    return _long(S.sample_layer(both_ways(spark, sf), end_roots(spark, sf), 5, "recent", 0, 1, 3, DAY), SNAP)


@query("""SELECT rid, slot, src_node, eid FROM (SELECT r.rid, e.dst AS src_node, e.eid,
    row_number() OVER (PARTITION BY r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS slot
    FROM (SELECT DISTINCT src AS rid, src AS node FROM rv) r JOIN rv e ON e.src = r.node) WHERE slot < 10""")
def sample_static(spark, sf):
    edges = both_ways(spark, sf)
    roots = edges.select(F.col("src").alias("rid"), F.col("src").alias("node")).distinct().withColumn(
        "ts", F.lit(0).cast("bigint"))
    return _long(S.sample_static(edges, roots, K), ["rid", "slot", "src_node", "eid"])


@query(f"""WITH cand AS (SELECT r.rid, e.dst AS src_node, e.eid,
      row_number() OVER (PARTITION BY r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS back, count(*) OVER (PARTITION BY r.rid) AS n
      FROM (SELECT DISTINCT src AS rid, src AS node FROM rv) r JOIN rv e ON e.src = r.node)
    SELECT rid, slot, src_node, eid FROM cand CROSS JOIN (SELECT unnest(range(0, {K})) AS slot) s
    WHERE back = {sql_hash(str(SEED), '0', '0', 'rid', 'slot')} % n""")
def sample_static_uniform(spark, sf):
    edges = both_ways(spark, sf)
    roots = edges.select(F.col("src").alias("rid"), F.col("src").alias("node")).distinct().withColumn(
        "ts", F.lit(0).cast("bigint"))
    return _long(S.sample_static(edges, roots, K, "uniform", SEED), ["rid", "slot", "src_node", "eid"])


@query("""WITH r AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS "row" FROM roots)
    SELECT "row", (SELECT count(*) FROM r) + row_number() OVER (ORDER BY "row", slot) - 1 AS col, eid,
      root_ts - edge_ts AS dt FROM recent5 JOIN r USING (rid)""")
def to_block(spark, sf):
    roots = event_roots(spark, sf)
    edges, _ = S.to_block(S.sample_recent(event_edges(spark, sf), roots, 5), roots)
    return edges.select("row", "col", "eid", "dt")


@query("""WITH r AS (SELECT rid, node, ts, row_number() OVER (ORDER BY rid) - 1 AS ord FROM roots)
    SELECT ord, node, ts FROM r UNION ALL
    SELECT (SELECT count(*) FROM r) + row_number() OVER (ORDER BY ord, slot) - 1, src_node, edge_ts
    FROM recent5 JOIN r USING (rid)""")
def block_frontier(spark, sf):
    roots = event_roots(spark, sf)
    return S.to_block(S.sample_recent(event_edges(spark, sf), roots, 5), roots)[1]


@query("""SELECT (SELECT count(*) FROM roots) AS num_dst_nodes,
    (SELECT count(*) FROM roots) + (SELECT count(*) FROM recent5) AS num_src_nodes,
    (SELECT count(*) FROM recent5) AS num_edges""")
def block_counts(spark, sf):
    roots = event_roots(spark, sf)
    return S.block_counts(*S.to_block(S.sample_recent(event_edges(spark, sf), roots, 5), roots))


@query("SELECT s.*, pid FROM (" + recent_sql("rv", "end_roots", 5) + ") s JOIN item_pt ON node = root_node")
def sample_partitioned(spark, sf):
    """Only items have a partition: user roots return no edges, and only the owners' files are read."""
    path = new_path(spark, "owned-edges")
    io.write_partitioned_edges(both_ways(spark, sf), item_ptable(spark, sf), path)
    found, _ = S.sample_partitioned(spark, path, end_roots(spark, sf), item_ptable(spark, sf), 5)
    return _long(found, [*OUT, "pid"])


@query(recent_sql("rv", "end_roots"))
def sample_recent_bucketed(spark, sf):
    """The newest ten edges from a table bucketed by source: its edges are not shuffled."""
    path = new_path(spark, "bucketed")
    name = f"edges_{path[-32:]}"
    G.write_bucketed(both_ways(spark, sf), name, 8, path)
    return _long(S.sample_bucketed(spark, name, end_roots(spark, sf), K), OUT)


APPENDS = 5
ARRIVAL = f"CASE WHEN eid % 97 = 0 THEN {APPENDS - 1} ELSE ord * {APPENDS} // (SELECT count(*) FROM ev) END"


def ranked_appends(spark, sf):
    """The folder of a ranked graph after five appends; every 97th event comes late, with the last one."""
    path = new_path(spark, "ranked")
    rows = freeze(dense_ordinal(event_edges(spark, sf), ["eid"]), "arrivals")
    n = rows.count()
    arrival = F.when(F.col("eid") % 97 == 0, APPENDS - 1).otherwise(F.floor(F.col("ord") * APPENDS / n))
    for i in range(APPENDS):
        ranked.append_ranked(rows.filter(arrival == i), path, i + 1)
    return path


@query("SELECT src, eid, row_number() OVER (PARTITION BY src ORDER BY ts, seq) AS rk FROM ev")
def append_ranked(spark, sf):
    return ranked.read_ranked(spark, ranked_appends(spark, sf)).select("src", "eid", "rk")


@query(uniform_sql("ev", "roots", K, None, SEED))
def sample_uniform_stored_ranks(spark, sf):
    """Uniform draws by ranks that appends have kept."""
    edges = ranked.read_ranked(spark, ranked_appends(spark, sf))
    return _long(S.sample_uniform(edges, event_roots(spark, sf), K, seed=SEED), OUT)


@query("SELECT node FROM roots UNION SELECT src_node FROM recent5")
def unique_frontier(spark, sf):
    roots = event_roots(spark, sf)
    samples = S.sample_recent(event_edges(spark, sf), roots, 5)
    return S.unique_frontier(roots.select("node").union(samples.select("src_node")))


@query("SELECT row_number() OVER (ORDER BY node, rid) - 1 AS place, rid, node, ts FROM end_roots")
def sort_frontier(spark, sf):
    return S.sort_frontier(end_roots(spark, sf))


@query(f"""SELECT w AS "window", rid, slot, src_node, eid FROM (
    SELECT w, r.rid, e.dst AS src_node, e.eid, row_number() OVER (PARTITION BY w, r.rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS slot
    FROM end_roots r CROSS JOIN (SELECT unnest([0, {DAY}, {DAY // 24}]) AS w) JOIN rv e ON e.src = r.node AND e.ts < r.ts
    AND e.ts >= CASE WHEN w = 0 THEN 0 ELSE r.ts - w END) WHERE slot < 10""")
def compare_windows(spark, sf):
    """Whole history, one day, one hour."""
    windows = [0, DAY, DAY // 24]
    got = S.compare_windows(both_ways(spark, sf), end_roots(spark, sf), K, windows)
    names = F.array(*[F.lit(w) for w in windows])
    return got.select(F.get(names, F.col("snapshot")).alias("window"), "rid", F.col("slot").cast("bigint").alias("slot"), "src_node", "eid")
