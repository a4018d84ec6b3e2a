"""Batches and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as B
from ..plans.ordering import dense_ordinal
from ..plans.storage import freeze
from .common import BATCH, MID, SEED, event_edges, query, sql_hash, table

CHUNKS, R, WORLD = 8, 3, 4
SKIP = R * BATCH // CHUNKS
FIRST = R * (BATCH // CHUNKS)
RATIO = 3


@query("SELECT eid, batch_id, pos FROM batches")
def fixed_batches(spark, sf):
    return B.fixed_batches(event_edges(spark, sf), BATCH).select("eid", "batch_id", "pos")


@query(f"""SELECT eid, batch_id, CASE WHEN batch_id = {SKIP} // {BATCH} THEN ord - {SKIP} ELSE pos END AS pos
    FROM batches WHERE ord >= {SKIP}""")
def random_start_trim(spark, sf):
    return B.random_start_trim(event_edges(spark, sf), BATCH, CHUNKS, R).select("eid", "batch_id", "pos")


@query(f"""SELECT eid, CASE WHEN ord < {FIRST} THEN 0 ELSE 1 + (ord - {FIRST}) // {BATCH} END AS batch_id,
    CASE WHEN ord < {FIRST} THEN ord ELSE (ord - {FIRST}) % {BATCH} END AS pos FROM ev_ord""")
def random_start_short(spark, sf):
    return B.random_start_short(event_edges(spark, sf), BATCH, CHUNKS, R).select("eid", "batch_id", "pos")


@query(f"""SELECT eid, CASE WHEN ord < {FIRST} THEN 0 ELSE 1 + (ord - {FIRST}) // {BATCH} END AS batch_id
    FROM ev_ord, (SELECT count(*) AS n FROM ev)
    WHERE ord < {FIRST} + (n - {FIRST}) // {BATCH} * {BATCH}""")
def random_start_drop_last(spark, sf):
    return B.random_start_short(event_edges(spark, sf), BATCH, CHUNKS, R, drop_last=True).select("eid", "batch_id")


@query(f"""SELECT eid, ord % {WORLD} AS rank, (ord // {WORLD}) // {BATCH} AS batch_id, (ord // {WORLD}) % {BATCH} AS pos
    FROM ev_ord""")
def rank_shard(spark, sf):
    """All workers' shards, each batched on its own."""
    out, edges = None, freeze(dense_ordinal(event_edges(spark, sf), ["eid"]), "numbered")
    for rank in range(WORLD):
        part = B.rank_shard(edges, rank, WORLD, BATCH).select(
            "eid", F.lit(rank).cast("bigint").alias("rank"), "batch_id", "pos")
        out = part if out is None else out.unionByName(part)
    return out


def stacked_sql(roles: int) -> str:
    names = ["src", "dst", "neg"][:roles]
    source = "with_neg" if roles == 3 else "batches"
    parts = [f"""SELECT batch_id, {i} * count(*) OVER (PARTITION BY batch_id) + pos AS pos, '{name}' AS role,
        {name} AS node, ts, {'eid' if i == 0 else 'NULL'} AS eid FROM {source}""" for i, name in enumerate(names)]
    return " UNION ALL ".join(parts)


def negatives(spark, sf):
    edges = event_edges(spark, sf)
    return B.negative_dst(B.fixed_batches(edges, BATCH), B.dst_pool(edges), SEED)


@query(stacked_sql(3))
def target_triples(spark, sf):
    return B.target_triples(negatives(spark, sf))


@query(stacked_sql(2))
def target_pairs(spark, sf):
    return B.target_pairs(B.fixed_batches(event_edges(spark, sf), BATCH))


@query("SELECT eid, src, dst, neg FROM with_neg")
def negative_dst(spark, sf):
    return negatives(spark, sf).select("eid", "src", "dst", "neg")


@query(f"""WITH taken AS (SELECT src, idx - row_number() OVER (PARTITION BY src ORDER BY idx) + 1 AS below FROM
      (SELECT DISTINCT src, idx FROM ev JOIN pool ON dst = id)),
    free AS (SELECT src, (SELECT count(*) FROM pool) - count(*) AS free FROM taken GROUP BY src),
    asked AS (SELECT eid, ord, src, CASE WHEN free > 0 THEN {sql_hash(str(SEED), "'dst'", 'ord')} % free END AS pick
      FROM ev_ord JOIN free USING (src)),
    placed AS (SELECT eid, ord, any_value(a.src) AS src, any_value(pick) + count(below) AS idx
      FROM asked a LEFT JOIN taken t ON t.src = a.src AND below <= pick GROUP BY eid, ord)
    SELECT eid, src, id AS neg FROM placed p LEFT JOIN pool ON pool.idx = p.idx""")
def negative_dst_without_real_edges(spark, sf):
    """No positive is lost; only a source with edges to the whole pool has no negative."""
    edges = event_edges(spark, sf)
    return B.negative_dst(B.fixed_batches(edges, BATCH), B.dst_pool(edges), SEED, exclude=edges).select("eid", "src", "neg")


def ratio_sql() -> str:
    """eid, batch_id, ord, r, neg for RATIO negatives."""
    several = sql_hash(str(SEED), "'dst'", "ord", "r")
    return f"""SELECT b.*, r, id AS neg FROM batches b, (SELECT unnest(range({RATIO})) AS r)
        JOIN pool ON idx = (CASE WHEN r = 0 THEN {sql_hash(str(SEED), "'dst'", 'ord')} ELSE {several} END) % (SELECT count(*) FROM pool)"""


def several_negatives(spark, sf):
    edges = event_edges(spark, sf)
    return B.negative_dst(B.fixed_batches(edges, BATCH), B.dst_pool(edges), SEED, neg_ratio=RATIO)


@query(ratio_sql().replace("b.*", "eid, src, dst"))
def negative_dst_ratio(spark, sf):
    return several_negatives(spark, sf).select("eid", "src", "dst", F.posexplode("negs").alias("r", "neg"))


@query(f"""WITH several AS ({ratio_sql()})
    SELECT batch_id, 0 * count(*) OVER (PARTITION BY batch_id) + pos AS pos, 'src' AS role, src AS node, ts, eid FROM batches
    UNION ALL SELECT batch_id, count(*) OVER (PARTITION BY batch_id) + pos, 'dst', dst, ts, NULL FROM batches
    UNION ALL SELECT batch_id, (2 + r) * count(*) OVER (PARTITION BY batch_id, r) + pos, 'neg', neg, ts, NULL FROM several""")
def target_triples_ratio(spark, sf):
    return B.target_triples(several_negatives(spark, sf), RATIO)


@query(f"""SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM
    (SELECT dst AS id FROM ev UNION SELECT 20000000 + p_partkey FROM part)""")
def extend_dst_pool(spark, sf):
    """The pool of the first half of the events, extended by the second half and by the parts."""
    edges = event_edges(spark, sf)
    pool = B.dst_pool(edges.filter(F.col("ts") < MID))
    late = edges.filter(F.col("ts") >= MID).select("dst")
    return B.extend_pool(pool, late.union(table(spark, sf, "part").select((F.col("p_partkey") + 20_000_000).alias("dst"))))


@query(f"""SELECT o.ord, s.id AS src, d.id AS dst FROM ev_ord o
    JOIN src_pool s ON s.idx = {sql_hash(str(SEED), "'src'", 'o.ord')} % (SELECT count(*) FROM src_pool)
    JOIN pool d ON d.idx = {sql_hash(str(SEED), "'dst'", 'o.ord')} % (SELECT count(*) FROM pool)""")
def random_edges(spark, sf):
    edges = event_edges(spark, sf)
    return B.random_edges(edges, B.fixed_batches(edges, BATCH), SEED)


@query(f"SELECT eid, {sql_hash(str(SEED), chr(39) + 'node' + chr(39), 'eid')} % (SELECT max(greatest(src, dst)) + 1 FROM ev) AS neg FROM ev")
def negative_node(spark, sf):
    """Nodes are numbered from 0 to the highest id."""
    edges = event_edges(spark, sf)
    nodes = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return B.negative_node(edges, nodes, SEED, "eid").select("eid", "neg")


@query(f"""SELECT 'train' AS pool, id, row_number() OVER (ORDER BY id) - 1 AS idx FROM
      (SELECT DISTINCT dst AS id FROM oe WHERE ts < epoch_us(TIMESTAMP '1996-01-01'))
    UNION ALL SELECT 'all', id, row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT dst AS id FROM oe)""")
def dst_pools(spark, sf):
    from .common import order_edges
    edges = order_edges(spark, sf)
    cut = 820_454_400_000_000  # 1996-01-01
    first, full = B.dst_pools(edges.filter(F.col("ts") < cut), edges.filter(F.col("ts") >= cut))
    return (first.select(F.lit("train").alias("pool"), "id", "idx")
            .unionByName(full.select(F.lit("all").alias("pool"), "id", "idx")))
