"""Features, node state and neighbourhood aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregate as A
from ..operators import batching as B
from ..operators import features as E
from ..operators import sampling as S
from ..operators import state as M
from ..plans.ordering import dense_ordinal
from ..plans.storage import freeze, new_path
from ..sources import versioned
from .batching import ratio_sql, several_negatives
from .common import (BATCH, ITEM, SEED, edge_features, event_edges, event_roots, node_vectors, query,
                     table, vectors, whole, whole_sql)

DIM = 64


def recent5(spark, sf):
    return S.sample_recent(event_edges(spark, sf), event_roots(spark, sf), 5)


FRONT = "front AS (SELECT rid, -1 AS slot, node FROM roots UNION ALL SELECT rid, slot, src_node FROM recent5)"


def front_nodes(spark, sf, samples=None):
    """Every root (slot -1) and every sampled node."""
    samples = recent5(spark, sf) if samples is None else samples
    return event_roots(spark, sf).select("rid", F.lit(-1).cast("bigint").alias("slot"), "node").unionByName(
        samples.select("rid", F.col("slot").cast("bigint").alias("slot"), F.col("src_node").alias("node")))


def sampled_once(spark, sf):
    """The samples, written: both the hot set and the frontier, in its two parts, are made of them."""
    return freeze(recent5(spark, sf).select("rid", "slot", "src_node"), "samples")


@query(f"WITH {FRONT} SELECT rid, slot, node, {whole_sql('feat')} AS feat FROM front LEFT JOIN nv ON id = node")
def attach_node_features(spark, sf):
    front = E.attach_node_features(front_nodes(spark, sf), node_vectors(spark, sf))
    return front.select("rid", "slot", "node", whole("feat").alias("feat"))


@query(f"WITH {FRONT} SELECT rid, slot, node, {whole_sql('feat')} AS feat FROM front LEFT JOIN nv ON id = node")
def attach_with_hot(spark, sf):
    """The same rows, the most used ids joined by broadcast."""
    samples = sampled_once(spark, sf)
    front = E.attach_with_hot(front_nodes(spark, sf, samples), node_vectors(spark, sf), hot(spark, sf, samples))
    return front.select("rid", "slot", "node", whole("feat").alias("feat"))


@query(f"WITH {FRONT} SELECT rid, slot, node, {whole_sql('feat')} AS feat FROM front LEFT JOIN nv ON id = node")
def attach_with_hot_salted(spark, sf):
    """The same rows when the hot vectors are too large to broadcast."""
    samples = sampled_once(spark, sf)
    front = E.attach_with_hot(front_nodes(spark, sf, samples), node_vectors(spark, sf), hot(spark, sf, samples), max_bytes=0, salts=4)
    return front.select("rid", "slot", "node", whole("feat").alias("feat"))


@query("""SELECT rid, slot, eid, round(CAST(f0 AS DOUBLE), 4) AS f0, CAST(f1 AS DOUBLE) AS f1
    FROM recent5 LEFT JOIN ef USING (eid)""")
def attach_edge_features(spark, sf):
    joined = E.attach_edge_features(recent5(spark, sf), edge_features(spark, sf))
    return joined.select("rid", F.col("slot").cast("bigint").alias("slot"), "eid",
                         F.round(F.col("feat")[0].cast("double"), 4).alias("f0"),
                         F.col("feat")[1].cast("double").alias("f1"))


@query("""SELECT batch_id, pos, eid, round(CAST(f0 AS DOUBLE), 4) AS f0, CAST(f1 AS DOUBLE) AS f1
    FROM batches LEFT JOIN ef USING (eid)""")
def target_edge_features(spark, sf):
    batch = B.target_pairs(B.fixed_batches(event_edges(spark, sf), BATCH))
    return E.target_edge_features(batch, edge_features(spark, sf)).select(
        "batch_id", "pos", "eid", F.round(F.col("feat")[0].cast("double"), 4).alias("f0"),
        F.col("feat")[1].cast("double").alias("f1"))


# every event gives its user the vector of its number, the later one wins
UPDATED = """SELECT coalesce(u.id, t.id) AS id, CASE WHEN u.id IS NULL THEN t.feat ELSE u.feat END AS feat
    FROM (SELECT vec_id AS id, embedding AS feat FROM embeddings) t FULL JOIN
      (SELECT src AS id, embedding AS feat FROM (SELECT src, eid, row_number() OVER (PARTITION BY src ORDER BY eid DESC) AS k FROM ev)
         JOIN embeddings ON vec_id = eid % (SELECT count(*) FROM embeddings) WHERE k = 1) u ON u.id = t.id"""


def event_vectors(spark, sf):
    """eid, src, dst, ts and the vector of the event's number: eid mod number of vectors."""
    base = vectors(spark, sf)
    ev = event_edges(spark, sf).withColumn("_v", F.pmod("eid", F.lit(base.count())))
    return ev.join(base.select(F.col("id").alias("_v"), "feat"), "_v").drop("_v")


def updates(spark, sf):
    return event_vectors(spark, sf).select(F.col("src").alias("id"), "feat", F.col("eid").alias("version"))


def updated_table(spark, sf):
    return E.upsert_features(vectors(spark, sf), updates(spark, sf))


@query(f"WITH u AS ({UPDATED}) SELECT id, {whole_sql('feat')} AS feat FROM u")
def upsert_features(spark, sf):
    return updated_table(spark, sf).select("id", whole("feat").alias("feat"))


LOOKUP = f"""WITH u AS ({UPDATED}) SELECT eid AS req, dst - {ITEM} AS id, {whole_sql('feat')} AS feat
    FROM ev LEFT JOIN u ON u.id = dst - {ITEM}"""


def requests(spark, sf):
    return event_edges(spark, sf).select(F.col("eid").alias("req"), (F.col("dst") - ITEM).alias("id"))


@query(LOOKUP)
def lookup(spark, sf):
    return E.lookup(updated_table(spark, sf), requests(spark, sf)).select("req", "id", whole("feat").alias("feat"))


def versioned_table(spark, sf):
    """The same table as a base and three deltas of events in their order, the first two folded."""
    path = new_path(spark, "feature-versions")
    versioned.create(vectors(spark, sf), path)
    parts = freeze(dense_ordinal(updates(spark, sf), ["version"]), "updates")
    n = parts.count()
    for k in range(3):
        part = parts.filter(F.floor(F.col("ord") * 3 / n) == k).drop("ord")
        versioned.append(part, path, k + 1, order="version")
    versioned.compact(spark, path, 2)
    return path


@query(f"WITH u AS ({UPDATED}) SELECT id, {whole_sql('feat')} AS feat FROM u")
def upsert_versions(spark, sf):
    return versioned.read(spark, versioned_table(spark, sf)).select("id", whole("feat").alias("feat"))


@query(LOOKUP)
def lookup_versions(spark, sf):
    found = versioned.lookup(spark, versioned_table(spark, sf), requests(spark, sf))
    return found.select("req", "id", whole("feat").alias("feat"))


@query(f"SELECT vec_id AS id, {whole_sql('embedding')} AS feat FROM embeddings")
def read_first_version(spark, sf):
    """The table as it was before any update."""
    return versioned.read(spark, versioned_table(spark, sf), 0).select("id", whole("feat").alias("feat"))


BLOCK = f"(SELECT *, rid // {BATCH} AS block FROM recent5)"


def blocks(spark, sf):
    return recent5(spark, sf).withColumn("block", F.floor(F.col("rid") / BATCH))


@query(f"SELECT src_node AS id, count(DISTINCT block) AS n FROM {BLOCK} GROUP BY src_node")
def access_counts(spark, sf):
    return E.access_counts(blocks(spark, sf), "src_node", ["block"])


@query("SELECT eid AS id, count(*) AS n FROM recent5 GROUP BY eid")
def access_counts_raw(spark, sf):
    return E.access_counts(recent5(spark, sf), "eid")


HOT = """hot AS (SELECT * FROM (SELECT src_node AS id, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, src_node) - 1 AS rank FROM recent5 GROUP BY src_node)
    WHERE rank < floor(0.2 * (SELECT count(DISTINCT src_node) FROM recent5)))"""


def hot(spark, sf, samples=None):
    """A fifth of the ids that were sampled."""
    # counted, and read twice to be ranked
    counts = freeze(E.access_counts(recent5(spark, sf) if samples is None else samples, "src_node"), "access-counts")
    return E.hot_set(counts, 0.2, counts.count())


@query(f"WITH {HOT} SELECT id, n, rank FROM hot")
def hot_set(spark, sf):
    return hot(spark, sf)


@query(f"""WITH {HOT}, share AS (SELECT block, count(hot.id) / count(*) AS s FROM {BLOCK} LEFT JOIN hot ON id = src_node
    GROUP BY block) SELECT round(avg(s), 6) AS coverage, count(*) AS blocks FROM share""")
def hot_set_coverage(spark, sf):
    got = E.hot_set_coverage(blocks(spark, sf), hot(spark, sf), "src_node", ["block"])
    return got.select(F.round("coverage", 6).alias("coverage"), "blocks")


# --- node state: memory of 64 numbers, mail of 64 + 64 + 2 --------------------------------------

MEM, EDGE = DIM, 2
MAIL = 2 * MEM + EDGE
# users and items known to the vector table have a memory, everyone else starts from nothing
START = "start AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS mem FROM embeddings)"


def zeros_sql(n: int) -> str:
    return f"list_resize([0.0::DOUBLE], {n}, 0.0::DOUBLE)"


def start_state(spark, sf):
    return vectors(spark, sf).select(
        F.col("id").alias("node"), F.transform("feat", lambda x: x.cast("double")).alias("mem"),
        F.lit(0).cast("bigint").alias("mem_ts"), V.zeros(MAIL).alias("mail"), F.lit(0).cast("bigint").alias("mail_ts"))


def event_nodes(spark, sf):
    ev = event_edges(spark, sf)
    return ev.select(F.col("src").alias("node")).union(ev.select("dst"))


def whole_state(state, *keep: str):
    return state.select(*keep, whole("mem").alias("mem"), "mem_ts", whole("mail").alias("mail"), "mail_ts")


@query(f"""WITH {START} SELECT node, {whole_sql('mem')} AS mem, 0 AS mem_ts, {whole_sql(zeros_sql(MAIL))} AS mail, 0 AS mail_ts FROM start UNION ALL
    SELECT node, {whole_sql(zeros_sql(MEM))}, 0, {whole_sql(zeros_sql(MAIL))}, 0 FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev)
    WHERE node NOT IN (SELECT node FROM start)""")
def insert_missing_state(spark, sf):
    return whole_state(M.insert_missing_state(start_state(spark, sf), event_nodes(spark, sf), MEM, MAIL), "node")


@query(f"SELECT vec_id AS node, {whole_sql(zeros_sql(MEM))} AS mem, 0 AS mem_ts, {whole_sql(zeros_sql(MAIL))} AS mail, 0 AS mail_ts FROM embeddings")
def reset_state(spark, sf):
    """Of a state with mails and times."""
    state = M.update_mailbox(start_state(spark, sf), interactions(spark, sf), MEM, MAIL)
    known = state.join(vectors(spark, sf).select(F.col("id").alias("node")), "node", "left_semi")
    return whole_state(M.reset_state(known), "node")


MAILS = f"""{START}, rows AS (SELECT batch_id, 2 * pos + i AS p, CASE i WHEN 0 THEN src ELSE dst END AS node,
      CASE i WHEN 0 THEN dst ELSE src END AS other, b.ts, f0, f1 FROM batches b JOIN ef USING (eid), (SELECT unnest([0, 1]) AS i)),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY batch_id DESC, p DESC) AS k FROM rows)
      WHERE k = 1),
    mails AS (SELECT coalesce(l.node, s.node) AS node, CASE WHEN l.node IS NULL THEN {zeros_sql(MAIL)} ELSE list_concat(list_concat(
        coalesce(s.mem, {zeros_sql(MEM)}), coalesce(o.mem, {zeros_sql(MEM)})), [CAST(f0 AS DOUBLE), CAST(f1 AS DOUBLE)]) END AS mail, coalesce(l.ts, 0) AS mail_ts
      FROM last l FULL JOIN start s ON l.node = s.node LEFT JOIN start o ON o.node = l.other)"""


@query(f"""WITH {MAILS} SELECT rid, slot, f.node, {whole_sql(f"coalesce(s.mem, {zeros_sql(MEM)})")} AS mem, 0 AS mem_ts,
    {whole_sql(f"coalesce(mail, {zeros_sql(MAIL)})")} AS mail, coalesce(mail_ts, 0) AS mail_ts
    FROM {FRONT[len("front AS "):]} f LEFT JOIN start s ON s.node = f.node LEFT JOIN mails m ON m.node = f.node""")
def node_state_lookup(spark, sf):
    """Memory and mail of every frontier row."""
    state = M.update_mailbox(start_state(spark, sf), interactions(spark, sf), MEM, MAIL)
    return whole_state(M.node_state_lookup(front_nodes(spark, sf), state, MEM, MAIL), "rid", "slot", "node")


def memory_batch(spark, sf):
    """Stacked batches whose new memory is the vector of the event's number, negative for destinations."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("src").alias("role"), F.col("src").alias("node")),
                             F.struct(F.lit(1).alias("i"), F.lit("dst").alias("role"), F.col("dst").alias("node"))))
    made = event_vectors(spark, sf).select("eid", "feat")
    rows = B.fixed_batches(event_edges(spark, sf), BATCH).join(made, "eid").withColumn("p", ends)
    sign = 1 - 2 * F.col("p.i")
    return rows.select("batch_id", (F.col("p.i") * BATCH + F.col("pos")).alias("pos"), "p.role", "p.node", "ts",
                       F.transform("feat", lambda x: x.cast("double") * sign).alias("mem"))


@query(f"""WITH {START}, rows AS (
      SELECT batch_id, i * {BATCH} + pos AS p, CASE i WHEN 0 THEN src ELSE dst END AS node, ts, i, eid FROM batches, (SELECT unnest([0, 1]) AS i)),
    last AS (SELECT l.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 - 2 * i)) AS new FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY batch_id DESC, p DESC) AS k FROM rows) l
      JOIN embeddings ON vec_id = eid % (SELECT count(*) FROM embeddings) WHERE k = 1)
    SELECT coalesce(l.node, s.node) AS node, {whole_sql('CASE WHEN l.node IS NULL THEN s.mem ELSE l.new END')} AS mem, coalesce(l.ts, 0) AS mem_ts,
      {whole_sql(zeros_sql(MAIL))} AS mail, 0 AS mail_ts
    FROM last l FULL JOIN start s ON l.node = s.node""")
def update_memory(spark, sf):
    return whole_state(M.update_memory(start_state(spark, sf), memory_batch(spark, sf), MEM, MAIL), "node")


def interactions(spark, sf):
    """Batched edges with the memory of both ends and the edge features."""
    rows = B.fixed_batches(event_edges(spark, sf), BATCH).withColumnRenamed("pos", "i")
    state = start_state(spark, sf)
    for end in ("src", "dst"):
        got = M.node_state_lookup(rows.select("eid", F.col(end).alias("node")), state, MEM, MAIL)
        rows = rows.join(got.select("eid", F.col("mem").alias(f"mem_{end}")), "eid")
    return rows.join(edge_features(spark, sf), "eid")


@query(f"""WITH {MAILS} SELECT m.node, {whole_sql(f"coalesce(s.mem, {zeros_sql(MEM)})")} AS mem, 0 AS mem_ts, {whole_sql('mail')} AS mail, mail_ts
    FROM mails m LEFT JOIN start s ON s.node = m.node""")
def update_mailbox(spark, sf):
    return whole_state(M.update_mailbox(start_state(spark, sf), interactions(spark, sf), MEM, MAIL), "node")


TIME_DIM = 8


@query("SELECT rid, slot, " + ", ".join(
    f"round(cos((root_ts - edge_ts) / 1000000.0::DOUBLE * {10.0 ** (-9.0 * i / (TIME_DIM - 1))!r}::DOUBLE), 5) AS c{i}"
    for i in range(TIME_DIM)) + " FROM recent5")
def time_encode(spark, sf):
    code = V.time_encode(F.col("dt") / 1e6, TIME_DIM)
    rows = recent5(spark, sf).withColumn("code", code)
    return rows.select("rid", F.col("slot").cast("bigint").alias("slot"),
                       *[F.round(F.col("code")[i], 5).alias(f"c{i}") for i in range(TIME_DIM)])


@query(f"""WITH {MAILS} SELECT rid, {whole_sql(f"list_concat(coalesce(mail, {zeros_sql(MAIL)}), [" + ", ".join(
    f"cos(r.ts / 60000000.0::DOUBLE * {10.0 ** (-9.0 * i / 3)!r}::DOUBLE)" for i in range(4)) + "])")} AS message
    FROM roots r LEFT JOIN mails m ON m.node = r.node""")
def message_input(spark, sf):
    """Mail and a four-number code of the minutes since the (never updated) memory."""
    state = M.update_mailbox(start_state(spark, sf), interactions(spark, sf), MEM, MAIL)
    front = M.node_state_lookup(event_roots(spark, sf), state, MEM, MAIL)
    got = M.message_input(front.withColumn("ts", F.col("ts") / 6e7), 4)
    return got.select("rid", whole("message").alias("message"))


# --- aggregation -------------------------------------------------------------------------------

def _aggregated(spark, sf, how):
    got = A.neighbor_aggregate(recent5(spark, sf), node_vectors(spark, sf), DIM, how, ["rid"])
    return got.select("rid", whole("agg").alias("agg"))


def _agg_sql(fn: str, neighbors: str = "SELECT rid, src_node AS n FROM recent5") -> str:
    return f"""SELECT rid, {whole_sql('list(v ORDER BY i)')} AS agg FROM
        (SELECT rid, i, {fn}(CAST(feat[i] AS DOUBLE)) AS v FROM ({neighbors}) JOIN nv ON id = n, (SELECT unnest(range(1, {DIM + 1})) AS i)
         GROUP BY rid, i) GROUP BY rid"""


@query(_agg_sql("avg"))
def neighbor_mean(spark, sf):
    return _aggregated(spark, sf, "mean")


@query(_agg_sql("max"))
def neighbor_max(spark, sf):
    return _aggregated(spark, sf, "max")


@query(_agg_sql("avg", "SELECT rid, src_node AS n FROM recent5 UNION ALL SELECT DISTINCT rid, node FROM recent5"))
def neighbor_mean_with_self(spark, sf):
    return _aggregated(spark, sf, "gcn")


@query("SELECT rid, sum(root_ts - edge_ts)::BIGINT AS total FROM recent5 GROUP BY rid")
def neighbor_sum(spark, sf):
    return A.neighbor_sum(recent5(spark, sf), "dt", ["rid"])


SCORE = "scored AS (SELECT *, -(root_ts - edge_ts) / 86400000000.0::DOUBLE AS score FROM recent5)"
SOFT = f"""{SCORE}, raised AS (SELECT *, exp(score - max(score) OVER (PARTITION BY rid)) AS x FROM scored),
    soft AS (SELECT *, x / sum(x) OVER (PARTITION BY rid) AS weight FROM raised)"""


def scored5(spark, sf):
    """Score: minus the days since the edge."""
    return recent5(spark, sf).withColumn("score", -F.col("dt") / 86_400_000_000)


@query(f"WITH {SOFT} SELECT rid, slot, round(weight, 6) AS weight FROM soft")
def segment_softmax(spark, sf):
    got = A.segment_softmax(scored5(spark, sf), "score", ["rid"])
    return got.select("rid", F.col("slot").cast("bigint").alias("slot"), F.round("weight", 6).alias("weight"))


@query(f"WITH {SCORE.replace('-(root_ts - edge_ts) / 86400000000.0::DOUBLE', 'f0').replace('FROM recent5', 'FROM ev JOIN ef USING (eid)')}, "
       "raised AS (SELECT *, exp(CAST(score AS DOUBLE) - max(CAST(score AS DOUBLE)) OVER (PARTITION BY src)) AS x FROM scored) "
       "SELECT eid, round(x / sum(x) OVER (PARTITION BY src), 6) AS weight FROM raised")
def segment_softmax_any_size(spark, sf):
    """Softmax of every user's event values: groups of any size."""
    rows = event_edges(spark, sf).join(edge_features(spark, sf), "eid").withColumn("score", F.col("feat")[0].cast("double"))
    got = A.segment_softmax(rows, "score", ["src"], bounded=False)
    return got.select("eid", F.round("weight", 6).alias("weight"))


@query(f"""WITH {SOFT}, parts AS (SELECT rid, i, sum(weight * CAST(feat[i] AS DOUBLE)) AS v
      FROM soft JOIN nv ON id = src_node, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY rid, i),
    summed AS (SELECT rid, list(v ORDER BY i) AS agg FROM parts GROUP BY rid)
    SELECT r.rid, {whole_sql(f"coalesce(agg, list_resize([0.0::DOUBLE], {DIM}, 0.0::DOUBLE))")} AS agg FROM roots r LEFT JOIN summed USING (rid)""")
def weighted_neighbor_sum(spark, sf):
    got = A.weighted_neighbor_sum(scored5(spark, sf), event_roots(spark, sf).select("rid"), node_vectors(spark, sf),
                                  "score", DIM)
    return got.select("rid", whole("agg").alias("agg"))


@query("""SELECT eid, round(CASE WHEN x > 0 THEN x ELSE 0.2 * x END, 6) AS y FROM
    (SELECT event_id AS eid, value - 20 AS x FROM events)""")
def leaky_relu(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("eid"), (F.col("value") - 20).alias("x"))
    return rows.select("eid", F.round(V.leaky_relu("x"), 6).alias("y"))


PRODUCT = """SELECT ord, label, round(list_dot_product(CAST(s.feat AS DOUBLE[]), CAST(o.feat AS DOUBLE[])), 6) AS score,
      array_to_string([CAST(round(CAST(s.feat[i] AS DOUBLE) * CAST(o.feat[i] AS DOUBLE) * 1000000) AS BIGINT) FOR i IN range(1, 65)], ',') AS product
    FROM (SELECT ord, src, dst AS other, 1 AS label FROM with_neg UNION ALL SELECT ord, src, neg, 0 FROM with_neg) w
    JOIN nv s ON s.id = w.src JOIN nv o ON o.id = w.other"""


def link_logits(spark, sf):
    """Dot product of the user's vector with the real and with the negative item."""
    edges = event_edges(spark, sf)
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("dst").alias("other")),
                              F.struct(F.lit(0).alias("label"), F.col("neg").alias("other"))))
    rows = B.negative_dst(B.fixed_batches(edges, BATCH), B.dst_pool(edges), SEED)
    rows = rows.select("ord", "batch_id", "src", pairs.alias("p")).select("ord", "batch_id", "src", "p.label", "p.other")
    feats = node_vectors(spark, sf)
    rows = rows.join(feats.select(F.col("id").alias("src"), F.col("feat").alias("a")), "src")
    rows = rows.join(feats.select(F.col("id").alias("other"), F.col("feat").alias("b")), "other")
    return rows.withColumn("product", V.pair_product("a", "b")).drop("a", "b")


@query(PRODUCT)
def pair_product(spark, sf):
    return link_logits(spark, sf).select("ord", F.col("label").cast("bigint").alias("label"),
                                         F.round(V.vector_sum("product"), 6).alias("score"),
                                         whole("product").alias("product"))


@query(f"""SELECT ord, r, {whole_sql('list_transform(list_zip(s.feat, o.feat), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))')} AS product
    FROM ({ratio_sql()}) w JOIN nv s ON s.id = w.src JOIN nv o ON o.id = w.neg""")
def pair_product_ratio(spark, sf):
    """Products of every source with each of its negatives."""
    rows = several_negatives(spark, sf).select("ord", "src", F.posexplode("negs").alias("r", "neg"))
    feats = node_vectors(spark, sf)
    rows = rows.join(feats.select(F.col("id").alias("src"), F.col("feat").alias("a")), "src")
    rows = rows.join(feats.select(F.col("id").alias("neg"), F.col("feat").alias("b")), "neg")
    return rows.select("ord", F.col("r").cast("bigint").alias("r"), whole(V.pair_product("a", "b")).alias("product"))
