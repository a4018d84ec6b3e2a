"""Increments, replay, retention and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import batching as B
from ..operators import continuous as C
from ..plans.ordering import dense_ordinal
from ..plans.storage import freeze, new_path
from ..sources import versioned
from ..streaming import ingest, memory, runs, state
from .common import BATCH, DAY, SEED, edge_features, edges_from_events, event_edges, query, sql_hash, table, whole_sql
from .features import EDGE, MAIL, MEM, START, start_state, whole_state, zeros_sql

RATIO, VAL, STEPS, K = 0.3, 0.1, 10, 5
SIZES = f"""n AS (SELECT count(*) AS n, floor(count(*) * {RATIO})::BIGINT AS p FROM ev)"""
STEPPED = f"""{SIZES}, z AS (SELECT p, (n - p) // {STEPS} AS size FROM n),
    stepped AS (SELECT * FROM (SELECT o.*, CASE WHEN ord < p THEN -1 ELSE (ord - p) // size END AS step FROM ev_ord o, z)
      WHERE step < {STEPS})"""


def ordered(spark, sf):
    return dense_ordinal(event_edges(spark, sf), ["eid"])


def stepped(spark, sf):
    rows = freeze(ordered(spark, sf), "ordered")
    return C.increments(rows, int(rows.count() * RATIO), STEPS)


@query(f"""WITH {SIZES} SELECT eid, CASE WHEN ord >= p THEN 'phase2'
    WHEN ord < floor(p * (1 - {VAL}))::BIGINT + 1 THEN 'phase1_train' ELSE 'phase1_val' END AS phase FROM ev_ord, n""")
def phase_split(spark, sf):
    return C.phase_split(event_edges(spark, sf), RATIO, VAL).select("eid", "phase")


@query(f"WITH {STEPPED} SELECT eid, step FROM stepped")
def increments(spark, sf):
    return stepped(spark, sf).select("eid", "step")


REPLAY = f"""{SIZES}, old AS (SELECT i AS replay, p // 4 + {sql_hash(str(SEED), "'replay'", 'i')} % (p - p // 4) AS ord
      FROM n, (SELECT unnest(range(0, (SELECT floor(0.5 * p)::BIGINT FROM n))) AS i)),
    chosen AS (SELECT ord, replay FROM old UNION ALL SELECT ord, -1 FROM ev_ord, n WHERE ord >= p AND ord < p + p // 6),
    retrain AS (SELECT ord, replay, row_number() OVER (ORDER BY ord, replay) - 1 AS place FROM chosen)"""


def _retrain(spark, sf):
    """Old rows from the first quarter of phase 1 on are replayed before p/6 new rows."""
    rows = freeze(ordered(spark, sf), "ordered")
    start = int(rows.count() * RATIO)
    return C.retrain_rows(rows, start // 4, start, start + start // 6, 0.5, SEED)


@query(f"WITH {REPLAY} SELECT place, eid, replay FROM retrain JOIN ev_ord USING (ord)")
def replay_sample(spark, sf):
    return _retrain(spark, sf).select("place", "eid", "replay")


@query(f"""WITH {REPLAY} SELECT place, CASE WHEN place < floor((SELECT count(*) FROM retrain) * (1 - {VAL}))::BIGINT + 1
    THEN 'train' ELSE 'val' END AS part FROM retrain""")
def ordered_train_val(spark, sf):
    return C.ordered_train_val(freeze(_retrain(spark, sf), "retrain"), VAL).select("place", "part")


@query(f"""WITH {STEPPED} SELECT eid, step FROM stepped WHERE step <= 4
    AND ts >= (SELECT arg_min(ts, ord) FROM stepped WHERE step = 4) - {3 * DAY}""")
def sliding_retention(spark, sf):
    return C.sliding_retention(freeze(stepped(spark, sf), "stepped"), 4, 3 * DAY).select("eid", "step")


@query(f"""WITH {STEPPED}, asked AS (SELECT step, ord, 1 AS label, dst AS node FROM stepped WHERE step >= 0 UNION ALL
      SELECT step, s.ord, 0, id FROM stepped s JOIN pool ON idx = {sql_hash(str(SEED), "'dst'", 's.ord')}
        % (SELECT count(*) FROM pool) WHERE step >= 0),
    scored AS (SELECT a.step, a.label, (SELECT count(*) FROM stepped s WHERE s.dst = a.node AND s.step < a.step) AS score
      FROM asked a),
    r AS (SELECT step, label, rank() OVER (PARTITION BY step ORDER BY score)
        + (count(*) OVER (PARTITION BY step, score) - 1) / 2 AS r,
        sum(label) OVER (PARTITION BY step) AS p, sum(1 - label) OVER (PARTITION BY step) AS n FROM scored),
    auc AS (SELECT step, (sum(CASE WHEN label = 1 THEN r END) - any_value(p) * (any_value(p) + 1) / 2)
      / (any_value(p) * any_value(n)) AS auc FROM r GROUP BY step),
    ap AS (SELECT step, sum(p * tp / total) / sum(p) AS ap FROM (SELECT step, p, sum(p) OVER w AS tp, sum(c) OVER w AS total
      FROM (SELECT step, score, sum(label) AS p, count(*) AS c FROM scored GROUP BY step, score)
      WINDOW w AS (PARTITION BY step ORDER BY score DESC)) GROUP BY step)
    SELECT step, round(auc, 9) AS auc, round(ap, 6) AS ap FROM auc JOIN ap USING (step)""")
def prequential(spark, sf):
    """Each increment is scored by item popularity before it, against one negative per edge."""
    pool = B.dst_pool(event_edges(spark, sf))
    got = C.prequential(freeze(stepped(spark, sf), "stepped"), C.popularity_scorer(pool, SEED))
    return got.select("step", F.round("auc", 9).alias("auc"), F.round("ap", 6).alias("ap"))


@contextmanager
def _rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def event_stream(spark, sf, path):
    """The events as several files, read one per micro-batch."""
    events = table(spark, sf, "events")
    events.repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    return ingest.read_stream(spark, f"{path}/in", events.schema, files_per_trigger=1)


@query("SELECT src, dst, ts, eid FROM ev")
def stream_edges(spark, sf):
    """Events ingested as a stream: deduplicated, late rows dropped, appended per micro-batch."""
    path = new_path(spark, "stream")
    stream = event_stream(spark, sf, path).select("*", F.col("ts").cast("timestamp").alias("event_time"))
    edges = stream.select("*", F.col("event_id").alias("eid"))
    kept = ingest.drop_late(edges, "40 days")
    ingest.stream_edges(edges_from_events(kept), f"{path}/graph", f"{path}/checkpoint").awaitTermination()
    return ingest.read_graph(spark, f"{path}/graph").select("src", "dst", "ts", "eid")


LATE = "signup"


@query(f"""WITH seen AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - {7 * DAY} AS mark FROM events WHERE event_type <> '{LATE}')
    SELECT event_id AS eid, event_type FROM events, seen WHERE event_type <> '{LATE}' OR epoch_us(ts) > mark""")
def drop_late(spark, sf):
    """Sign-ups arrive after everything else: those behind the watermark are dropped, not fatal."""
    path = new_path(spark, "late")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("eid"), "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    schema = events.schema
    for arriving in (F.col("event_type") != LATE, F.col("event_type") == LATE):
        events.filter(arriving).write.mode("append").parquet(f"{path}/in")
        kept = ingest.drop_late(ingest.read_stream(spark, f"{path}/in", schema), "7 days")
        state.write_updates(kept, f"{path}/out", f"{path}/checkpoint", "append").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select("eid", "event_type")


@query(f"""SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY ts DESC, seq DESC) - 1 AS slot, dst, ts, eid
    FROM ev QUALIFY slot < {K}""")
def recent_neighbors_state(spark, sf):
    """The last five items of every user, kept by a stateful stream."""
    path = new_path(spark, "recent")
    with _rocksdb(spark):
        updates = state.recent_neighbors_state(edges_from_events(event_stream(spark, sf, path)), K, salts=2)
        state.write_updates(updates, f"{path}/updates", f"{path}/checkpoint").awaitTermination()
    return state.merge_recent(spark.read.parquet(f"{path}/updates"), K)


@query(f"""SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY ts DESC, seq DESC) - 1 AS slot, dst, ts, eid
    FROM ev QUALIFY slot < {K}""")
def recent_neighbors_at(spark, sf):
    """The same lists read from the stream's state store, without stored updates."""
    path = new_path(spark, "recent-state")
    with _rocksdb(spark):
        updates = state.recent_neighbors_state(edges_from_events(event_stream(spark, sf, path)), K, salts=2)
        state.write_updates(updates, f"{path}/updates", f"{path}/checkpoint").awaitTermination()
        return freeze(state.recent_at(spark, f"{path}/checkpoint", K), "recent-at")


@query(f"""SELECT node, ts, eid FROM (SELECT node, ts, eid, row_number() OVER (PARTITION BY node ORDER BY b DESC, p DESC) AS k
    FROM (SELECT src AS node, ts, eid, eid // {BATCH} AS b, eid % {BATCH} AS p FROM ev UNION ALL
      SELECT dst, ts, eid, eid // {BATCH}, eid % {BATCH} + {BATCH} FROM ev)) WHERE k = 1""")
def node_state_stream(spark, sf):
    """The last interaction of every node, kept by a stream; its first batches are compacted."""
    path = new_path(spark, "last")
    updates = state.node_state_stream(edges_from_events(event_stream(spark, sf, path)), BATCH)
    state.write_updates(updates, f"{path}/updates", f"{path}/checkpoint").awaitTermination()
    return state.merge_last(state.compact(spark, f"{path}/updates", f"{path}/compacted", ["node"], 1))


MICRO, SHARE = 3, 0.25


def memory_sql() -> str:
    """State after three batches, each one computed from the state before it."""
    ctes = [START, f"split AS (SELECT src, dst, ts, o.eid, f0, f1, ord * {MICRO} // (SELECT count(*) FROM ev) AS b FROM ev_ord o JOIN ef ON ef.eid = o.eid)",
            f"s0 AS (SELECT node, mem, 0::BIGINT AS mem_ts, {zeros_sql(MAIL)} AS mail, 0::BIGINT AS mail_ts FROM start)"]
    for k in range(MICRO):
        ends = " UNION ALL ".join(f"SELECT eid, {role} AS role, {end} AS node, ts, f0, f1 FROM split WHERE b = {k}" for role, end in enumerate(("src", "dst")))
        ctes += [
            f"""e{k} AS MATERIALIZED (SELECT e.*, list_transform(list_zip(coalesce(mem, {zeros_sql(MEM)}), coalesce(mail, {zeros_sql(MAIL)})[1:{MEM}]),
                lambda p: p[1] * {1 - SHARE} + p[2] * {SHARE}) AS new FROM ({ends}) e LEFT JOIN s{k} s ON s.node = e.node)""",
            f"m{k} AS (SELECT node, arg_max(new, (role, eid)) AS mem, arg_max(ts, (role, eid)) AS mem_ts FROM e{k} GROUP BY node)",
            f"""l{k} AS (SELECT a.node, arg_max(list_concat(list_concat(a.new, o.new), [CAST(a.f0 AS DOUBLE), CAST(a.f1 AS DOUBLE)]), (a.eid, a.role)) AS mail,
                arg_max(a.ts, (a.eid, a.role)) AS mail_ts FROM e{k} a JOIN e{k} o ON a.eid = o.eid AND o.role = 1 - a.role GROUP BY a.node)""",
            f"""s{k + 1} AS MATERIALIZED (SELECT coalesce(m.node, s.node) AS node, coalesce(m.mem, s.mem) AS mem, coalesce(m.mem_ts, s.mem_ts) AS mem_ts,
                coalesce(l.mail, s.mail) AS mail, coalesce(l.mail_ts, s.mail_ts) AS mail_ts
                FROM s{k} s FULL JOIN m{k} m ON m.node = s.node LEFT JOIN l{k} l ON l.node = m.node)"""]
    return f"WITH {', '.join(ctes)} SELECT node, {whole_sql('mem')} AS mem, mem_ts, {whole_sql('mail')} AS mail, mail_ts FROM s{MICRO}"


@query(memory_sql())
def node_memory_stream(spark, sf):
    """Memory and mailbox of every node, kept by a stream of three micro-batches and folded once."""
    path = new_path(spark, "memory")
    edges = dense_ordinal(event_edges(spark, sf).join(edge_features(spark, sf), "eid"), ["eid"])
    edges = freeze(edges.select("src", "dst", "ts", "eid", "feat", "ord"), "events-in-order")
    n = edges.count()
    for k in range(MICRO):
        # one file is one micro-batch
        edges.filter(F.floor(F.col("ord") * MICRO / n) == k).drop("ord").coalesce(1).write.mode("append").parquet(f"{path}/in")
    versioned.create(start_state(spark, sf), f"{path}/state", "node")
    stream = ingest.read_stream(spark, f"{path}/in", edges.drop("ord").schema, files_per_trigger=1)
    memory.node_memory_stream(stream, f"{path}/state", f"{path}/checkpoint", MEM, EDGE, memory.towards_mail(SHARE), compact_every=2).awaitTermination()
    return whole_state(versioned.read(spark, f"{path}/state", key="node"), "node")


RUN_STEPS, RUN_WINDOW = 3, 5 * DAY


@query(f"""WITH {SIZES}, z AS (SELECT p, (n - p) // {RUN_STEPS} AS size FROM n),
    run AS (SELECT * FROM (SELECT o.*, CASE WHEN ord < p THEN -1 ELSE (ord - p) // size END AS step FROM ev_ord o, z) WHERE step < {RUN_STEPS}),
    since AS (SELECT step, arg_min(ts, ord) - {RUN_WINDOW} AS since FROM run WHERE step >= 0 GROUP BY step),
    seen AS (SELECT s.step, id, row_number() OVER (PARTITION BY s.step ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY s.step) AS n
      FROM since s JOIN (SELECT dst AS id, min(step) AS first FROM run GROUP BY dst) d ON d.first <= s.step),
    asked AS (SELECT step, ord, 1 AS label, dst AS node FROM run WHERE step >= 0 UNION ALL
      SELECT r.step, r.ord, 0, id FROM run r JOIN seen s ON s.step = r.step AND s.idx = {sql_hash(str(SEED), "'dst'", 'r.ord')} % s.n),
    scored AS (SELECT a.step, a.label, (SELECT count(*) FROM run r WHERE r.dst = a.node AND r.step < a.step
        AND r.ts >= coalesce((SELECT since FROM since b WHERE b.step = a.step - 1), 0)) AS score FROM asked a),
    r AS (SELECT step, label, rank() OVER (PARTITION BY step ORDER BY score)
        + (count(*) OVER (PARTITION BY step, score) - 1) / 2 AS r,
        sum(label) OVER (PARTITION BY step) AS p, sum(1 - label) OVER (PARTITION BY step) AS n FROM scored),
    auc AS (SELECT step, (sum(CASE WHEN label = 1 THEN r END) - any_value(p) * (any_value(p) + 1) / 2)
      / (any_value(p) * any_value(n)) AS auc FROM r GROUP BY step),
    ap AS (SELECT step, sum(p * tp / total) / sum(p) AS ap FROM (SELECT step, p, sum(p) OVER w AS tp, sum(c) OVER w AS total
      FROM (SELECT step, score, sum(label) AS p, count(*) AS c FROM scored GROUP BY step, score)
      WINDOW w AS (PARTITION BY step ORDER BY score DESC)) GROUP BY step)
    SELECT step, round(auc, 9) AS auc, round(ap, 6) AS ap FROM auc JOIN ap USING (step)""")
def continuous_run(spark, sf):
    """Three steps of append, score, drop and replay, stopped after the first one and resumed."""
    path = new_path(spark, "run")
    ordered_rows = freeze(ordered(spark, sf), "ordered")
    steps = freeze(C.increments(ordered_rows, int(ordered_rows.count() * RATIO), RUN_STEPS), "run-steps")
    options = dict(window=RUN_WINDOW, replay=0.2, val=VAL, seed=SEED)
    runs.continuous_run(steps, path, stop_after=0, **options)
    runs.continuous_run(steps, path, **options)
    got = runs.results(spark, path, "metrics")
    return got.select(F.col("step").cast("bigint").alias("step"), F.round("auc", 9).alias("auc"), F.round("ap", 6).alias("ap"))
