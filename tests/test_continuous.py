import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegraph.operators import continuous as C
from tidegraph.plans.ordering import dense_ordinal
from tidegraph.queries.common import edges_from_events, event_edges, table
from tidegraph.streaming import ingest, state


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(103).select((F.col("id") % 7).alias("src"), (F.col("id") % 5).alias("dst"),
                                   (F.col("id") * 10).alias("ts"), F.col("id").alias("eid"), F.col("id").alias("seq"))


def test_phases(line):
    got = {r.phase: r["count"] for r in C.phase_split(line, 0.3, 0.1).groupBy("phase").count().collect()}
    assert got == {"phase1_train": 28, "phase1_val": 2, "phase2": 73}


def test_increments_leave_the_tail(line):
    got = {r.step: r["count"] for r in C.increments(line, 30, 10).groupBy("step").count().collect()}
    assert got == {-1: 30} | {i: 7 for i in range(10)}


def test_replay(line):
    ordered = dense_ordinal(line, ["eid"])
    rows = C.retrain_rows(ordered, 5, 30, 37, 0.5, 1).orderBy("place").collect()
    assert [r.ord for r in rows[15:]] == list(range(30, 37))
    old = [r.ord for r in rows[:15]]
    assert old == sorted(old) and min(old) >= 5 and max(old) < 30
    parts = C.ordered_train_val(C.retrain_rows(ordered, 5, 30, 37, 0.5, 1), 0.1).filter("part = 'train'").count()
    assert parts == int(22 * .9) + 1


def test_sliding_retention(line):
    stepped = C.increments(line, 30, 10)
    got = C.sliding_retention(stepped, 2, 100).agg(F.min("ts"), F.max("ts")).first()
    assert tuple(got) == ((30 + 14) * 10 - 100, (30 + 21 - 1) * 10)


def test_prequential_scores_only_with_the_past(line, spark):
    stepped = C.increments(line, 30, 10)
    pool = spark.createDataFrame([(0, 100), (1, 101)], "idx long, id long")
    scored = C.popularity_scorer(pool, 1)(stepped)
    seen = {r.ord: r.score for r in scored.filter("label = 1").collect()}
    assert all(seen[o] == len([i for i in range(30 + (o - 30) // 7 * 7) if i % 5 == o % 5]) for o in seen)
    got = C.prequential(stepped, C.popularity_scorer(pool, 1)).collect()
    assert len(got) == 10 and all(r.auc == 1.0 and r.ap == 1.0 for r in got)


@pytest.fixture()
def stream_dir(spark, sf, tmp_path):
    """The events in four files, in time order."""
    events = table(spark, sf, "events").toPandas().sort_values("event_id")
    schema = table(spark, sf, "events").schema
    path = tmp_path / "in"
    for i in range(4):
        part = events.iloc[i * 250:(i + 1) * 250]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), schema


def run(spark, fn):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    try:
        query = fn()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(key, before)


def test_recent_state_equals_batch(spark, sf, stream_dir, tmp_path):
    path, schema = stream_dir
    stream = edges_from_events(ingest.read_stream(spark, path, schema, files_per_trigger=1))
    run(spark, lambda: state.write_updates(state.recent_neighbors_state(stream, 3, salts=3), f"{tmp_path}/u", f"{tmp_path}/c"))
    got = state.merge_recent(spark.read.parquet(f"{tmp_path}/u"), 3)
    frame = event_edges(spark, sf).toPandas().sort_values(["ts", "seq"], ascending=False)
    want = frame.groupby("src").eid.apply(lambda s: list(s)[:3]).to_dict()
    assert got.toPandas().sort_values("slot").groupby("node").eid.apply(list).to_dict() == want
    assert spark.read.parquet(f"{tmp_path}/u").select("batch").distinct().count() == 4


def test_recent_read_from_the_state_itself(spark, stream_dir, tmp_path):
    """At two batches, what the state store holds equals the updates stored up to there."""
    path, schema = stream_dir
    stream = edges_from_events(ingest.read_stream(spark, path, schema, files_per_trigger=1))
    run(spark, lambda: state.write_updates(state.recent_neighbors_state(stream, 3, salts=3), f"{tmp_path}/u", f"{tmp_path}/c"))
    updates = spark.read.parquet(f"{tmp_path}/u")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    try:
        for batch_id in (1, 3, None):
            seen = updates if batch_id is None else updates.filter(F.col("batch") <= batch_id)
            want = sorted(map(tuple, state.merge_recent(seen, 3).collect()))
            assert sorted(map(tuple, state.recent_at(spark, f"{tmp_path}/c", 3, batch_id).collect())) == want and want
    finally:
        spark.conf.set(key, before)


def test_last_state_equals_batch(spark, sf, stream_dir, tmp_path):
    path, schema = stream_dir
    stream = edges_from_events(ingest.read_stream(spark, path, schema, files_per_trigger=2))
    run(spark, lambda: state.write_updates(state.node_state_stream(stream, 100), f"{tmp_path}/u", f"{tmp_path}/c"))
    got = {r.node: r.eid for r in state.merge_last(spark.read.parquet(f"{tmp_path}/u")).collect()}
    want = {}
    for e in event_edges(spark, sf).collect():
        for node, pos in ((e.src, e.eid % 100), (e.dst, e.eid % 100 + 100)):
            want[node] = max(want.get(node, (-1,)), (e.eid // 100, pos, e.eid))
    assert got == {n: v[2] for n, v in want.items()}
    compacted = state.compact(spark, f"{tmp_path}/u", f"{tmp_path}/z", ["node"], 0)
    assert {r.node: r.eid for r in state.merge_last(compacted).collect()} == got


def test_ingest_drops_duplicates_and_late_rows(spark, tmp_path):
    def batch(rows):
        (spark.createDataFrame(rows, "src long, dst long, ts long, eid long")
         .withColumn("event_time", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"))
    batch([(1, 2, 1000, 0), (1, 2, 1000, 0), (1, 3, 2000, 1)])
    batch([(1, 3, 2000, 1), (2, 3, 5000, 2)])
    batch([(9, 9, 100, 3), (2, 4, 5001, 4)])
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = ingest.read_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    late = ingest.LateRows()
    spark.streams.addListener(late)
    try:
        query = ingest.stream_edges(ingest.drop_late(stream, "10 seconds"), f"{tmp_path}/graph", f"{tmp_path}/c")
        query.awaitTermination()
        rows = ingest.read_graph(spark, f"{tmp_path}/graph").orderBy("seq").collect()
        assert [r.eid for r in rows] == [0, 1, 2, 4]
        for _ in range(100):  # the listener is told afterwards
            if late.of(query):
                break
            time.sleep(0.1)
        assert late.of(query) == 1
    finally:
        spark.streams.removeListener(late)


def test_last_k_of_edges_without_numbers(spark):
    """Null numbers are the oldest and stay null."""
    class Kept:
        value = []
        def get(self): return iter(self.value)  # noqa: E704
        def put(self, value): self.value = value  # noqa: E704

    names = ("node", "ts", "seq", "dst", "eid", "salt")
    processor = state.RecentNeighbors(2, None)
    processor.kept = Kept()
    rows = [Row(**dict(zip(names, v))) for v in ((7, 5, 1, None, None, 0), (7, None, 2, 3, 4, 0), (7, 5, None, 8, 9, 0))]
    for part in (rows[:2], rows[2:]):
        got = list(processor.handleInputRows((7, 0), iter(part), None))
    assert [tuple(r) for r in got] == [(7, 0, 5, 1, None, None), (7, 0, 5, None, 8, 9)]
