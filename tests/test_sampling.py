import re
import pytest
from frames import rows
from pyspark.sql import functions as F

from tidegraph.operators import graph as G
from tidegraph.operators import sampling as S

BOTH = pytest.mark.parametrize("strategy", ["plain", "ranged"])

# The literal tables and expected rows below are fixed values.


def block_rows(samples, roots):
    edges, front = S.to_block(samples, roots)
    got = edges.orderBy("col").collect()
    counts = S.block_counts(edges, front).first()
    return got, counts


@BOTH
def test_one_hop_recent(small, roots_of, strategy):
    roots = roots_of([0, 1, 2], 1.5)
    got, counts = block_rows(S.sample_recent(S.rank_edges(small, strategy=strategy), roots, 2,
                                             strategy=strategy), roots)
    assert [r.src_node for r in got] == [2, 1, 2, 1, 2, 1]
    assert [r.edge_ts for r in got] == [1, 0, 1, 0, 1, 0]
    assert [r.dt for r in got] == [.5, 1.5, .5, 1.5, .5, 1.5]
    assert [r.eid for r in got] == [1, 0, 4, 3, 7, 6]
    assert [r.row for r in got] == [0, 0, 1, 1, 2, 2]
    assert [r.col for r in got] == [3, 4, 5, 6, 7, 8]
    assert tuple(counts) == (3, 9, 6)


def test_duplicate_roots(small, roots_of):
    roots = roots_of([0, 1, 2, 0], 1.5)
    got, _ = block_rows(S.sample_recent(S.rank_edges(small), roots, 2), roots)
    assert [r.eid for r in got] == [1, 0, 4, 3, 7, 6, 1, 0]
    assert [r.row for r in got] == [0, 0, 1, 1, 2, 2, 3, 3]


@BOTH
def test_two_hops(small, roots_of, strategy):
    roots = roots_of([0, 1, 2], 1.5)
    outer, inner = S.sample_multi_hop(small, roots, [2, 2], strategy=strategy)
    got, _ = block_rows(inner, roots)
    assert [r.eid for r in got] == [1, 0, 4, 3, 7, 6]
    got, counts = block_rows(outer, S.frontier(roots, inner, 2, 3))
    assert [r.src_node for r in got] == [2, 1, 2, 1, 2, 1, 1, 1, 1]
    assert [r.dt for r in got] == [.5, 1.5, .5, 1.5, .5, 1.5] + [1, 1, 1]
    assert [r.eid for r in got] == [1, 0, 4, 3, 7, 6, 6, 6, 6]
    assert [r.row for r in got] == [0, 0, 1, 1, 2, 2, 3, 5, 7]
    assert tuple(counts) == (9, 18, 9)


@BOTH
def test_uniform_counts(small, roots_of, strategy):
    roots = roots_of([0, 1, 2, 7], 3)
    got, counts = block_rows(S.sample_uniform(S.rank_edges(small, strategy=strategy), roots, 2,
                                              strategy=strategy), roots)
    assert tuple(counts) == (4, 10, 6)
    again, _ = block_rows(S.sample_uniform(S.rank_edges(small), roots, 2), roots)
    assert got == again


def test_after_retention(small, edges_of, roots_of):
    later = edges_of([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3], [3, 4, 5, 3, 4, 5, 3, 4, 5]).drop("eid", "seq")
    graph = G.append_edges(small, later, order_by=["src", "ts"])
    kept = S.rank_edges(G.retain_since(graph, 3.5))
    assert S.sample_recent(kept, roots_of([0, 1, 2], 1.5), 2).count() == 0
    roots = roots_of([0, 1, 2], 4.5)
    got, _ = block_rows(S.sample_recent(kept, roots, 2), roots)
    assert [r.src_node for r in got] == [2, 2, 2]
    assert [r.edge_ts for r in got] == [4, 4, 4]
    assert [r.dt for r in got] == [.5, .5, .5]
    assert [r.eid for r in got] == [10, 13, 16]
    assert [r.row for r in got] == [0, 1, 2]


@BOTH
def test_snapshots_one_and_two_hops(edges_of, roots_of, strategy):
    edges = edges_of([0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2], [1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6], [0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5])
    roots = roots_of([0, 1, 2], 5)
    outer, inner = S.sample_multi_hop(edges, roots, [2, 2], snapshots=2, window=1, strategy=strategy)
    for snapshot, node, eids, dt in ((1, 5, [4, 10, 16], 1), (0, 4, [3, 9, 15], 2)):
        first = inner.filter(F.col("snapshot") == snapshot)
        got, _ = block_rows(first, roots)
        assert [r.src_node for r in got] == [node] * 3
        assert [r.eid for r in got] == eids
        assert [r.dt for r in got] == [dt] * 3
        got, counts = block_rows(outer.filter(F.col("snapshot") == snapshot),
                                 S.frontier(roots, inner, 2, 3, snapshot))
        assert [r.eid for r in got] == eids
        assert [r.row for r in got] == [0, 1, 2]
        assert tuple(counts)[:2] == (6, 9)


def test_uniform_in_windows(edges_of, roots_of):
    edges = edges_of([0] * 6, [1, 2, 3, 4, 5, 6], range(6))
    ranked = S.rank_edges(edges, 2, 2)
    got = S.sample_uniform(ranked, roots_of([0, 9], 5), 20, window=2, snapshots=2)
    assert {(r.snapshot, r.edge_ts) for r in got.collect()} == {(1, 3.0), (1, 4.0), (0, 1.0), (0, 2.0)}
    assert got.count() == 40


def test_uniform_snapshots_hop_by_hop(edges_of, roots_of):
    """A later hop probes one window at a time and must draw what probing all windows would."""
    edges = edges_of([0] * 6 + [1] * 6, [1, 0] * 6, list(range(6)) * 2)
    roots = roots_of([0, 1], 6)
    outer, inner = S.sample_multi_hop(edges, roots, [3, 3], "uniform", snapshots=2, window=2, seed=5)
    ranked = S.rank_edges(edges, 2, 2)
    for snapshot in (0, 1):
        want = S.sample_layer(ranked, S.frontier(roots, inner, 3, 2, snapshot), 3, "uniform", 1, snapshot, 2, 2, 5)
        assert set(outer.filter(F.col("snapshot") == snapshot).collect()) == set(want.collect())
        assert want.count() > 6


def test_prop_time_and_layer(small, roots_of):
    ranked = S.rank_edges(small)
    got = S.sample_layer(ranked, roots_of([0], 1.5), 2, prop_time=True)
    assert {r.out_ts for r in got.collect()} == {1.5}
    assert {r.hop for r in S.sample_layer(ranked, roots_of([0], 1.5), 2, hop=3).collect()} == {3}
    with pytest.raises(ValueError):
        S.sample_layer(ranked, roots_of([0], 1.5), 2, how="newest")


def test_static_uses_whole_history(small, roots_of):
    got = S.sample_static(small, roots_of([0, 1], 0), 2)
    assert sorted(r.eid for r in got.collect()) == [1, 2, 4, 5]
    assert S.sample_static(small, roots_of([0, 1], 0), 5, "uniform").count() == 10


def test_negative_times_never_match_without_window(edges_of, roots_of):
    edges = edges_of([0, 0], [1, 2], [-2, -1])
    assert S.sample_recent(S.rank_edges(edges), roots_of([0], 1), 5).count() == 0
    assert S.sample_recent(S.rank_edges(edges, window=5), roots_of([0], 1), 5, window=5).count() == 2


def test_ties_newest_insert_first(edges_of, roots_of):
    got = S.sample_recent(S.rank_edges(edges_of([0] * 4, [1, 2, 3, 4], [1, 1, 1, 2])), roots_of([0], 2), 2)
    assert [r.src_node for r in got.orderBy("slot").collect()] == [3, 2]


@pytest.mark.parametrize("size", [0, 10, 40])
def test_batch_sizes(small, roots_of, size):
    got = S.sample_recent(S.rank_edges(small), roots_of([i % 4 for i in range(size)], 1.5), 2)
    assert got.count() == 2 * sum(i % 4 < 3 for i in range(size))


def test_partitioned(small, roots_of, spark, tmp_path):
    """Only the folders of the owners asked for are read."""
    from tidegraph.sources import io
    ptable = spark.createDataFrame([(0, 0), (1, 1), (5, 2)], "node long, pid int")
    path = str(tmp_path / "owned")
    io.write_partitioned_edges(small.unionByName(small.withColumn("src", F.lit(5).cast("long"))), ptable, path)
    found, placed = S.sample_partitioned(spark, path, roots_of([2, 1, 0], 1.5), ptable, 2)
    assert sorted(set(rows(found, "rid", "pid"))) == [(1, 1), (2, 0)]
    assert sorted(rows(found, "rid", "slot", "eid")) == [(1, 0, 4), (1, 1, 3), (2, 0, 1), (2, 1, 0)]
    assert placed.count() == 3
    assert re.search(r"PartitionFilters: \[[^]]*pid#\d+ IN \([01],[01]\)", found._jdf.queryExecution().executedPlan().toString())
    none, _ = S.sample_partitioned(spark, path, roots_of([9], 1.5), ptable, 2)
    assert none.count() == 0


def test_bucketed_edges_are_not_shuffled(spark, edges_of, roots_of):
    from tidegraph.operators import graph as G
    n = 400
    edges = edges_of([i % 7 for i in range(n)], [i % 11 for i in range(n)], [i // 3 for i in range(n)])
    G.write_bucketed(edges, "bucketed_for_sampling", 4)
    try:
        roots = roots_of([i % 8 for i in range(60)], [float(2 * i) for i in range(60)])
        want = sorted(rows(S.sample_recent(edges, roots, 3), "rid", "slot", "eid"))
        got = S.sample_bucketed(spark, "bucketed_for_sampling", roots, 3)
        assert sorted(rows(got, "rid", "slot", "eid")) == want and len(want) > 100
        # the only exchange is that of the roots
        plan = S.sample_bucketed(spark, "bucketed_for_sampling", roots, 3, strategy="plain")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "REPARTITION_BY_NUM" in plan
        shuffled = S.sample_recent(spark.table("bucketed_for_sampling"), roots, 3, strategy="plain")._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" in shuffled
    finally:
        spark.sql("DROP TABLE bucketed_for_sampling")


@pytest.mark.parametrize("how", ["recent", "uniform"])
def test_shared_questions_answer_everyone(spark, edges_of, how):
    """Many roots that ask the same: later hops answer as if each had asked alone."""
    edges = edges_of([i % 5 for i in range(60)], [(i * 3) % 5 for i in range(60)], [i // 2 for i in range(60)])
    roots = spark.createDataFrame([(i, i % 2, 25.0) for i in range(30)], "rid long, node long, ts double")
    outer, inner = S.sample_multi_hop(edges, roots, [3, 3], how, seed=4)
    front = S.frontier(roots, inner, 3, 30)
    source = S.rank_edges(edges) if how == "uniform" else edges
    want = S.sample_layer(source, front, 3, how, 1, seed=4)
    assert sorted(map(tuple, outer.collect())) == sorted(map(tuple, want.collect())) and outer.count() > 300


def test_plain_equals_ranged_with_one_hot_source(spark, monkeypatch):
    """A third of all edges and roots on one source, many equal times."""
    edges = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("long").alias("src"),
        F.col("id").alias("dst"), (F.col("id") % 17).alias("ts"), F.col("id").alias("eid"),
        F.col("id").alias("seq"))
    roots = edges.select(F.col("eid").alias("rid"), F.col("src").alias("node"), "ts")
    def run(strategy, **options):
        return set(map(tuple, S.sample_recent(edges, roots, 5, strategy=strategy, **options).collect()))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.tidegraph.maxGroupRows", "100")
    try:
        results = [run("plain"), run("ranged"), run("auto")]
        monkeypatch.setattr(S, "MAX_LAGS", 0)
        results += [run("plain"), run("ranged")]
        uniform = [set(map(tuple, S.sample_uniform(S.rank_edges(edges, strategy=s), roots, 5, strategy=s).collect()))
                   for s in ("plain", "ranged")]
    finally:
        spark.conf.unset("spark.tidegraph.maxGroupRows")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(results[0]) > 20000 and all(r == results[0] for r in results)
    assert uniform[0] == uniform[1] and len(uniform[0]) > 20000


def test_boundary_with_few_edges_and_many_roots(spark, monkeypatch):
    """Whole partitions of roots: what came before must be carried across several of them."""
    edges = spark.createDataFrame([(0, i, i, i, i) for i in range(7)], "src long, dst long, ts long, eid long, seq long")
    roots = spark.range(4000).select(F.col("id").alias("rid"), F.lit(0).cast("long").alias("node"),
                                     (F.col("id") % 9).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [set(map(tuple, S.sample_recent(edges, roots, 3, strategy=s).collect())) for s in ("plain", "ranged")]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] and len(got[0]) > 9000


def test_compare_windows(small, roots_of):
    got = S.compare_windows(small, roots_of([0], 2), 5, [0, 1, 2])
    assert sorted(rows(got, "snapshot", "edge_ts")) == [(0, 0.0), (0, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


@pytest.mark.parametrize("k", [3, 32, 33])
def test_split_plan_equals_the_others(spark, sf, k):
    """Hot sources ranged, the rest plain: the same rows, on either side of the lag limit."""
    from tidegraph.queries.common import event_edges, event_roots
    edges, roots = event_edges(spark, sf), event_roots(spark, sf)
    found = {}
    for name, limit in (("plain", None), ("ranged", None), ("auto", "12")):
        if limit:
            spark.conf.set("spark.tidegraph.maxGroupRows", limit)
        try:
            rows = S.sample_recent(edges, roots, k, strategy=name).select("rid", "slot", "eid").collect()
        finally:
            spark.conf.unset("spark.tidegraph.maxGroupRows")
        found[name] = sorted(map(tuple, rows))
    assert found["plain"] == found["ranged"] == found["auto"]


@pytest.mark.parametrize("how", ["recent", "uniform"])
def test_answers_are_not_shuffled(edges_of, roots_of, how):
    """Chosen edges leave where their node's edges are: after the one shuffle by node nothing is exchanged."""
    edges, roots = edges_of([0] * 60, range(60), range(60)), roots_of([0, 0], [50, 70])
    got = S.sample_recent(edges, roots, 40, strategy="plain") if how == "recent" else \
        S.sample_uniform(S.rank_edges(edges, strategy="plain"), roots, 4, window=9, strategy="plain")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    assert got.count() == (80 if how == "recent" else 4)


def test_many_questions_of_one_node_meet_in_parts(spark, edges_of, roots_of):
    edges, roots = edges_of([0] * 60 + [1] * 3, range(63), range(63)), roots_of([0] * 300 + [1] * 9, [50] * 200 + [70] * 109)
    want = set(map(tuple, S.sample_recent(edges, roots, 40, strategy="plain").collect()))
    spark.conf.set("spark.tidegraph.maxGroupRows", "100")
    try:
        assert set(map(tuple, S.sample_recent(edges, roots, 40).collect())) == want and len(want) == 300 * 40 + 9 * 3
    finally:
        spark.conf.unset("spark.tidegraph.maxGroupRows")


def test_uniform_windows_with_edges_without_a_time(spark, roots_of):
    """An edge without a time is in no window, and has none of its own."""
    edges = spark.createDataFrame([(0, 1, None, 0, 0), (0, 2, 5, 1, 1)], "src long, dst long, ts long, eid long, seq long")
    roots = roots_of([0], 7).withColumn("ts", F.col("ts").cast("long"))
    got = S.sample_uniform(S.rank_edges(edges, 2, 3), roots, 4, window=3, snapshots=2).collect()
    assert [(r.snapshot, r.eid) for r in got] == [(1, 1)] * 4
