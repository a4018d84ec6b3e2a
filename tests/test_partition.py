import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import partition as P

PARTS = 4


@pytest.fixture(scope="module")
def graph(spark):
    """300 edges over 60 nodes, a third of them from node 0."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < .33 else rng.randrange(60), rng.randrange(60), i, i, i) for i in range(300)]
    return spark.createDataFrame(rows, "src long, dst long, ts long, eid long, seq long")


def table(ptable):
    rows = ptable.collect()
    out = {r.node: r.pid for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("make", [
    P.partition_hash, P.partition_round_robin,
    lambda e, n, t=None: P.partition_balanced(e, n, ptable=t),
    lambda e, n, t=None: P.partition_balanced(e, n, "timestampsum", t),
    lambda e, n, t=None: P.partition_balanced(e, n, "timestampavg", t),
    lambda e, n, t=None: P.partition_fennel(e, n, rounds=2, ptable=t),
    lambda e, n, t=None: P.partition_fennel_edge(e, n, rounds=2, ptable=t)])
def test_every_source_once_and_sticky(graph, spark, make):
    first = spark.createDataFrame([(0, 3), (7, 1)], "node long, pid int")
    got = table(make(graph, PARTS, first))
    assert got[0] == 3 and got[7] == 1
    assert {r.src for r in graph.select("src").distinct().collect()} <= set(got) and set(got.values()) <= set(range(PARTS))


def test_balanced_without_hot_source(spark):
    edges = spark.range(400).select((F.col("id") % 100).alias("src"), F.col("id").alias("dst"), F.col("id").alias("ts"))
    got = table(P.partition_balanced(edges, PARTS))
    assert [list(got.values()).count(i) for i in range(PARTS)] == [25] * 4
    with pytest.raises(ValueError):
        P.partition_balanced(edges, PARTS, "weight")
    with pytest.raises(ValueError):
        P.partition_hash(edges, 0)


def test_fennel_capacity_holds(graph, spark):
    got = table(P.partition_fennel(graph, PARTS, upsilon=1.05, rounds=3))
    sizes = [list(got.values()).count(i) for i in range(PARTS)]
    assert max(sizes) <= 59 * 1.05 / PARTS + 1 and sum(sizes) == len(got)


def test_fennel_edge_limits_load(graph):
    got = table(P.partition_fennel_edge(graph, PARTS, rounds=4))
    loads = [0] * PARTS
    for r in graph.groupBy("src").count().collect():
        if r.src != 0:
            loads[got[r.src]] += r["count"]
    assert max(loads) <= 1.25 * 300 / PARTS + 12


def test_majority(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 12), (3, 99)], "src long, dst long")
    ptable = spark.createDataFrame([(10, 2), (11, 1), (12, 1)], "node long, pid int")
    assert table(P.assign_by_dst_majority(edges, ptable)) == {10: 2, 11: 1, 12: 1, 1: 1, 2: 1}


@pytest.mark.parametrize("sizes", [[4, 9, 0, 3], [5, 5, 5, 5], [1, 1, 1, 20], [7, 0, 0, 0]])
def test_equalize_follows_the_cascade(spark, sizes):
    rows, eid = [], 0
    lists = []
    for pid, n in enumerate(sizes):
        lists.append(list(range(eid, eid + n)))
        rows += [(e, pid) for e in lists[-1]]
        eid += n
    mean = sum(sizes) // PARTS
    order = sorted(range(PARTS), key=lambda i: (sizes[i], i))
    for at in range(PARTS - 1, 0, -1):
        here, below = order[at], order[at - 1]
        lists[below] = lists[below] + lists[here][mean:]
        lists[here] = lists[here][:mean]
    lists[order[0]] = lists[order[0]][:mean]
    even = P.equalize(spark.createDataFrame(rows, "eid long, pid int"), PARTS)
    got = {}
    for r in even.orderBy("pos").collect():
        got.setdefault(r.new_pid, []).append(r.eid)
    assert got == {i: v for i, v in enumerate(lists) if v}
    dealt = P.interleave_workers(even, 2).collect()
    assert len(dealt) == PARTS * (mean - mean % 2)
    assert all(r.worker == r.pos % 2 for r in dealt)


def test_placement_and_stats(graph, spark):
    ptable = P.partition_round_robin(graph, PARTS)
    placed = P.dispatch_by_source(graph, ptable)
    got = table(ptable)
    assert all(r.pid == got[r.src] for r in placed.collect())
    stats = P.partition_edge_stats(placed, PARTS).collect()
    assert sum(r.num_edges for r in stats) == 300
    nodes = P.partition_nodes_stats(spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node long, pid int"), 3).collect()
    assert [r.num_nodes for r in nodes] == [2, 1, 0] and nodes[0].load_factor == 2.0
    owners = P.place_edge_features(graph.select("eid", F.lit(1.0).alias("x")), graph, ptable)
    assert {r.eid: r.pid for r in owners.collect()} == {r.eid: got[r.src] for r in graph.collect()}
    rest = table(P.assign_residual(spark.range(70).select(F.col("id").alias("node")), ptable, PARTS))
    assert len(rest) == 70


def test_edge_cut(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "src long, dst long")
    ptable = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, pid int")
    assert tuple(P.edge_cut(edges, ptable).first()) == (1, 2, 50.0)
    assert P.edge_cut(edges, ptable, skip_unassigned=False).first().cut == 2


def test_balanced_continues_from_earlier_loads(spark):
    """60 sources already in partition 0 of 4: the 40 new ones go to the others."""
    edges = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1000).alias("dst"), F.lit(1).cast("long").alias("ts"))
    held = spark.range(60).select(F.col("id").alias("node"), F.lit(0).alias("pid"))
    got = P.partition_balanced(edges, 4, ptable=held).groupBy("pid").count().collect()
    assert sorted((r.pid, r["count"]) for r in got) == [(0, 60), (1, 14), (2, 13), (3, 13)]


def test_more_partitions_than_a_byte_holds(spark):
    edges = spark.range(1000).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("id").alias("ts"))
    assert P.partition_round_robin(edges, 500).groupBy("pid").count().count() == 500


@pytest.mark.parametrize("run", [
    lambda e, n: P.fennel_round(e, P.partition_hash(e.filter("src % 2 = 0"), n), n),
    lambda e, n: P.fennel_edge_round(e, P.partition_hash(e.filter("src % 2 = 0"), n), n),
    lambda e, n: P.partition_fennel(e, n, rounds=2),
    lambda e, n: P.partition_fennel_edge(e, n, rounds=2)])
def test_thousands_of_partitions(graph, run):
    """Plans and choices need no column per partition."""
    got = table(run(graph, 2_000))
    assert got and set(got.values()) <= set(range(2_000))
