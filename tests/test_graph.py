import pytest
from frames import rows
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidegraph.operators import graph as G

# The literal tables and expected rows below are fixed values.


def newest(edges, node, spark):
    got = G.temporal_neighbors(edges, spark.createDataFrame([(node,)], "node long")).orderBy("slot").collect()
    return [r.dst for r in got], [r.ts for r in got], [r.eid for r in got]


def counts(edges):
    return {r.metric: r.value for r in G.graph_counts(edges).collect()}


def degrees(edges, spark, ids):
    got = {r.node: r.degree for r in G.out_degree(edges, spark.createDataFrame([(i,) for i in ids], "node long")).collect()}
    return [got[i] for i in ids]


def test_directed(small, spark):
    assert counts(small) == {"num_vertices": 4, "num_source_vertices": 3, "num_edges": 9, "max_vertex_id": 3}
    assert degrees(small, spark, [0, 1, 2, 3]) == [3, 3, 3, 0]
    assert newest(small, 0, spark)[0] == [3, 2, 1]


def test_reversed(small, spark):
    both = G.add_reverse(small)
    assert G.num_edges(both) == 9
    assert degrees(both, spark, [0, 1, 2, 3]) == [3, 6, 6, 3]
    assert newest(both, 1, spark) == ([3, 2, 2, 1, 0, 1], [2, 1, 0, 0, 0, 0], [5, 4, 6, 3, 0, 3])
    dst, _, eid = newest(both, 2, spark)
    assert (dst, eid) == ([3, 2, 1, 0, 2, 1], [8, 7, 4, 1, 7, 6])
    dst, _, eid = newest(both, 3, spark)
    assert (dst, eid) == ([2, 1, 0], [8, 5, 2])


def test_unsorted_input(edges_of, spark):
    edges = edges_of([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3], [2, 1, 0, 2, 1, 0, 2, 1, 0])
    assert newest(edges, 0, spark) == ([1, 2, 3], [2, 1, 0], [0, 1, 2])


def test_append_numbers_and_retention(edges_of, spark):
    first = edges_of([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3], [0, 1, 2, 0, 1, 2, 0, 1, 2], list(range(0, 18, 2)))
    later = edges_of([0, 0, 0, 1, 1, 1, 2, 2, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3], [3, 4, 5, 3, 4, 5, 3, 4, 5], list(range(17, 34, 2)))
    graph = G.append_edges(first, later)
    assert counts(graph)["num_edges"] == 18
    kept = G.retain_since(graph, 3.5)
    assert counts(kept)["num_edges"] == 6 and counts(kept)["num_vertices"] == 4
    assert newest(kept, 0, spark) == ([3, 2], [5, 4], [21, 19])


def test_missing_ids_continue(small):
    graph = G.append_edges(None, small.select("src", "dst", "ts"))
    assert sorted(r.eid for r in graph.collect()) == list(range(9))
    graph = G.append_edges(graph, small.select("src", "dst", "ts"), reverse=True)
    assert sorted({r.eid for r in graph.collect()}) == list(range(18))
    assert graph.count() == 27


def test_same_time_keeps_insert_order_across_batches(edges_of, spark):
    graph = G.append_edges(edges_of([0], [1], [5]), edges_of([0], [2], [5], [9]))
    assert newest(graph, 0, spark)[0] == [2, 1]


def test_validation(small, spark):
    with pytest.raises(ValueError):
        G.validate_edges(small.drop("ts"))
    with pytest.raises(ValueError):
        G.validate_edges(small.filter("src > 99"))
    bad = small.withColumn("dst", F.when(F.col("eid") != 4, F.col("dst")))
    with pytest.raises(SparkRuntimeException):
        G.validate_edges(bad).collect()


def test_sort_order_and_files(small, spark, tmp_path):
    G.write_graph(G.add_reverse(small), str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g"))
    assert back.count() == 18
    got = rows(G.temporal_sort(small), "src", "ts", "seq")
    assert got == sorted(got)


def test_bucketed_table(small, spark):
    G.write_bucketed(small, "bucketed_edges", 4)
    back = spark.table("bucketed_edges")
    plan = back.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 9 and "Exchange" not in plan
    spark.sql("DROP TABLE bucketed_edges")


def test_archive(small, tmp_path, spark):
    path = str(tmp_path / "old")
    kept = G.archive_before(small, 1, path, unit=1)
    assert kept.count() == 6
    assert G.restore_archive(kept, path).count() == 9
    assert G.restore_archive(kept, path, since=1, unit=1).count() == 6


def test_batch_stats(small):
    chunked = small.withColumn("chunk", F.floor(F.col("eid") / 6))
    got = {r.chunk: (r.num_edges, r.num_nodes) for r in G.edges_per_batch_stats(chunked).collect()}
    assert got == {0: (6, 4), 1: (3, 3)}


def test_neighbors_match_recomputation(spark, sf):
    from tidegraph.queries.common import event_edges
    edges = event_edges(spark, sf)
    frame = edges.toPandas().sort_values(["ts", "seq"], ascending=False)
    want = frame.groupby("src").eid.apply(list).to_dict()
    for strategy in ("plain", "ranged"):
        got = G.temporal_neighbors(edges, G.src_nodes(edges), strategy).toPandas().sort_values("slot")
        assert got.groupby("node").eid.apply(list).to_dict() == want


def test_archives_are_safe_to_repeat(small, spark, tmp_path):
    path = str(tmp_path / "archive")
    assert G.restore_archive(small, path).count() == 9          # nothing archived yet
    kept = G.archive_before(small, -1, path)
    assert kept.count() == 9 and G.restore_archive(kept, path).count() == 9
    for _ in range(2):
        kept = G.archive_before(small, 1, path, unit=1)
    G.archive_before(kept, 1, path, unit=1)                      # nothing is old any more
    assert kept.count() == 6 and G.restore_archive(kept, path).count() == 9
    later = G.archive_before(kept, 2, path, unit=1)
    assert later.count() == 3 and G.restore_archive(later, path).count() == 9


def test_known_counters(small):
    more = small.drop("eid", "seq")
    read = G.append_edges(small, more, ("src", "ts", "dst"))
    told = G.append_edges(small, more, ("src", "ts", "dst"), known=(9, 8))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, told.collect()))
