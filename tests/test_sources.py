import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from tidegraph.schema import PRESETS
from tidegraph.sources import io


def test_edge_csv(spark, tmp_path):
    (tmp_path / "edges.csv").write_text(",src,dst,time,ext_roll\n0,1,2,0.0,0\n1,1,3,5.5,1\n2,2,3,9.0,2\n")
    edges = io.read_edges(spark, str(tmp_path / "edges.csv"))
    assert rows(edges, "src", "dst", "ts", "eid") == [(1, 2, 0.0, 0), (1, 3, 5.5, 1), (2, 3, 9.0, 2)]
    assert {k: v.count() for k, v in io.split_by_roll(edges).items()} == {"train": 1, "val": 1, "test": 1}


def test_edge_csv_by_name(spark, tmp_path):
    """Columns in another order, and one that isn't asked for."""
    (tmp_path / "e.csv").write_text(",dst,src,time,int_roll,ext_roll\n0,2,1,0.0,7,0\n1,3,1,5.5,7,2\n")
    edges = io.read_edges(spark, str(tmp_path / "e.csv"))
    assert rows(edges, "src", "dst", "ts", "eid", "ext_roll") == [(1, 2, 0.0, 0, 0), (1, 3, 5.5, 1, 2)]
    (tmp_path / "bad.csv").write_text(",src,dst,time\n0,1,2,0.0\n")
    with pytest.raises(ValueError):
        io.read_edges(spark, str(tmp_path / "bad.csv"))


def test_chunks(small):
    got = dict(rows(io.edge_chunks(small, 4, 2), "eid", "chunk"))
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3}


def test_shards_are_pruned(small, spark, tmp_path):
    path = str(tmp_path / "shards")
    io.write_edge_shards(small.withColumn("split", F.lit("train")), path, 2)
    shard = io.read_edge_shard(spark, path, 1, "train")
    assert sorted(r.eid for r in shard.collect()) == [1, 3, 5, 7]
    assert "PartitionFilters: [isnotnull" in shard._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(ValueError):
        io.read_edge_shard(spark, path, 0, "all")


def test_matrix_file(spark, tmp_path):
    matrix = np.arange(35, dtype=np.float16).reshape(7, 5)
    np.save(tmp_path / "f.npy", matrix)
    got = io.read_matrix(spark, str(tmp_path / "f.npy")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(7)) and [r.feat for r in got] == matrix.astype(float).tolist()
    # row-split parts, and files that are no part
    for part, name in ((matrix[:3], "m0.npy"), (matrix[3:3], "m1.npy"), (matrix[3:], "m2.npy")):
        (tmp_path / "parts").mkdir(exist_ok=True)
        np.save(tmp_path / "parts" / name, part)
    (tmp_path / "parts" / "note.txt").write_text("no part")
    got = io.read_matrix(spark, str(tmp_path / "parts")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(7)) and [r.feat for r in got] == matrix.astype(float).tolist()


def test_features_are_optional_and_cast(spark, tmp_path):
    spark.createDataFrame([(0, [True, False])], "id long, feat array<boolean>").write.parquet(str(tmp_path / "e"))
    nodes, edges = io.read_features(spark, edge=str(tmp_path / "e"))
    assert nodes is None and edges.first().feat == [1.0, 0.0] and edges.columns == ["eid", "feat"]


def test_partition_table_is_optional(spark, tmp_path):
    assert io.read_partition_table(spark, None) is None
    assert io.read_partition_table(spark, str(tmp_path / "none")) is None
    spark.createDataFrame([(0, 1), (1, -1)], "node long, pid int").write.parquet(str(tmp_path / "pt"))
    assert rows(io.read_partition_table(spark, str(tmp_path / "pt")), "node", "pid") == [(0, 1)]


def test_partitioned_edges(small, spark, tmp_path):
    ptable = spark.createDataFrame([(0, 0), (1, 1)], "node long, pid int")
    io.write_partitioned_edges(small, ptable, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(rows(back.filter("pid = 1"), "eid")) == [(3,), (4,), (5,)]


def test_state_versions(spark, tmp_path):
    state = spark.createDataFrame([(1, [1.0], 5, [2.0, 2.0], 6)],
                                  "node long, mem array<double>, mem_ts long, mail array<double>, mail_ts long")
    io.snapshot_state(state, str(tmp_path), 1)
    io.snapshot_state(state.withColumn("mem_ts", F.lit(9).cast("long")), str(tmp_path), 2)
    assert [io.restore_state(spark, str(tmp_path), v).first().mem_ts for v in (1, 2)] == [5, 9]


def test_state_of_double_times(spark, tmp_path):
    state = spark.createDataFrame([(1, [float("nan"), float("inf")], 5.5, [-2.0], 6.5)],
                                  "node long, mem array<double>, mem_ts double, mail array<double>, mail_ts double")
    io.snapshot_state(state, str(tmp_path), 1)
    assert io.restore_state(spark, str(tmp_path), 1).first().mem_ts == 5.5
    from tidegraph.operators.state import reset_state
    assert str(tuple(reset_state(state).first())) == "(1, [0.0, 0.0], 0.0, [0.0], 0.0)"


def test_presets():
    assert PRESETS["snapshots_two_hop"].window == 10000 and PRESETS["static_mean"].fanouts == (15, 10)
