"""The folder that streams append edges to: complete batches only, runs, sequence numbers."""
import pytest
from frames import rows

from tidegraph.sources.commits import commit, commits
from tidegraph.streaming import ingest

EDGES = "src long, dst long, ts long, eid long"
BIG = 1 << 45


def batch(spark, k, base=0):
    return spark.createDataFrame([(i % 3, i, 100 * k + i, base + 10 * k + i) for i in range(10)], EDGES)


def order(spark, path, through=None):
    return [e for _, e in sorted(rows(ingest.read_graph(spark, path, through), "seq", "eid"))]


def test_reads_between_batches_repeats_and_compaction(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError):
        ingest.read_graph(spark, path)
    for k in range(3):
        assert ingest.store_batch(batch(spark, k), path, k)
    want = list(range(30))
    assert order(spark, path) == want
    # the fourth batch is half written: its folder is there, its name isn't
    batch(spark, 3).limit(4).write.parquet(f"{path}/batch=3")
    assert order(spark, path) == want
    seqs = sorted(rows(ingest.read_graph(spark, path), "eid", "seq"))
    assert ingest.store_batch(batch(spark, 3), path, 3) and not ingest.store_batch(batch(spark, 9), path, 3)
    assert order(spark, path) == list(range(40)) and order(spark, path, 1) == list(range(20))
    assert ingest.compact_graph(spark, path, 1) == (0, 1)
    assert order(spark, path) == list(range(40)) and sorted(rows(ingest.read_graph(spark, path, 2), "eid", "seq")) == seqs
    assert ingest.compact_graph(spark, path) == (2, 3)
    assert ingest.compact_graph(spark, path) is None
    assert order(spark, path) == list(range(40)) and order(spark, path, 1) == list(range(20))
    assert order(spark, path, 2) == want  # ends inside the second run: read from its batches
    ingest.store_batch(batch(spark, 4), path, 4)
    assert ingest.compact_graph(spark, path, merge_runs=True) == (0, 4)
    before = ingest.read_graph(spark, path)
    assert sorted(rows(before, "eid", "seq"))[:30] == seqs
    ingest.drop_compacted(spark, path)
    assert order(spark, path) == list(range(50)) and [c.values for c in commits(spark, path, "run")] == [(0, 4)]
    assert not (tmp_path / "batch=2").exists() and not (tmp_path / "run_0_1").exists()
    ingest.store_batch(batch(spark, 5), path, 5)
    assert order(spark, path) == list(range(60))


def test_eids_of_any_size_keep_the_order_of_arrival(spark, tmp_path):
    path = str(tmp_path)
    ingest.store_batch(batch(spark, 0, BIG), path, 0)
    ingest.store_batch(batch(spark, 0), path, 1)
    ingest.store_batch(batch(spark, 0).limit(0), path, 2)
    ingest.store_batch(batch(spark, 5), path, 7)
    assert order(spark, path) == [BIG + i for i in range(10)] + list(range(10)) + list(range(50, 60))
    commit(spark, path, "batch", 8, 0, 1 << 63)
    with pytest.raises(ValueError):
        ingest.read_graph(spark, path)
