import pytest
from pyspark.sql import functions as F

from tidegraph.operators import batching as B


@pytest.fixture(scope="module")
def line(spark):
    """103 edges in a line."""
    return spark.range(103).select((F.col("id") % 7).alias("src"), (100 + F.col("id") % 11).alias("dst"),
                                   F.col("id").alias("ts"), (F.col("id") * 2).alias("eid"), F.col("id").alias("seq"))


def by_batch(df):
    out = {}
    for r in df.orderBy("batch_id", "pos").collect():
        out.setdefault(r.batch_id, []).append(r.eid // 2)
        assert r.pos == len(out[r.batch_id]) - 1
    return out


def test_fixed(line):
    got = by_batch(B.fixed_batches(line, 10))
    assert len(got) == 11 and got[0] == list(range(10)) and got[10] == [100, 101, 102]


@pytest.mark.parametrize("r", [0, 1, 3])
def test_trim_keeps_boundaries(line, r):
    got = by_batch(B.random_start_trim(line, 10, 4, r))
    skip = r * 10 // 4
    assert got[0] == list(range(skip, 10)) and got[1] == list(range(10, 20))


@pytest.mark.parametrize("r,drop", [(0, False), (2, False), (2, True)])
def test_short_first_batch(line, r, drop):
    got = by_batch(B.random_start_short(line, 10, 4, r, drop))
    first = r * 2
    sizes = [len(v) for v in got.values()]
    assert sizes[0] == (first or 10) and sizes[1] == 10
    assert sum(sizes) == (103 if not drop else first + (103 - first) // 10 * 10)


def test_short_rejects_bad_chunks(line):
    with pytest.raises(ValueError):
        B.random_start_short(line, 10, 10, 1)


def test_rank_shards_cover_everything(line):
    seen = []
    for rank in range(4):
        got = by_batch(B.rank_shard(line, rank, 4, 10))
        flat = [x for rows in got.values() for x in rows]
        assert flat == list(range(rank, 103, 4))
        seen += flat
    assert sorted(seen) == list(range(103))


def test_stacked_positions(line):
    pool = B.dst_pool(line)
    batches = B.negative_dst(B.fixed_batches(line, 10), pool, 3)
    got = B.target_triples(batches).filter("batch_id = 10").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(9))
    assert [r.role for r in got] == ["src"] * 3 + ["dst"] * 3 + ["neg"] * 3
    assert [r.eid for r in got] == [200, 202, 204] + [None] * 6
    pairs = B.target_pairs(B.fixed_batches(line, 10))
    assert pairs.count() == 206


def test_negatives_are_seeded_and_spread(line):
    pool = B.dst_pool(line)
    draw = lambda seed: {r.ord: r.neg for r in B.negative_dst(B.fixed_batches(line, 10), pool, seed).collect()}
    assert draw(1) == draw(1) != draw(2)
    assert set(draw(1).values()) == set(range(100, 111))


def test_excluding_real_edges(line):
    out = B.negative_dst(B.fixed_batches(line, 10), B.dst_pool(line), 1, exclude=line.limit(20))
    real = {(r.src, r.dst) for r in line.limit(20).collect()}
    rows = out.collect()
    assert len(rows) == 103 and all((r.src, r.neg) not in real for r in rows)


@pytest.mark.parametrize("strategy", ["plain", "ranged"])
def test_excluding_is_uniform_over_the_free(spark, strategy):
    """Every free destination of a source is drawn; a source that knows them all keeps its row with null."""
    known = [(0, d) for d in (100, 101, 104, 107)] + [(1, d) for d in range(100, 108)]
    edges = spark.createDataFrame(known, "src long, dst long")
    asks = spark.range(600).select((F.col("id") % 3).alias("src"), F.col("id").alias("ord"))
    rows = B.negative_dst(asks, B.dst_pool(edges), 3, exclude=edges, strategy=strategy).collect()
    assert sorted(r.ord for r in rows) == list(range(600))
    assert {r.neg for r in rows if r.src == 0} == {102, 103, 105, 106}
    assert {r.neg for r in rows if r.src == 1} == {None}
    assert {r.neg for r in rows if r.src == 2} == set(range(100, 108))


def test_several_negatives(line):
    pool, batches = B.dst_pool(line), B.fixed_batches(line, 10)
    rows = B.negative_dst(batches, pool, 1, neg_ratio=4).collect()
    single = {r.ord: r.neg for r in B.negative_dst(batches, pool, 1).collect()}
    assert len(rows) == 103 and all(len(r.negs) == 4 and r.negs[0] == single[r.ord] for r in rows)
    real = {(r.src, r.dst) for r in line.collect()}
    few = B.negative_dst(batches, pool, 1, exclude=line, neg_ratio=2).collect()
    assert len(few) == 103 and all((r.src, n) not in real for r in few for n in r.negs if n is not None)


def test_positions_are_dense_under_gaps(line):
    batches = B.negative_dst(B.fixed_batches(line, 10), B.dst_pool(line), 1, neg_ratio=2).filter("ord % 3 != 1")
    stacked = B.target_triples(batches, 2)
    for r in stacked.groupBy("batch_id").agg(F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.count("*").alias("n")).collect():
        assert r.d == r.n == r.m + 1


def test_empty_pool_is_an_error(line):
    with pytest.raises(ValueError):
        B.negative_dst(B.fixed_batches(line, 10), B.dst_pool(line.limit(0)), 1)


def test_draws_reach_all_of_a_large_range(spark):
    from tidegraph.functions.hashing import draw
    n = 1 << 40
    slices = spark.range(20_000).select(F.floor(draw(n, 1, F.col("id")) * 10 / n).alias("s")).groupBy("s").count().collect()
    assert len(slices) == 10 and all(1_700 < r["count"] < 2_300 for r in slices)


def test_pools(line):
    first, full = B.dst_pools(line.filter("ts < 3"), line.filter("ts >= 3"))
    assert [tuple(r) for r in first.orderBy("idx").collect()] == [(0, 100), (1, 101), (2, 102)]
    assert full.count() == 11 and B.pool_size(full) == 11


def test_random_edges_use_known_ends(line):
    got = B.random_edges(line, B.fixed_batches(line, 10), 5).collect()
    assert len(got) == 103 and {r.src for r in got} <= set(range(7)) and {r.dst for r in got} <= set(range(100, 111))
