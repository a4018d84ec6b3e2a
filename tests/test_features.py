import math

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import vectors as V
from tidegraph.operators import aggregate as A
from tidegraph.operators import features as E
from tidegraph.operators import state as M


@pytest.fixture(scope="module")
def feats(spark):
    return spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(6)], "id long, feat array<float>")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(0, 0, 0, 0, 5, 1, 1.0), (0, 0, 0, 1, 5, 2, 3.0), (0, 0, 1, 0, 4, 3, -2.0)]
    return spark.createDataFrame(rows, "hop int, snapshot int, rid long, slot int, root_node long, src_node long, score double")


def test_upsert_last_write_wins(spark, feats):
    updates = spark.createDataFrame([(1, [9.0, 9.0], 5), (1, [8.0, 8.0], 4), (77, [7.0, 7.0], 1)],
                                    "id long, feat array<float>, version long")
    got = {r.id: r.feat for r in E.upsert_features(feats, updates).collect()}
    assert got[1] == [9, 9] and got[77] == [7, 7] and got[2] == [2, -2] and len(got) == 7


def test_lookup_keeps_order_and_duplicates(spark, feats):
    asked = spark.createDataFrame([(0, 3), (1, 99), (2, 3)], "req long, id long")
    got = E.lookup(feats, asked).orderBy("req").collect()
    assert [r.feat for r in got] == [[3, -3], None, [3, -3]]


def test_hot_set_and_coverage(spark):
    s = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 1), (1, 3)], "block long, src_node long")
    counts = E.access_counts(s, "src_node", ["block"])
    assert {r.id: r.n for r in counts.collect()} == {1: 2, 2: 1, 3: 1}
    hot = E.hot_set(counts, 0.5, 4)
    assert sorted(r.id for r in hot.collect()) == [1, 2]
    assert E.hot_set_coverage(s, hot, "src_node", ["block"]).first().coverage == pytest.approx((1 + .5) / 2)


def test_memory_and_mail(spark):
    state = spark.createDataFrame([], "node long, mem array<double>, mem_ts long, mail array<double>, mail_ts long")
    batch = spark.createDataFrame(
        [(0, 0, "src", 1, 10, [1.0]), (0, 1, "src", 1, 11, [2.0]), (0, 2, "dst", 1, 10, [3.0]), (0, 4, "neg", 9, 10, [0.0])],
        "batch_id long, pos long, role string, node long, ts long, mem array<double>")
    got = M.update_memory(state, batch, 1, 2).collect()
    assert [(r.node, r.mem, r.mem_ts, r.mail) for r in got] == [(1, [3.0], 10, [0.0, 0.0])]
    talk = spark.createDataFrame([(0, 0, 1, 2, 10, [1.0], [2.0]), (0, 1, 2, 1, 11, [5.0], [6.0])],
                                 "batch_id long, i long, src long, dst long, ts long, mem_src array<double>, mem_dst array<double>")
    mail = {r.node: (r.mail, r.mail_ts) for r in M.update_mailbox(state, talk, 1, 3).collect()}
    assert mail == {1: ([6.0, 5.0, 0.0], 11), 2: ([5.0, 6.0, 0.0], 11)}


def test_state_lookup_reset_and_missing(spark):
    state = spark.createDataFrame([(1, [1.0], 5, [2.0, 2.0], 6)],
                                  "node long, mem array<double>, mem_ts long, mail array<double>, mail_ts long")
    front = spark.createDataFrame([(0, 1), (1, 2)], "rid long, node long")
    got = {r.rid: (r.mem, r.mem_ts, r.mail) for r in M.node_state_lookup(front, state, 1, 2).collect()}
    assert got == {0: ([1.0], 5, [2.0, 2.0]), 1: ([0.0], 0, [0.0, 0.0])}
    assert M.insert_missing_state(state, front, 1, 2).count() == 2
    assert M.reset_state(state).first().mail == [0.0, 0.0]


def test_time_code(spark):
    row = spark.range(1).select(V.time_encode(F.lit(3.0), 4).alias("c"), V.time_encode(F.lit(3.0), 1).alias("d")).first()
    assert row.c == pytest.approx([math.cos(3 * 10 ** (-9 * i / 3)) for i in range(4)])
    assert row.d == pytest.approx([math.cos(3)])


def test_aggregates(samples, feats):
    key = ["rid"]
    get = lambda how: {r.rid: r.agg for r in A.neighbor_aggregate(samples, feats, 2, how, key).collect()}
    assert get("mean") == {0: [1.5, -1.5], 1: [3.0, -3.0]}
    assert get("max") == {0: [2.0, -1.0], 1: [3.0, -3.0]}
    assert get("gcn")[0] == pytest.approx([8 / 3, -8 / 3])


def test_softmax_both_plans_and_weighted_sum(spark, samples, feats):
    want = {0: 1 / (1 + math.exp(2)), 1: 1 / (1 + math.exp(-2))}
    for bounded in (True, False):
        got = A.segment_softmax(samples, "score", ["rid"], bounded=bounded).collect()
        assert {r.slot: r.weight for r in got if r.rid == 0} == pytest.approx(want)
    roots = spark.createDataFrame([(0,), (1,), (2,)], "rid long")
    got = {r.rid: r.agg for r in A.weighted_neighbor_sum(samples, roots, feats, "score", 2).collect()}
    assert got[0][0] == pytest.approx(want[0] + 2 * want[1]) and got[2] == [0.0, 0.0]
    assert {r.rid: r.total for r in A.neighbor_sum(samples, "score", ["rid"]).collect()} == {0: 4.0, 1: -2.0}


def test_elementwise(spark):
    row = spark.range(1).select(V.leaky_relu(F.lit(-2.0)).alias("a"), V.leaky_relu(F.lit(2.0)).alias("b"),
                                V.pair_product(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("p")).first()
    assert (row.a, row.b, row.p) == (pytest.approx(-.4), 2.0, [3.0, 8.0])


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
@pytest.mark.parametrize("dim,block", [(7, 3), (6, 3), (1_024, 128)])
def test_vectors_in_blocks(spark, how, dim, block):
    """Blocks give what one aggregate per dimension gives, in rows of `block` numbers."""
    rows = [(k, [float((k * 31 + j * 7 + i) % 13) for i in range(dim)]) for k in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {r.k: r.agg for r in A.vector_agg(df, ["k"], "v", dim, how, block=block).collect()}
    fn = {"mean": lambda x: sum(x) / len(x), "max": max, "sum": sum}[how]
    assert got == {k: [pytest.approx(fn(c)) for c in zip(*(v for q, v in rows if q == k))] for k in range(3)}
    if dim == 7:
        assert got == {r.k: r.agg for r in A.vector_agg(df, ["k"], "v", dim, how).collect()}


@pytest.mark.parametrize("most", [1 << 20, 150, 0])
def test_aggregates_wherever_vectors_meet(spark, samples, feats, most, monkeypatch):
    """All vectors broadcast, the most used ones, or none: the same sums. Repeated and missing ids count as they are."""
    monkeypatch.setattr(A, "MAX_BYTES", most)
    twice = feats.filter("id <> 3").union(feats.filter("id = 2"))
    get = lambda how: {r.rid: r.agg for r in A.neighbor_aggregate(samples, twice, 2, how, ["rid"]).collect()}
    assert get("mean") == {0: pytest.approx([5 / 3, -5 / 3])}
    assert get("gcn") == {0: pytest.approx([2.5, -2.5]), 1: [4, -4]}
    roots = spark.createDataFrame([(0,), (1,), (2,)], "rid long")
    got = {r.rid: r.agg for r in A.weighted_neighbor_sum(samples, roots, twice, "score", 2).collect()}
    first = 1 / (1 + math.exp(2))
    assert got[0] == pytest.approx([first + 4 * (1 - first), -first - 4 * (1 - first)]) and got[1] == got[2] == [0, 0]


def test_vectors_are_not_shuffled(samples, feats):
    """Rows are shuffled once, as ids; no vector, and no sums of them, after their vectors are there."""
    for how in ("mean", "gcn"):
        plan = A.neighbor_aggregate(samples, feats, 2, how, ["rid"])._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]


def test_vectors_as_text(spark):
    """As rounding, casting and joining in Spark: ties, signs, nulls, empty lists."""
    from pyspark.sql import functions as F

    from tidegraph.queries.common import whole
    values = [[0.0078125, -0.0078125, 0.0234375, None, 1.5], None, [], [None], [-0.0, 4.999999999999999e-07, 5e-07, -5e-07, 123456.789]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v array<double>")

    for column in (F.col("v"), F.col("v").cast("array<float>")):
        got = rows.withColumn("v", column).select("i", whole("v").alias("got"), F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",").alias("want"))
        assert all(r.got == r.want for r in got.collect())
