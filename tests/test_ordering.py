import random

import pytest
from pyspark.sql import functions as F

from tidegraph.plans.ordering import by_group_size, dense_ordinal, running_sum
from tidegraph.plans.storage import freeze


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def table(spark, n, hot, seed):
    rng = random.Random(seed)
    rows = [(0 if rng.random() < hot else rng.randrange(5), rng.randrange(20), i, rng.randrange(-3, 9)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, t long, i long, v long")


@pytest.mark.parametrize("n,start", [(0, 0), (1, 7), (3000, 0), (3000, 50)])
def test_dense_ordinal(spark, n, start):
    df = spark.range(n).select((F.col("id") * 37 % 3001).alias("x"))
    got = dense_ordinal(df, ["x"], "o", start).orderBy("x").collect()
    assert [r.o for r in got] == list(range(start, start + n))


@pytest.fixture()
def small_limit(spark):
    spark.conf.set("spark.tidegraph.maxGroupRows", "700")
    yield
    spark.conf.unset("spark.tidegraph.maxGroupRows")


@pytest.mark.parametrize("strategy", ["plain", "ranged", "auto"])
@pytest.mark.parametrize("n,hot,seed", [(0, 0, 1), (2000, 0.0, 2), (2000, 0.5, 3), (2000, 1.0, 4)])
def test_running_sum_matches_brute_force(spark, small_limit, strategy, n, hot, seed):
    data, df = table(spark, n, hot, seed)
    want, sums = {}, {}
    for k, t, i, v in sorted(data):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    got = running_sum(df, ["k"], ["t", "i"], {"s": F.col("v")}, strategy).collect()
    assert {r.i: r.s for r in got} == want


def test_running_sum_without_keys(spark):
    data, df = table(spark, 1500, 0.3, 5)
    total, want = 0, {}
    for _, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        total += v
        want[i] = total
    big = running_sum(df, [], ["t", "i"], {"s": F.col("v")}, big=True)
    assert {r.i: int(r.s) for r in big.collect()} == want
    assert dict(big.dtypes)["s"] == "decimal(38,0)"


def test_only_hot_keys_are_split(spark, small_limit):
    data, df = table(spark, 2000, 0.5, 6)
    mark = lambda name: lambda rows: rows.withColumn("plan", F.lit(name))
    got = by_group_size(df, ["k"], "auto", mark("plain"), mark("ranged")).collect()
    assert len(got) == 2000 and {(r.k == 0, r.plan) for r in got} == {(True, "ranged"), (False, "plain")}
    with pytest.raises(ValueError):
        by_group_size(df, ["k"], "fast", mark("a"), mark("b"))


def test_freeze_cuts_lineage(spark):
    df = freeze(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
