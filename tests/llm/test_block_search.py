import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import block_search


def brute(rows, k, is_query):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    out = []
    for q, a in usable.items():
        if is_query(q):
            score = [(-float(np.dot(np.array(a, float), np.array(b, float))), i) for i, b in usable.items() if i != q]
            out += [(q, rank, i) for rank, (_, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = block_search.nearest(df, F.col("vec_id") % 3 == 0, k, **sizes).collect()
    return sorted((r.query_id, r["rank"], r.vec_id) for r in got)


def test_against_brute_force(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(-8, 9, (300, 6)) / 8  # exact in float, with many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)
    assert run(spark, rows, candidates_per_block=32, queries_per_block=16) == brute(rows, 5, lambda i: i % 3 == 0)


def test_copies_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(40)] + [
        (40, None), (41, []), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [nan, 1.0]), (45, [inf, 1.0]), (None, [9.0, 9.0]),
        (46, [2.0, 1.0]), (46, [1.0, 1.0]), (47, [1e-30, 0.0]), (48, [3e30, 1.0])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_bounds_prune(spark):
    """Bounds hold, and leave few pairs of random vectors to compute."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2_000, 64))
    codes, scale, rest = block_search.quantised(x)
    decoded = codes * scale[:, None]
    off = np.linalg.norm(x[:20], axis=1)[:, None] * rest + rest[:20, None] * np.linalg.norm(decoded, axis=1)
    product = decoded[:20] @ decoded.T
    assert (np.abs(x[:20] @ x.T - product) <= off + 1e-9).all()
    least = np.sort(product - off, axis=1)[:, -20]
    assert ((product + off) >= least[:, None]).mean() < 0.05
