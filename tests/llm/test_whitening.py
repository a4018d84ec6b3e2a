import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import whitening as w
from tidegraph.llm.queries import QUERIES


def brute(rows, components=4):
    """{vec_id: deviation}, and coordinates up to the sign, from the covariance itself."""
    kept = [(i, [math.floor(256 * float(c)) + 0 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x) for i, x in kept if len(x) == dims]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    projected = (np.array([x for _, x in kept], float) - np.array([s / n for s in sums])) @ vectors[:, order]
    return n, deviation, values[order], projected, values.sum()


def check(spark, rows, tol=1e-6):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("clash"), "n": F.lit(1)})
    got = w.whiten(df).collect()
    single = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    n, deviation, values, projected, trace = brute(single)
    k = len(values)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, of in by.items():
        assert sorted((r.vec_id, r.deviation) for r in of) == sorted(deviation)
        e = values[c - 1]
        assert of[0].explained == pytest.approx(max(e, 0) / trace if trace else 0, rel=1e-9, abs=1e-12)
        if e > 1e-9 * max(trace, 1):
            have = sorted((r.vec_id, r.whitened) for r in of)
            either = [sorted(zip((i for i, _ in deviation), sign * projected[:, c - 1] / math.sqrt(e))) for sign in (1, -1)]
            assert any(np.allclose([v for _, v in have], [v for _, v in want], atol=tol) for want in either)
        else:
            assert {r.whitened for r in of} == {0.0}
    return got


def random_rows(n=400, dims=9, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)) * np.array([2.0 ** -i for i in range(dims)]) + 3
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_against_eigenvectors(spark):
    check(spark, random_rows())


def test_copies_weigh_nothing(spark):
    rows = random_rows(200)
    check(spark, rows + [(1000 + i, rows[3][1]) for i in range(300)])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, random_rows(60, 3) + [(900, None), (901, []), (902, [1.0, None, 0.0]), (903, [nan, 0.0, 1.0]), (904, [0.0, -inf, 0.0]),
                                       (905, [1.0, 2.0]), (906, [-0.0, 0.0, 0.0]), (5, [0.5, 0.25, 1.0])])


def test_lower_rank(spark):
    """A constant column, a repeated one, and fewer vectors than dimensions."""
    rows = [(i, [v[0], 7.0, v[1], v[0], v[2], -v[2]]) for i, v in random_rows(200, 3)]
    check(spark, rows)
    check(spark, random_rows(3, 12))


def test_one_vector_and_none(spark):
    got = check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert {(r.whitened, r.explained, r.identity_error) for r in got} == {(0.0, 0.0, 0.0)}
    assert w.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert w.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_badly_conditioned(spark):
    """Factors keep small variances that a covariance in double precision loses."""
    draw = np.random.default_rng(4)
    x = np.rint(draw.normal(size=(3_000, 5)) * [1e9, 1e7, 1e5, 30, 10])
    x[:, 3] += x[:, 0]
    fit = spark.createDataFrame([(v,) for v in x.astype(int).tolist()], "x array<bigint>")
    model = w.fit_whitening(fit, 5)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / len(x)
    assert np.allclose(model.variances, want, rtol=1e-5) and model.identity_error < 1e-4


def test_exact_deviations():
    x = np.array([[2 ** 40, -3], [5, 2 ** 31]])
    n, sums = 1_000, (2 ** 41, -12)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert w.deviations(x, n, sums) == [v if v < 2 ** 63 else None for v in want]
    x = np.array([[3, -4], [0, 1]])
    assert w.deviations(x, 7, (2, 1)) == [19 ** 2 + 29 ** 2, 4 + 36]


def test_query(spark, sf):
    got = QUERIES["op12_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, values, _, trace = brute(rows)
    assert {(r.vec_id, r.deviation) for r in got} == set(deviation) and len(got) == 4 * len(deviation)
    assert {(r.component, round(r.explained, 9)) for r in got} == {(c, round(v / trace, 9)) for c, v in enumerate(values, 1)}
