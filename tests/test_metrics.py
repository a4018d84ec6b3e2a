import math
import random

import pytest

from tidegraph.operators import metrics as H


def auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap(pairs):
    tp = seen = 0
    last = total = 0.0
    n_pos = sum(y for y, _ in pairs)
    for s in sorted({s for _, s in pairs}, reverse=True):
        group = [y for y, t in pairs if t == s]
        tp, seen = tp + sum(group), seen + len(group)
        total += (tp / n_pos - last) * tp / seen
        last = tp / n_pos
    return total


@pytest.mark.parametrize("strategy", ["plain", "ranged"])
@pytest.mark.parametrize("levels", [3, 1000])
def test_auc_and_ap_with_ties(spark, strategy, levels):
    rng = random.Random(levels)
    data = [(b, rng.randrange(2), rng.randrange(levels) / levels) for b in range(3) for _ in range(80)]
    scored = spark.createDataFrame(data, "batch_id long, label int, score double")
    for fn, brute, name in ((H.roc_auc, auc, "auc"), (H.average_precision, ap, "ap")):
        got = {r.batch_id: r[name] for r in fn(scored, strategy=strategy).collect()}
        want = {b: brute([(y, s) for c, y, s in data if c == b]) for b in range(3)}
        assert got == pytest.approx(want)


def test_single_class_is_null(spark):
    scored = spark.createDataFrame([(0, 0, .5), (0, 0, .7)], "batch_id long, label int, score double")
    assert H.roc_auc(scored).first().auc is None and H.average_precision(scored).first().ap is None


def test_loss_is_stable(spark):
    rows = [(0, 1, 2.0), (0, 1, -800.0), (0, 0, 1.0), (0, 0, -3.0)]
    got = H.bce_with_logits(spark.createDataFrame(rows, "batch_id long, label int, logit double")).first().loss
    soft = lambda x: math.log1p(math.exp(x))
    assert got == pytest.approx((soft(-2.0) + 800.0) / 2 + (soft(1.0) + soft(-3.0)) / 2)


def test_means_and_vectors(spark):
    values = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "worker long, ap double")
    assert H.mean_metric(values, "ap").first().ap == 4.0
    assert H.mean_metric(values, "ap", "worker").first().ap == 5.0
    vecs = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "row long, vec array<double>")
    assert sorted(r.vec for r in H.standardize(vecs, 2).collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_mean_over_runs_of_different_lengths(spark):
    rows = [("a", i, [float(i), 1.0]) for i in range(5)] + [("b", 0, [7.0, 3.0])] + [("c", i, [10.0 * i, 0.0]) for i in range(2)]
    runs = spark.createDataFrame(rows, "run string, row long, vec array<double>")
    # each run's own last two rows; b has one only, which is its last
    assert {r.row: r.vec for r in H.mean_over_runs(runs, 2, 2).collect()} == {0: [1.5, 0.5], 1: [(4 + 7 + 10) / 3, 4 / 3]}
    assert {r.row: r.vec[0] for r in H.mean_over_runs(runs, 2).collect()} == {0: 7 / 3, 1: 5.5, 2: 2.0, 3: 3.0, 4: 4.0}


def test_standardize_long_vectors(spark):
    dim = 300
    vecs = spark.createDataFrame([(0, [float(i) for i in range(dim)]), (1, [float(-i) for i in range(dim)])], "id long, vec array<float>")
    got = {r.id: r.vec for r in H.standardize(vecs, dim).collect()}
    assert got == {0: [0.0] + [1.0] * (dim - 1), 1: [0.0] + [-1.0] * (dim - 1)}
