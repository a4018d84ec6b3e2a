"""Link-prediction metrics per batch, and vector statistics over runs.

A batch may be any size: rows are first reduced to one row per (batch, score), then summed up in
score order with sums that never need a whole batch in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from ..plans.ordering import running_sum
from .aggregate import BLOCK, vector_agg, vector_blocks


def label_scores(pos: DataFrame, neg: DataFrame, logit: str = "logit") -> DataFrame:
    """Positives get label 1, negatives 0; the score is the sigmoid of the logit."""
    both = pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
    return both.withColumn("score", sigmoid(logit))


def _by_score(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))


def roc_auc(scored: DataFrame, keys: Sequence[str] = ("batch_id",), strategy: str = "auto") -> DataFrame:
    """Area under the ROC curve per group; equal scores share a rank; NULL with a single class."""
    keys = list(keys)
    summed = running_sum(_by_score(scored, keys), keys, ["score"], {"_cum": F.col("_n")}, strategy)
    wins = F.col("_p") * (F.col("_cum") - F.col("_n") / 2)
    total = summed.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return total.select(*keys, F.when(pairs > 0, F.col("_w") / pairs).alias("auc"))


def average_precision(scored: DataFrame, keys: Sequence[str] = ("batch_id",), strategy: str = "auto") -> DataFrame:
    """Average precision per group; equal scores form one threshold; NULL without positives."""
    keys = list(keys)
    down = _by_score(scored, keys).withColumn("_down", -F.col("score"))
    summed = running_sum(down, keys, ["_down"], {"_tp": F.col("_p"), "_all": F.col("_p") + F.col("_n")}, strategy)
    gain = F.col("_p") * F.col("_tp") / F.col("_all")
    total = summed.groupBy(*keys).agg(F.sum(gain).alias("_g"), F.sum("_p").alias("_p"))
    return total.select(*keys, F.when(F.col("_p") > 0, F.col("_g") / F.col("_p")).alias("ap"))


def mean_metric(values: DataFrame, metric: str, worker: str | None = None) -> DataFrame:
    """Plain mean over batches; with `worker`, the mean over workers of their means."""
    if worker:
        values = values.groupBy(worker).agg(F.avg(metric).alias(metric))
    return values.agg(F.avg(metric).alias(metric))


def bce_with_logits(scored: DataFrame, keys: Sequence[str] = ("batch_id",), logit: str = "logit") -> DataFrame:
    """Mean loss of the positives plus mean loss of the negatives, from logits."""
    x, y = F.col(logit), F.col("label")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    means = scored.groupBy(*keys).agg(F.avg(F.when(y == 1, loss)).alias("_p"), F.avg(F.when(y == 0, loss)).alias("_n"))
    return means.select(*keys, (F.coalesce("_p", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))).alias("loss"))


def standardize(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Per-dimension z-score with the population deviation; a constant dimension is only centred.

    Two numbers per dimension come to the driver and return as literals.
    """
    block = min(dim, BLOCK)
    x = [F.get(vec, F.lit(i)).cast("double") for i in range(block)]
    stats = vector_blocks(vectors.select(vec), vec, dim, block).groupBy("_b").agg(
        F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.stddev_pop(c) for c in x]).alias("std")).collect()
    mean, std = ([v for r in sorted(stats) for v in r[i]][:dim] for i in ("mean", "std"))
    if not mean or mean[0] is None:
        return vectors
    centred = F.zip_with(vec, F.lit(mean), lambda v, m: v.cast("double") - m)
    return vectors.withColumn(vec, F.zip_with(centred, F.lit([s or 1.0 for s in std]), lambda c, s: c / s))


def mean_over_runs(vectors: DataFrame, dim: int, last: int | None = None, vec: str = "vec") -> DataFrame:
    """Average vector over runs by position: (run, row, vec) -> (row, vec); `row` counts from 0 in each run.

    With `last` only each run's own last rows count, whatever its length, and positions are those
    among them: the final row of every run has position last - 1.
    """
    if last is not None:
        sizes = vectors.groupBy("run").agg((F.max("row") + 1).alias("_rows"))
        vectors = (vectors.join(sizes, "run").withColumn("row", F.col("row") - F.col("_rows") + last)
                   .filter("row >= 0").drop("_rows"))
    return vector_agg(vectors, ["row"], vec, dim, "mean", vec)
