"""Replaying history in increments: append, test, retrain on new plus replayed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..plans.ordering import dense_ordinal, running_sum
from ..plans.storage import freeze
from .metrics import average_precision, roc_auc


def phase_split(edges: DataFrame, ratio: float, val: float, order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """`ord` and `phase`: phase1_train, phase1_val, then phase2."""
    ordered = edges if "ord" in edges.columns else dense_ordinal(edges, order_by)
    first = int(ordered.count() * ratio)
    train = int(first * (1 - val)) + 1
    return ordered.withColumn("phase", F.when(F.col("ord") >= first, "phase2")
                              .when(F.col("ord") < train, "phase1_train").otherwise("phase1_val"))


def increments(edges: DataFrame, start: int, steps: int, order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """Equal steps of int(rest/steps) rows from ordinal `start`; the tail is unused.

    Rows before `start` get step -1.
    """
    ordered = edges if "ord" in edges.columns else dense_ordinal(edges, order_by)
    size = (ordered.count() - start) // steps
    step = F.when(F.col("ord") < start, F.lit(-1).cast("bigint")).otherwise(F.floor((F.col("ord") - start) / size))
    return ordered.withColumn("step", step).filter(F.col("step") < steps)


def replay_sample(ordered: DataFrame, low: int, high: int, n: int, seed: int) -> DataFrame:
    """n old rows drawn with replacement from ordinals [low, high), in order, before the new rows.

    Returns rows with `replay` (draw number, NULL for new rows); sort by (ord, replay) for the order.
    """
    spark = ordered.sparkSession
    draws = spark.range(n).select(F.col("id").alias("replay"),
                                  (F.lit(low) + draw(high - low, seed, "replay", F.col("id"))).alias("ord"))
    return draws.join(ordered, "ord")


def retrain_rows(ordered: DataFrame, low: int, start: int, end: int, ratio: float, seed: int) -> DataFrame:
    """Replayed old rows followed by the new rows [start, end), with their position `place`."""
    old = replay_sample(ordered, low, start, int(ratio * start), seed)
    new = ordered.filter((F.col("ord") >= start) & (F.col("ord") < end)).withColumn(
        "replay", F.lit(-1).cast("bigint"))
    return dense_ordinal(old.unionByName(new), ["ord", "replay"], "place")


def ordered_train_val(rows: DataFrame, val: float, place: str = "place", total: int | None = None) -> DataFrame:
    """First int(n*(1-val))+1 rows train, the rest validate."""
    total = rows.count() if total is None else total
    return rows.withColumn("part", F.when(F.col(place) < int(total * (1 - val)) + 1, "train").otherwise("val"))


def sliding_retention(stepped: DataFrame, step: int, window: int) -> DataFrame:
    """Graph before retraining at `step`: rows up to it, not older than its first time - window."""
    first = stepped.filter(F.col("step") == step).agg(F.min_by("ts", "ord")).first()[0]
    known = stepped.filter(F.col("step") <= step)
    return known if first is None else known.filter(F.col("ts") >= F.lit(first - window))


def prequential(stepped: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Test-then-train metrics per step, all steps in one job.

    `scorer` gets the stepped edges and returns scored(step, label, score); a row of step s may
    only use rows of earlier steps.
    """
    scored = freeze(scorer(stepped), "scored")
    auc, ap = roc_auc(scored, ["step"]), average_precision(scored, ["step"])
    return auc.join(ap, "step")


def popularity_scorer(pool: DataFrame, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Baseline scorer: how often the destination occurred before the step; one negative per edge."""
    from .batching import negative_dst

    def scorer(stepped: DataFrame) -> DataFrame:
        tests = negative_dst(stepped.filter("step >= 0"), pool, seed)
        pairs = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("dst").alias("node")),
                                  F.struct(F.lit(0).alias("label"), F.col("neg").alias("node"))))
        asked = tests.select("step", "ord", pairs.alias("p")).select("step", "ord", "p.label", "p.node")
        # reduce to one row per (node, step) before the join with the questions
        seen = stepped.groupBy(F.col("dst").alias("node"), "step").agg(F.count(F.lit(1)).alias("c"))
        wanted = asked.select("node", "step").distinct().withColumn("c", F.lit(0).cast("bigint"))
        per = seen.unionByName(wanted).groupBy("node", "step").agg(F.sum("c").alias("c"))
        known = running_sum(per, ["node"], ["step"], {"cum": F.col("c")})
        before = known.select("node", "step", (F.col("cum") - F.col("c")).alias("seen"))
        return asked.join(before, ["node", "step"]).select(
            "step", "ord", "label", F.col("seen").cast("double").alias("score"))

    return scorer
