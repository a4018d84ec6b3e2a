"""A continuous run, step by step, that goes on where it stopped.

Every step appends an increment of edges to the graph, asks a scorer about it, drops old edges and
writes the rows to retrain on. The outputs of a step lie in folders of their own and count once the
step is named as complete; a run that is started again begins with the first step that isn't, and
computes that one again from outputs of complete steps only. So a broken and resumed run has the
same rows as one that wasn't.

    graph     the edge store: batch 0 is what was there before, batch k + 1 the increment of step k
    pool      destinations seen up to the step, for negatives
    metrics   (auc, ap) of the step
    retrain   replayed and new rows, each in `part` train or val
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batching import dst_pool, extend_pool, negative_dst
from ..operators.continuous import ordered_train_val, retrain_rows
from ..operators.metrics import average_precision, roc_auc
from ..plans.storage import freeze, scratch
from ..sources.commits import commit, commits
from .ingest import read_graph, store_batch

EDGE = ("src", "dst", "ts", "eid")
# (edges known before the step, questions (ord, label, src, node, ts)) -> questions with `score`
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def popularity(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Score: how often the node was a destination."""
    seen = known.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(seen, "node", "left").withColumn("score", F.coalesce("n", F.lit(0)).cast("double")).drop("n")


def finished_steps(spark: SparkSession, path: str) -> list[tuple[int, int | None]]:
    """(step, the time before which it dropped edges) of all complete steps."""
    return [c.values for c in commits(spark, path, "step")]


def _questions(increment: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("dst").alias("node")),
                              F.struct(F.lit(0).alias("label"), F.col("neg").alias("node"))))
    return negative_dst(increment, pool, seed).select("ord", "src", "ts", pairs.alias("p")).select("ord", "p.label", "src", "p.node", "ts")


def run_step(stepped: DataFrame, path: str, step: int, scorer: Scorer, window: int | None, replay: float, val: float, seed: int,
             before: int | None) -> int | None:
    """One step over written rows (src, dst, ts, eid, ord, step); returns the time before which edges
    have gone. `before` is that of the step before."""
    spark = stepped.sparkSession
    increment = stepped.filter(F.col("step") == step)
    store_batch(increment.select(*EDGE), f"{path}/graph", step + 1)
    earlier = (spark.read.parquet(f"{path}/pool/step={step - 1}") if step
               else dst_pool(stepped.filter("step < 0")))
    extend_pool(earlier, increment).write.mode("overwrite").parquet(f"{path}/pool/step={step}")
    pool = spark.read.parquet(f"{path}/pool/step={step}")

    known = read_graph(spark, f"{path}/graph", step)
    if before is not None:
        known = known.filter(F.col("ts") >= before)
    scored = freeze(scorer(known, _questions(increment, pool, seed)).withColumn("step", F.lit(step)), "scored")
    metrics = roc_auc(scored, ["step"]).join(average_precision(scored, ["step"]), "step").drop("step")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics/step={step}")

    start, end, first = increment.agg(F.min("ord"), F.max("ord") + 1, F.min_by("ts", "ord")).first()
    since = before if window is None else first - window
    old = stepped.filter(F.col("ord") < start)
    low = 0 if since is None else old.filter(F.col("ts") >= since).agg(F.min("ord")).first()[0]
    # with nothing left to replay only the new rows are trained on
    rows = retrain_rows(stepped, start if low is None else low, start, end, replay if low is not None else 0.0, seed)
    ordered_train_val(freeze(rows, "retrain"), val).drop("step").write.mode("overwrite").parquet(f"{path}/retrain/step={step}")
    return since


def continuous_run(stepped: DataFrame, path: str, scorer: Scorer = popularity, window: int | None = None, replay: float = 0.0,
                   val: float = 0.1, seed: int = 0, stop_after: int | None = None) -> None:
    """Run all steps of `stepped` (see continuous.increments; step -1 is the history) that are still
    open, at most up to `stop_after`.

    window: after a step, edges older than its first time minus this are dropped. replay: so many old
    rows, as a share of all rows before the step, are drawn for retraining.
    """
    spark = stepped.sparkSession
    done = finished_steps(spark, path)
    store_batch(stepped.filter("step < 0").select(*EDGE), f"{path}/graph", 0)
    before = done[-1][1] if done else None
    last = stepped.agg(F.max("step")).first()[0]
    for step in range(len(done), (last if stop_after is None else min(last, stop_after)) + 1):
        with scratch(spark):
            before = run_step(stepped, path, step, scorer, window, replay, val, seed, before)
        commit(spark, path, "step", step, before)


def results(spark: SparkSession, path: str, what: str) -> DataFrame:
    """`metrics`, `retrain` or `pool` of all complete steps, with `step`."""
    steps = [f"{path}/{what}/step={step}" for step, _ in finished_steps(spark, path)]
    return spark.read.option("basePath", f"{path}/{what}").parquet(*steps)
