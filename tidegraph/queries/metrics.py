"""Link-prediction metrics and vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import vector_sum
from ..operators import metrics as H
from ..plans.storage import freeze
from .common import query, table, vectors, whole, whole_sql
from .features import link_logits

DIM = 64

# logits rounded to 3 digits, which also makes ties
LOGITS = """logits AS (SELECT ord, batch_id, label, round(list_dot_product(CAST(s.feat AS DOUBLE[]), CAST(o.feat AS DOUBLE[])), 3) AS logit
    FROM (SELECT ord, batch_id, src, dst AS other, 1 AS label FROM with_neg
          UNION ALL SELECT ord, batch_id, src, neg, 0 FROM with_neg) w
    JOIN nv s ON s.id = w.src JOIN nv o ON o.id = w.other),
    scored AS (SELECT *, 1 / (1 + exp(-logit)) AS score FROM logits)"""
AUC = """auc AS (SELECT batch_id, (sum(CASE WHEN label = 1 THEN r END) - any_value(p) * (any_value(p) + 1) / 2)
      / (any_value(p) * any_value(n)) AS auc
    FROM (SELECT batch_id, label, rank() OVER (PARTITION BY batch_id ORDER BY logit)
        + (count(*) OVER (PARTITION BY batch_id, logit) - 1) / 2 AS r,
        sum(label) OVER (PARTITION BY batch_id) AS p, sum(1 - label) OVER (PARTITION BY batch_id) AS n FROM scored)
    GROUP BY batch_id)"""
AP = """ap AS (SELECT batch_id, sum(p * tp / total) / sum(p) AS ap FROM (
      SELECT batch_id, p, sum(p) OVER w AS tp, sum(c) OVER w AS total FROM (
        SELECT batch_id, logit, sum(label) AS p, count(*) AS c FROM scored GROUP BY batch_id, logit)
      WINDOW w AS (PARTITION BY batch_id ORDER BY logit DESC)) GROUP BY batch_id)"""


def scored(spark, sf):
    rows = link_logits(spark, sf).select("ord", "batch_id", "label", F.round(vector_sum("product"), 3).alias("logit"))
    pos, neg = (rows.filter(F.col("label") == i).drop("label") for i in (1, 0))
    return freeze(H.label_scores(pos, neg), "scored")


def _rounded(df, *metrics):
    # an area is a multiple of 1 / (2 p n): six digits of it can end in an exact half
    return df.withColumns({m: F.round(m, 9 if m == "auc" else 6) for m in metrics})


@query(f"WITH {LOGITS} SELECT ord, label, round(score, 6) AS score FROM scored")
def label_scores(spark, sf):
    return scored(spark, sf).select("ord", F.col("label").cast("bigint").alias("label"), F.round("score", 6).alias("score"))


@query(f"WITH {LOGITS}, {AUC} SELECT batch_id, round(auc, 9) AS auc FROM auc")
def roc_auc(spark, sf):
    return _rounded(H.roc_auc(scored(spark, sf)), "auc")


@query(f"WITH {LOGITS}, {AUC} SELECT batch_id, round(auc, 9) AS auc FROM auc")
def roc_auc_hot_safe(spark, sf):
    """The plan for batches too large for one task, on the same data."""
    return _rounded(H.roc_auc(scored(spark, sf), strategy="ranged"), "auc")


@query(f"WITH {LOGITS}, {AP} SELECT batch_id, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf):
    return _rounded(H.average_precision(scored(spark, sf)), "ap")


@query(f"WITH {LOGITS}, {AUC} SELECT round(avg(auc), 6) AS auc FROM auc")
def mean_metric(spark, sf):
    return _rounded(H.mean_metric(H.roc_auc(scored(spark, sf)), "auc"), "auc")


@query(f"""WITH {LOGITS}, {AP} SELECT round(avg(ap), 6) AS ap FROM
    (SELECT avg(ap) AS ap FROM ap GROUP BY batch_id % 4)""")
def mean_metric_over_workers(spark, sf):
    values = H.average_precision(scored(spark, sf)).withColumn("worker", F.col("batch_id") % 4)
    return _rounded(H.mean_metric(values, "ap", "worker"), "ap")


@query(f"""WITH {LOGITS} SELECT batch_id, round(avg(CASE WHEN label = 1 THEN l END) + avg(CASE WHEN label = 0 THEN l END), 6) AS loss
    FROM (SELECT batch_id, label, greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))) AS l FROM logits)
    GROUP BY batch_id""")
def bce_with_logits(spark, sf):
    return _rounded(H.bce_with_logits(scored(spark, sf)), "loss")


@query("""WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY i)
    SELECT vec_id AS id, x.i - 1 AS dim, round((v - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) AS value FROM x JOIN s ON s.i = x.i""")
def standardize(spark, sf):
    got = H.standardize(vectors(spark, sf), DIM, "feat")
    return got.select("id", F.posexplode("feat").alias("dim", "v")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.round("v", 5).alias("value"))


LAST = 20


@query(f"""WITH r AS (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS back, embedding FROM embeddings)
    SELECT {LAST} - back AS "row", {whole_sql('list(v ORDER BY i)')} AS vec FROM (
      SELECT back, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM r, (SELECT unnest(range(1, {DIM + 1})) AS i) WHERE back <= {LAST} GROUP BY back, i)
    GROUP BY back""")
def mean_over_runs(spark, sf):
    """Each label is one run, of its own length; the mean of their last 20 vectors by position."""
    from ..plans.ordering import running_sum
    runs = table(spark, sf, "embeddings").select(F.col("label").alias("run"), "vec_id", F.col("embedding").alias("vec"))
    numbered = running_sum(runs, ["run"], ["vec_id"], {"row": F.lit(1)}).withColumn("row", F.col("row") - 1)
    return H.mean_over_runs(freeze(numbered, "runs"), DIM, LAST).select("row", whole("vec").alias("vec"))
