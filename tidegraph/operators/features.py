"""Feature tables: attach to samples, look up, upsert; access counts and hot sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import dense_ordinal


def attach_node_features(front: DataFrame, feats: DataFrame, key: str = "node") -> DataFrame:
    """Left join on id: rows without features keep NULL. AQE broadcasts a side it has measured."""
    return front.join(feats.select(F.col("id").alias(key), "feat"), key, "left")


def attach_with_hot(front: DataFrame, feats: DataFrame, hot: DataFrame, key: str = "node",
                    max_bytes: int = 64 << 20, salts: int = 32) -> DataFrame:
    """attach_node_features with the hot ids' rows joined by broadcast and only the rest shuffled.

    The hot rows are measured first. Beyond `max_bytes` nothing is broadcast: hot ids are salted,
    their rows repeated for every salt, so that no hot id lands in one task.
    """
    ids = hot.select(F.col("id").alias(key)).distinct()
    by_id = feats.select(F.col("id").alias(key), "feat")
    n, width = by_id.join(ids, key, "left_semi").agg(F.count(F.lit(1)), F.max(F.size("feat"))).first()
    if max(n * (16 + 4 * (width or 0)), 8 * hot.count()) > max_bytes:
        marked = front.join(ids.withColumn("_hot", F.lit(True)), key, "left")
        salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*front.columns), F.lit(salts))).otherwise(0))
        each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        spread = by_id.join(ids.withColumn("_hot", F.lit(True)), key, "left").withColumn("_salt", F.explode(each)).drop("_hot")
        return salted.drop("_hot").join(spread, [key, "_salt"], "left").select(*front.columns, "feat")
    hot_feats = F.broadcast(by_id.join(F.broadcast(ids), key, "left_semi"))
    often = front.join(F.broadcast(ids), key, "left_semi").join(hot_feats, key, "left")
    seldom = front.join(F.broadcast(ids), key, "left_anti").join(by_id, key, "left")
    return often.unionByName(seldom)


def attach_edge_features(samples: DataFrame, feats: DataFrame) -> DataFrame:
    return samples.join(feats.select("eid", "feat"), "eid", "left")


def target_edge_features(batch: DataFrame, feats: DataFrame) -> DataFrame:
    """Features of the positive edges of a stacked batch."""
    positives = batch.filter(F.col("eid").isNotNull()).select("batch_id", "pos", "eid")
    return positives.join(feats.select("eid", "feat"), "eid", "left")


def upsert_features(table: DataFrame, updates: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Last write wins per key: among updates the highest version, and any update over the table."""
    values = [c for c in table.columns if c != key]
    tagged = (table.withColumn("_v", F.lit(None).cast(updates.schema[version].dataType))
              .unionByName(updates.withColumn("_v", F.col(version)).select(*table.columns, "_v")))
    # NULL sorts below every version inside a struct, so the stored row loses against any update
    last = F.max_by(F.struct(*values), F.struct(F.col("_v").isNotNull(), "_v"))
    return tagged.groupBy(key).agg(last.alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in values])


def lookup(table: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """One row per request, duplicates kept, NULL for unknown keys; `req` is the request order."""
    return requests.select("req", key).join(table, key, "left")


def access_counts(samples: DataFrame, id_col: str, block: Sequence[str] | None = None) -> DataFrame:
    """How often each id was sampled; with `block`, an id counts once per block."""
    if block:
        samples = samples.select(*block, id_col).distinct()
    return samples.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def hot_set(counts: DataFrame, ratio: float, total: int) -> DataFrame:
    """The int(ratio * total) most accessed ids, ties to the lower id.

    Ranks come from a range sort, so a large set never passes through a single task.
    """
    ranked = dense_ordinal(counts.withColumn("_neg", -F.col("n")), ["_neg", "id"], "rank")
    return ranked.filter(F.col("rank") < int(ratio * total)).select("id", "n", "rank")


def hot_set_coverage(samples: DataFrame, hot: DataFrame, id_col: str, block: Sequence[str]) -> DataFrame:
    """Share of rows whose id is hot, per block, averaged over blocks."""
    flagged = samples.join(hot.select(F.col("id").alias(id_col), F.lit(1.0).alias("_hit")), id_col, "left")
    share = flagged.groupBy(*block).agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))
    return share.agg(F.avg("share").alias("coverage"), F.count(F.lit(1)).alias("blocks"))
