"""Neighbourhood aggregation without learned parameters.

Vectors are aggregated by one aggregate per dimension: a single hash aggregation with map-side
combine, instead of exploding every vector into `dim` rows. Vectors of more than BLOCK numbers are cut
into blocks that are keys of their own, so the width of a row, and what code is generated for it, stay
the same however long the vectors are.

Vectors go to the ids, not ids to the vectors: the rows of a group are brought together while they
are only ids, the vectors most of them ask for are broadcast within a measured bound, and the group is
aggregated where it is. Only rows of ids beyond that bound meet their vector in a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import freeze

ROOT_KEYS = ("hop", "snapshot", "rid")
HOW = ("mean", "max", "sum", "gcn")


# Numbers of a vector that are aggregated side by side.
BLOCK = 128


def vector_blocks(df: DataFrame, vec: str, dim: int, block: int) -> DataFrame:
    """df with its vectors in blocks: adds `_b`, the block's number, and cuts `vec` to it."""
    numbers = F.sequence(F.lit(0), F.lit(-(-dim // block) - 1))
    return df.withColumn("_b", F.explode(numbers)).withColumn(vec, F.slice(vec, F.col("_b") * block + 1, F.lit(block)))


def joined_blocks(df: DataFrame, keys: Sequence[str], name: str, dim: int) -> DataFrame:
    """The vectors of (keys, _b, name) put together again."""
    blocks = F.array_sort(F.collect_list(F.struct("_b", name)))
    whole = df.groupBy(*keys).agg(blocks.alias("_all"))
    return whole.select(*keys, F.slice(F.flatten(F.transform("_all", lambda b: b[name])), 1, dim).alias(name))


def vector_agg(df: DataFrame, keys: Sequence[str], vec: str, dim: int, how: str, name: str = "agg", block: int = BLOCK) -> DataFrame:
    """Elementwise mean, max or sum of vectors without NULL elements.

    A mean keeps one sum per dimension and a single count, half the buffers of `dim` averages.
    """
    if dim > block:
        cut = vector_blocks(df.select(*keys, vec), vec, dim, block)
        return joined_blocks(vector_agg(cut, [*keys, "_b"], vec, block, how, name, block), keys, name, dim)
    fn = F.max if how == "max" else F.sum
    parts = [f"_d{i}" for i in range(dim)]
    columns = [fn(F.get(vec, F.lit(i)).cast("double")).alias(p) for i, p in enumerate(parts)]
    reduced = df.groupBy(*keys).agg(*columns, F.count(vec).alias("_n"))
    values = [F.col(p) / F.col("_n") if how == "mean" else F.col(p) for p in parts]
    return reduced.select(*keys, F.array(*values).alias(name))


# Rows of ids in one task that aggregates; what is broadcast to it.
GROUP_ROWS = 1_000_000
MAX_BYTES = 64 << 20


def _written(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows that are read several times, and into how many parts they go by keys. The number is fixed,
    because the rows become much wider after they are placed."""
    rows = freeze(rows, "ids")
    parts = -(-rows.count() // GROUP_ROWS)
    return rows, max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _aggregated(rows: DataFrame, placed: DataFrame, feats: DataFrame, keys: Sequence[str], dim: int, how: str, value=None,
                max_bytes: int | None = None) -> DataFrame:
    """(keys, agg) of the vectors of `placed`: rows (keys, id, ...) that lie together by their keys; `rows`
    are the same, written. value: what is aggregated, of a row with `feat`; feat itself if None."""
    def parts(of: DataFrame) -> DataFrame:
        return of.withColumn("feat", value) if value is not None else of

    uses = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_uses"))
    wanted = freeze(feats.select("id", "feat").join(uses, "id"), "wanted-vectors")
    n, width = wanted.agg(F.count(F.lit(1)), F.max(F.size("feat"))).first()
    most = (MAX_BYTES if max_bytes is None else max_bytes) // (32 + 8 * max(width or 0, 0))
    if n <= most:
        near = placed.join(F.broadcast(wanted.drop("_uses")), "id")
        return vector_agg(parts(near), keys, "feat", dim, how)
    # one vector in so many bytes: the most used ids, all rows of an id on the same side
    often = freeze(wanted.groupBy("id").agg(F.max("_uses").alias("_uses"), F.count(F.lit(1)).alias("_n"))
                   .orderBy(F.desc("_uses"), "id").limit(most).filter("_n = 1").select("id"), "often-used")
    few = F.broadcast(often)
    near = placed.join(F.broadcast(wanted.join(few, "id", "left_semi").drop("_uses")), "id")
    far = placed.join(few, "id", "left_anti").join(wanted.join(few, "id", "left_anti").drop("_uses"), "id")
    return vector_agg(parts(near.unionByName(far)), keys, "feat", dim, how)


def neighbor_aggregate(samples: DataFrame, feats: DataFrame, dim: int, how: str = "mean",
                       keys: Sequence[str] = ROOT_KEYS) -> DataFrame:
    """Mean / max / sum / self-inclusive mean ("gcn") of the neighbours' vectors per root."""
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    neighbors = samples.select(*keys, F.col("src_node").alias("id"))
    if how == "gcn":
        pairs = freeze(samples.select(*keys, "root_node", F.col("src_node").alias("id")), "neighbors")
        selves = pairs.select(*keys, F.col("root_node").alias("id")).distinct()
        neighbors, how = pairs.drop("root_node").unionByName(selves), "mean"
    rows, parts = _written(neighbors, keys)
    return _aggregated(rows, rows.repartition(parts, *keys), feats, keys, dim, how)


def neighbor_sum(samples: DataFrame, value: str, keys: Sequence[str] = ROOT_KEYS, name: str = "total") -> DataFrame:
    return samples.groupBy(*keys).agg(F.sum(value).alias(name))


def segment_softmax(samples: DataFrame, score: str, keys: Sequence[str] = ROOT_KEYS,
                    name: str = "weight", bounded: bool = True) -> DataFrame:
    """Softmax of the scores of one root's edges, shifted by the maximum.

    Sampled edges come at most `fanout` per root, so a window is safe; for any other grouping pass
    bounded=False, which aggregates with map-side combine and joins the results back.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        raised = samples.withColumn("_x", F.exp(F.col(score) - F.max(score).over(group)))
        return raised.withColumn(name, F.col("_x") / F.sum("_x").over(group)).drop("_x")
    peaks = samples.groupBy(*keys).agg(F.max(score).alias("_m"))
    raised = samples.join(peaks, list(keys)).withColumn("_x", F.exp(F.col(score) - F.col("_m"))).drop("_m")
    # written, so that the sum combines on the map side and both joins may split a hot group
    raised = freeze(raised, "softmax")
    sums = raised.groupBy(*keys).agg(F.sum("_x").alias("_s"))
    return raised.join(sums, list(keys)).withColumn(name, F.col("_x") / F.col("_s")).drop("_x", "_s")


def weighted_neighbor_sum(samples: DataFrame, roots: DataFrame, feats: DataFrame, score: str, dim: int,
                          keys: Sequence[str] = ("rid",)) -> DataFrame:
    """Softmax-weighted sum of neighbour vectors; zeros for roots without neighbours."""
    rows, parts = _written(samples.select(*keys, F.col("src_node").alias("id"), score), keys)
    weighted = segment_softmax(rows.repartition(parts, *keys), score, keys).drop(score)
    scaled = F.transform("feat", lambda x: x.cast("double") * F.col("weight"))
    sums = _aggregated(rows, weighted, feats, keys, dim, "sum", scaled).withColumnRenamed("agg", "_sum")
    return (roots.join(sums, list(keys), "left")
            .withColumn("agg", F.coalesce("_sum", F.array_repeat(F.lit(0.0), dim))).drop("_sum"))
