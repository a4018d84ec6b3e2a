"""Batches of consecutive edges, and seeded negative draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..plans.ordering import dense_ordinal, running_sum

ROLES = ("src", "dst", "neg")


def _ordered(edges: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Edges with their global position; an `ord` that is already there is used as it is."""
    return edges if "ord" in edges.columns else dense_ordinal(edges, order_by)


def fixed_batches(edges: DataFrame, size: int, order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """`ord` = global position, `batch_id` = ord div size, `pos` = position in the batch."""
    ordered = _ordered(edges, order_by)
    return ordered.withColumns({"batch_id": F.floor(F.col("ord") / size), "pos": F.col("ord") % size})


def random_start_trim(edges: DataFrame, size: int, chunks: int, r: int,
                      order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """Skip the first r*size div chunks rows; later rows keep their batch boundaries."""
    skip = r * size // chunks if chunks else 0
    kept = fixed_batches(edges, size, order_by).filter(F.col("ord") >= skip)
    first = F.floor(F.lit(skip) / size)
    return kept.withColumn("pos", F.when(F.col("batch_id") == first, F.col("ord") - skip).otherwise(F.col("pos")))


def random_start_short(edges: DataFrame, size: int, chunks: int, r: int, drop_last: bool = False,
                       order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """First batch of r*(size div chunks) rows, then full ones; nothing is skipped."""
    if not 0 < chunks < size:
        raise ValueError("chunks must be in (0, size)")
    first = r * (size // chunks)
    ordered = _ordered(edges, order_by)
    rest = F.col("ord") - first
    lead = 1 if first else 0
    out = ordered.withColumns({
        "batch_id": F.when(F.col("ord") < first, F.lit(0).cast("bigint")).otherwise(lead + F.floor(rest / size)),
        "pos": F.when(F.col("ord") < first, F.col("ord")).otherwise(rest % size)})
    if drop_last:
        total = ordered.count()
        whole = first + max(0, total - first) // size * size
        # a first batch that never filled up is incomplete too
        out = out.filter(F.col("ord") < (whole if total >= first else 0))
    return out


def rank_shard(edges: DataFrame, rank: int, world: int, size: int | None = None,
               order_by: Sequence[str] = ("eid",)) -> DataFrame:
    """Every world-th row from `rank` on, renumbered by arithmetic, optionally batched."""
    ordered = _ordered(edges, order_by)
    mine = ordered.filter(F.pmod("ord", F.lit(world)) == rank).withColumn("ord", F.floor((F.col("ord") - rank) / world))
    if size is None:
        return mine
    return mine.withColumns({"batch_id": F.floor(F.col("ord") / size), "pos": F.col("ord") % size})


def _stack(batches: DataFrame, roles: Sequence[tuple[str, Column]]) -> DataFrame:
    """`roles` are (name, node) in their order. Positions are dense even where `pos` has gaps."""
    # a batch group never exceeds the batch size
    batch = Window.partitionBy("batch_id")
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(role).alias("role"), node.alias("node"))
                      for i, (role, node) in enumerate(roles)])
    dense = (F.row_number().over(batch.orderBy("pos")) - 1).cast("bigint")
    return (batches.withColumns({"_len": F.count(F.lit(1)).over(batch), "pos": dense}).withColumn("_p", F.explode(parts))
            .select("batch_id", (F.col("_p.i") * F.col("_len") + F.col("pos")).alias("pos"),
                    F.col("_p.role").alias("role"), F.col("_p.node").alias("node"), "ts",
                    F.when(F.col("_p.i") == 0, F.col("eid")).alias("eid")))


def target_triples(batches: DataFrame, neg_ratio: int = 1) -> DataFrame:
    """src, dst and neg stacked per batch: position role*len + i; eid only on the src row.

    With neg_ratio > 1, `negs` (see negative_dst) follow as so many blocks of role neg.
    """
    negs = [F.col("neg")] if neg_ratio == 1 else [F.get("negs", F.lit(r)) for r in range(neg_ratio)]
    return _stack(batches, [("src", F.col("src")), ("dst", F.col("dst")), *(("neg", n) for n in negs)])


def target_pairs(batches: DataFrame) -> DataFrame:
    return _stack(batches, [(role, F.col(role)) for role in ROLES[:2]])


def id_pool(ids: DataFrame, column: str) -> DataFrame:
    """Distinct ids numbered densely in id order: (idx, id)."""
    return dense_ordinal(ids.select(F.col(column).alias("id")).distinct(), ["id"], "idx").select("idx", "id")


def dst_pool(edges: DataFrame) -> DataFrame:
    return id_pool(edges, "dst")


def extend_pool(pool: DataFrame, edges: DataFrame, column: str = "dst") -> DataFrame:
    """Union new destinations into the pool and renumber."""
    return id_pool(pool.select("id").union(edges.select(column)), "id")


def dst_pools(train: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pool of training destinations, and of training plus remaining destinations."""
    first = dst_pool(train)
    return first, extend_pool(first, rest)


def pool_size(pool: DataFrame) -> int:
    highest = pool.agg(F.max("idx")).first()[0]
    if highest is None:
        raise ValueError("nothing can be drawn from an empty pool")
    return highest + 1


def draw_from_pool(requests: DataFrame, pool: DataFrame, key: str | Column, seed: int,
                   name: str = "neg", salt: str = "dst") -> DataFrame:
    """Add a uniform draw from the pool for every request row; `key` identifies the row."""
    key = F.col(key) if isinstance(key, str) else key
    picked = requests.withColumn("_idx", draw(pool_size(pool), seed, salt, key))
    return picked.join(pool.select(F.col("idx").alias("_idx"), F.col("id").alias(name)), "_idx").drop("_idx")


def negative_dst(batches: DataFrame, pool: DataFrame, seed: int, key: str = "ord",
                 exclude: DataFrame | None = None, neg_ratio: int = 1, strategy: str = "auto") -> DataFrame:
    """A negative destination `neg` for every positive edge; with neg_ratio > 1 an array `negs`.

    With `exclude` (edges) a negative is drawn from the destinations of the pool that the source has
    no edge to; it is null only if the source has an edge to all of them. No positive is ever lost.
    """
    if neg_ratio == 1:
        return _negatives(batches, pool, seed, [F.col(key)], exclude, strategy)
    # the first draw has the key of a single one
    spread = batches.select(key, "src", F.explode(F.sequence(F.lit(0), F.lit(neg_ratio - 1))).alias("_r"))
    parts = [F.when(F.col("_r") == 0, F.col(key).cast("string")).otherwise(F.concat_ws("|", key, "_r"))]
    drawn = _negatives(spread, pool, seed, parts, exclude, strategy)
    # neg_ratio rows per key
    negs = F.transform(F.array_sort(F.collect_list(F.struct("_r", "neg"))), lambda x: x.neg)
    return batches.join(drawn.groupBy(key).agg(negs.alias("negs")), key)


def _negatives(requests: DataFrame, pool: DataFrame, seed: int, key: list[Column],
               exclude: DataFrame | None, strategy: str) -> DataFrame:
    if exclude is None:
        return draw_from_pool(requests, pool, key[0], seed)
    size = pool_size(pool)
    ids = pool.select("idx", F.col("id").alias("neg"))
    # A source's taken indices in order: the i-th of them, less i - 1, is the number of free
    # indices below it. The j-th free index is j plus the taken ones that have at most j below.
    taken = (exclude.select("src", F.col("dst").alias("neg")).distinct().join(ids, "neg").select("src", "idx"))
    below = (running_sum(taken, ["src"], ["idx"], {"_i": F.lit(1)}, strategy)
             .select("src", (F.col("idx") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_asks")))
    free = taken.groupBy("src").agg((F.lit(size) - F.count(F.lit(1))).alias("_free"))
    asked = (requests.join(free, "src", "left").withColumn("_free", F.coalesce("_free", F.lit(size)))
             .withColumn("_at", F.when(F.col("_free") > 0, draw(F.col("_free"), seed, "dst", *key))))
    asks = asked.filter("_at IS NOT NULL").drop("_free").withColumn("_asks", F.lit(1))
    marks = asks.unionByName(below, allowMissingColumns=True)
    order = ["_at", "_asks", *[c for c in ("ord", "eid", "_r") if c in requests.columns]]
    placed = (running_sum(marks, ["src"], order, {"_skip": 1 - F.col("_asks")}, strategy).filter("_asks = 1")
              .withColumn("idx", F.col("_at") + F.col("_skip")).drop("_at", "_asks", "_skip"))
    none = asked.filter("_at IS NULL").drop("_free", "_at").withColumn("neg", F.lit(None).cast("bigint"))
    return placed.join(ids, "idx").drop("idx").unionByName(none)


def random_edges(edges: DataFrame, requests: DataFrame, seed: int, key: str = "ord") -> DataFrame:
    """Independent uniform sources and destinations, one pair per request row."""
    heads = draw_from_pool(requests.select(key), id_pool(edges, "src"), key, seed, "src", "src")
    return draw_from_pool(heads, dst_pool(edges), key, seed, "dst", "dst")


def negative_node(requests: DataFrame, num_nodes: int, seed: int, key: str = "ord") -> DataFrame:
    """Uniform node in [0, num_nodes) per request row; no join."""
    return requests.withColumn("neg", draw(num_nodes, seed, "node", F.col(key)))
