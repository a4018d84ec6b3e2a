"""Ordinals and running sums that do not depend on how large one key's group is.

A window over `PARTITION BY key ORDER BY ...` sorts a whole key in one task. That is the best plan
for small keys, and they keep it. Keys that are counted to be larger are taken apart: their rows are
range-partitioned on (keys, order), a hot key then covers many partitions, each partition sums its
own rows, and a table with at most one row per partition carries the sums on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import freeze

# Rows of one key that a single task may sort; overridable with spark.tidegraph.maxGroupRows.
MAX_GROUP_ROWS = 4_000_000


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tidegraph.maxGroupRows", str(MAX_GROUP_ROWS)))


def by_group_size(df: DataFrame, keys: Sequence[str], strategy: str, plain: Callable[[DataFrame], DataFrame],
                  ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`plain` for the keys whose rows fit one task, `ranged` for the others only; both give the same rows.

    "auto" counts the rows of every key once, combined on the map side. Keys above the limit are
    fewer than rows / limit, so their table may be broadcast. "plain" and "ranged" skip the count.
    """
    if strategy not in ("auto", "plain", "ranged"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy != "auto":
        return plain(df) if strategy == "plain" else ranged(df)
    limit = max_group_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = freeze(sizes.filter(F.col("_rows") > limit).select(*keys), "hot-keys")
    if hot.isEmpty():
        return plain(df)
    few = F.broadcast(hot)
    return plain(df.join(few, list(keys), "left_anti")).unionByName(ranged(df.join(few, list(keys), "left_semi")))


def _partition_offsets(spark: SparkSession, rows: list[tuple], sums: Sequence[str],
                       start: Sequence[int] | None = None, sum_type: str = "bigint") -> DataFrame:
    """Exclusive prefix sums over partitions. `rows` holds one (pid, sums...) tuple per partition."""
    rows = sorted(rows)
    types = ", ".join(f"_off_{name} {sum_type}" for name in sums)
    columns = []
    for i, _ in enumerate(sums):
        first = start[i] if start else (0 if sum_type == "bigint" else Decimal(0))
        columns.append(list(accumulate((row[1 + i] or 0 for row in rows), initial=first))[:-1])
    out = [(row[0], *(column[j] for column in columns)) for j, row in enumerate(rows)]
    return spark.createDataFrame(out, f"_pid int, {types}")


def dense_ordinal(df: DataFrame, order_by: Sequence[str], name: str = "ord", start: int = 0) -> DataFrame:
    """Number the rows start, start+1, ... in the total order `order_by`, without a one-task sort.

    Range shuffle, sort inside partitions, position inside the partition, then the offset of the
    partition. Only the row count of each partition reaches the driver.
    """
    placed = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
              .withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id() is documented as (partition << 33) + position in partition
    frozen = freeze(placed.withColumn("_pid", F.shiftright("_at", 33).cast("int"))
                    .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ordinal")
    counts = [(r[0], r[1]) for r in frozen.groupBy("_pid").count().collect()]
    offsets = _partition_offsets(df.sparkSession, counts, ["n"], [start])
    return (frozen.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_at") + F.col("_off_n"))
            .drop("_at", "_pid", "_off_n"))


def running_sum(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                sums: dict[str, Column], strategy: str = "auto", big: bool = False) -> DataFrame:
    """Add inclusive running sums of integer expressions per key in the total order `order_by`.

    The sums are bigint, or decimal(38,0) with big=True.

    strategy: "plain" (one window per key), "ranged" (safe for any key size), or "auto", which
    measures the largest group. Without keys the plan is always ranged.
    """
    keys, order_by = list(keys), list(order_by)
    each, total = ("decimal(28,0)", "decimal(38,0)") if big else ("bigint", "bigint")

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c.cast(each)).over(window).cast(total) for n, c in sums.items()}) \
            .select(*df.columns, *sums)

    def ranged(rows: DataFrame) -> DataFrame:
        return _running_sum_ranged(rows, keys, order_by, sums, each, total)

    return by_group_size(df, keys, strategy, plain, ranged) if keys else ranged(df)


def _running_sum_ranged(df: DataFrame, keys: list[str], order_by: list[str], sums: dict[str, Column], each: str,
                        total: str) -> DataFrame:
    names = list(sums)
    valued = df.withColumns({f"_val_{n}": c.cast(each) for n, c in sums.items()})
    ranged = freeze(valued.repartitionByRange(*keys, *order_by)
                    .withColumn("_pid", F.spark_partition_id()), "ranged")
    window = (Window.partitionBy("_pid", *keys).orderBy(*order_by)
              .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.withColumns({n: F.sum(f"_val_{n}").over(window) for n in names})
    totals = ranged.groupBy("_pid", *keys).agg(*[F.sum(f"_val_{n}").alias(f"_tot_{n}") for n in names])
    if keys:
        # One row per (partition, key); only a key continued from an earlier partition carries
        # anything, and at most one key per partition is continued: bounded by the partitions.
        # The cluster settings give that bound, so this side may be broadcast.
        earlier = Window.partitionBy(*keys).orderBy("_pid")
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        carry = (totals.withColumns({f"_off_{n}": F.sum(f"_tot_{n}").over(before) for n in names}
                                    | {"_nth": F.row_number().over(earlier)})
                 .filter("_nth > 1").drop("_nth", *[f"_tot_{n}" for n in names]))
        joined = local.join(F.broadcast(carry), ["_pid", *keys], "left")
    else:
        rows = [tuple(r) for r in totals.collect()]
        offsets = _partition_offsets(df.sparkSession, rows, names, sum_type=total)
        joined = local.join(F.broadcast(offsets), "_pid", "left")
    return (joined.withColumns({n: (F.col(n) + F.coalesce(f"_off_{n}", F.lit(0))).cast(total) for n in names})
            .select(*df.columns, *names))
