"""Splitting a graph over P partitions by source node, and how good a split is.

Assignments are sticky: a source in the table keeps its partition, and its edges follow it. The
greedy one-node-at-a-time assignments are expressed as prefix sums or as rounds against a frozen
table, so they parallelise; the result is a different (restreaming-style) assignment than a
sequential run would give, with the same score and capacity rules.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..plans.ordering import dense_ordinal, running_sum
from ..plans.storage import freeze
from .graph import nodes

def _check(parts: int) -> None:
    if parts < 1:
        raise ValueError("there must be at least one partition")


def empty_ptable(spark) -> DataFrame:
    return spark.createDataFrame([], "node long, pid int")


def new_sources(edges: DataFrame, ptable: DataFrame | None = None) -> DataFrame:
    """Distinct sources that have no partition yet."""
    sources = edges.select(F.col("src").alias("node")).distinct()
    return sources if ptable is None else sources.join(ptable.select("node"), "node", "left_anti")


def _extend(ptable: DataFrame | None, fresh: DataFrame) -> DataFrame:
    fresh = fresh.select("node", F.col("pid").cast("int").alias("pid"))
    return fresh if ptable is None else ptable.select("node", "pid").unionByName(fresh)


def partition_hash(edges: DataFrame, parts: int, ptable: DataFrame | None = None) -> DataFrame:
    _check(parts)
    fresh = new_sources(edges, ptable)
    return _extend(ptable, fresh.withColumn("pid", F.pmod(stable_hash(F.col("node")), F.lit(parts))))


def partition_round_robin(edges: DataFrame, parts: int, ptable: DataFrame | None = None) -> DataFrame:
    """The i-th new source in id order goes to partition i mod P."""
    _check(parts)
    fresh = dense_ordinal(new_sources(edges, ptable), ["node"])
    return _extend(ptable, fresh.withColumn("pid", F.pmod("ord", F.lit(parts))))


# The exponent and the slacks of the published scores.
GAMMA, UPSILON, SLACK = 1.5, 1.1, 1.25

WEIGHTS = ("edgecount", "timestampsum", "timestampavg")


def partition_balanced(edges: DataFrame, parts: int, weight: str = "edgecount",
                       ptable: DataFrame | None = None) -> DataFrame:
    """New sources in id order, cut where the running weight crosses total/P.

    With an earlier table the new sources are laid end to end over the room below one common level,
    the least loaded partitions first: loads continue from what the partitions hold. Time weights
    count from the earliest edge and are summed exactly (decimal).
    """
    _check(parts)
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    rows = edges.select(F.col("src").alias("node"), "ts")
    if weight == "edgecount":
        per_node = rows.groupBy("node").agg(F.count(F.lit(1)).cast("decimal(28,0)").alias("w"))
    else:
        origin = rows.agg(F.min("ts")).first()[0] or 0
        total = F.sum((F.col("ts") - F.lit(origin)).cast("decimal(28,0)"))
        value = total if weight == "timestampsum" else F.floor(total / F.count(F.lit(1)))
        per_node = rows.groupBy("node").agg(value.cast("decimal(28,0)").alias("w"))
    if ptable is not None:
        held = _loads(ptable.join(per_node, "node", "left"), parts, F.sum("w"))
        per_node = per_node.join(ptable.select("node"), "node", "left_anti")
        if any(held):
            return _extend(ptable, _fill(freeze(per_node, "weights"), held, "w", parts, ["node"], big=True))
    summed = freeze(running_sum(per_node, [], ["node"], {"cum": F.col("w")}, big=True), "weights")
    total = summed.agg(F.max("cum")).first()[0] or 0
    if total == 0:
        return _extend(ptable, summed.withColumn("pid", F.lit(0)))
    share = F.expr(f"least({parts - 1}L, ({parts} * (cum - w)) div cast({total} as decimal(38,0)))")
    return _extend(ptable, summed.withColumn("pid", share))


def _loads(table: DataFrame, parts: int, value: Column) -> list[int]:
    """One number per partition on the driver."""
    got = {r[0]: r[1] for r in table.filter("pid is not null").groupBy("pid").agg(value).collect()}
    return [int(got.get(i) or 0) for i in range(parts)]


def _per_partition(spark: SparkSession, values: list, name: str, kind: str) -> DataFrame:
    """One row per partition, for a broadcast join."""
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), f"pid int, {name} {kind}"))


def _place(score: Column, pid: Column) -> Column:
    """Compares as: the higher score, then the lower partition."""
    return F.struct(score.cast("double").alias("score"), (-pid).cast("int").alias("minus"))


def _pair_counts(edges: DataFrame) -> DataFrame:
    """Edges per (node, dst): the rows of a hot source are spread over its destinations."""
    return edges.groupBy(F.col("src").alias("node"), "dst").agg(F.count(F.lit(1)).alias("c"))


def _fennel_choice(pairs: DataFrame, fresh: DataFrame, ptable: DataFrame, sizes: list[int], alpha: float,
                   gamma: float, capacity: float) -> DataFrame:
    """One row per node and partition that has neighbours of it; of the others only the best counts,
    which is the same for every node."""
    mine = pairs.join(fresh.select("node"), "node", "left_semi")
    placed = mine.join(ptable.select(F.col("node").alias("dst"), F.col("pid").cast("int").alias("pid")), "dst", "left")
    prices = [alpha * gamma * size ** (gamma - 1) if size < capacity else None for size in sizes]
    near = placed.groupBy("node", "pid").agg(F.sum("c").alias("c")).join(_per_partition(pairs.sparkSession, prices, "price", "double"), "pid", "left")
    best = near.groupBy("node").agg(F.max(F.when(F.col("price").isNotNull(), _place(F.col("c") - F.col("price"), F.col("pid")))).alias("best"))
    open_ = [(-price, -i) for i, price in enumerate(prices) if price is not None]
    if not open_:
        return best.select("node", F.lit(sizes.index(min(sizes))).alias("pid"))
    score, minus = max(open_)
    return best.select("node", (-F.greatest("best", _place(F.lit(score), F.lit(-minus)))["minus"]).alias("pid"))


def _fennel_terms(edges: DataFrame, parts: int, upsilon: float) -> tuple[float, float]:
    """alpha and the capacity of a partition, from the numbers of edges and of distinct nodes."""
    num_edges, num_nodes = edges.count(), nodes(edges).count()
    return parts ** 0.5 * num_edges / max(num_nodes, 1) ** 1.5, num_nodes * upsilon / parts


def fennel_round(edges: DataFrame, ptable: DataFrame, parts: int, upsilon: float = UPSILON,
                 gamma: float = GAMMA) -> DataFrame:
    """Choice (node, pid) of every new source against the frozen table.

    Score: neighbours in the partition - alpha * gamma * size**(gamma-1); full partitions are
    excluded, and if all are full the smallest takes the node.
    """
    alpha, capacity = _fennel_terms(edges, parts, upsilon)
    sizes = _loads(ptable, parts, F.count(F.lit(1)))
    return _fennel_choice(_pair_counts(edges), new_sources(edges, ptable), ptable, sizes, alpha, gamma, capacity)


def _fennel_edge_choice(pairs: DataFrame, fresh: DataFrame, owned: DataFrame, loads: list[int],
                        limit: float) -> DataFrame:
    mine = pairs.join(fresh.select("node"), "node", "left_semi")
    placed = mine.join(owned.select(F.col("node").alias("dst"), F.col("pid").cast("int").alias("pid"), F.col("degree").alias("theirs")), "dst", "left")
    near = placed.groupBy("node", "pid").agg(F.sum("c").alias("c"), F.sum(F.col("c") + F.col("theirs")).alias("local"))
    near = near.join(mine.groupBy("node").agg(F.sum("c").alias("degree")), "node").join(_per_partition(pairs.sparkSession, loads, "load", "bigint"), "pid", "left")
    fits = F.col("degree") + F.col("load") <= limit
    best = near.groupBy("node", "degree").agg(F.max(F.when(fits, _place(F.col("local") - F.col("load"), F.col("pid")))).alias("best"))
    # of partitions without neighbours the least loaded is the best, and if it has no room none has
    least = loads.index(min(loads))
    empty = F.when(F.col("degree") + min(loads) <= limit, _place(F.lit(-min(loads)), F.lit(least)))
    chosen = -F.greatest("best", empty)["minus"]
    return best.select("node", F.coalesce(chosen, F.lit(least)).alias("pid"), "degree")


def _with_degree(ptable: DataFrame, degree: DataFrame) -> DataFrame:
    return ptable.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def fennel_edge_round(edges: DataFrame, ptable: DataFrame, parts: int, slack: float = SLACK) -> DataFrame:
    """Choice (node, pid, degree) against the frozen table, by locality minus edge load.

    Locality: edges into the partition plus the out-degrees of the distinct neighbours there.
    Partitions whose load would exceed slack * mean are excluded; if all are, the least loaded
    takes the node.
    """
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    owned = _with_degree(ptable, degree)
    loads = _loads(owned, parts, F.sum("degree"))
    limit = slack * edges.count() / parts
    return _fennel_edge_choice(_pair_counts(edges), new_sources(edges, ptable), owned, loads, limit)


def _literal_map(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _commit(table: DataFrame, choices: DataFrame, loads: list[int], capacity: float, weight: str) -> DataFrame:
    """The table plus the choices that still fit: smallest weight first, running load <= capacity."""
    choices = freeze(choices, "choices")
    summed = running_sum(choices, ["pid"], [weight, "node"], {"_cum": F.col(weight)})
    fits = F.get(_literal_map(loads), F.col("pid")) + F.col("_cum") <= F.lit(float(capacity))
    return freeze(_extend(table, summed.filter(fits)), "ptable")


def _fill(left: DataFrame, loads: list[int], weight: str, parts: int, order_by: list[str] | None = None,
          big: bool = False) -> DataFrame:
    """Nodes no partition had room for: laid end to end over the room below one common level.

    The level takes the remaining weight exactly; the least loaded partitions are filled first.
    """
    summed = running_sum(left, [], order_by or [weight, "node"], {"_cum": F.col(weight)}, big=big)
    total = int(left.agg(F.sum(weight)).first()[0] or 0)
    order = sorted(range(parts), key=lambda i: (loads[i], i))
    below = [0, *accumulate(loads[i] for i in order)]
    used = next(u for u in range(1, parts + 1)
                if u == parts or total + below[u] <= u * loads[order[u]])
    starts = [-((used * below[i] - i * (total + below[used])) // used) for i in range(1, used)]
    if not starts:
        return summed.select("node", F.lit(order[0]).alias("pid"))
    at, kind = F.col("_cum") - F.col(weight), "decimal(38,0)" if big else "bigint"
    passed = F.size(F.filter(F.array(*[F.lit(Decimal(v) if big else v).cast(kind) for v in starts]), lambda v: v <= at))
    pid = F.get(F.array(*map(F.lit, order[:used])), passed)
    return summed.withColumn("pid", pid).select("node", "pid")


def partition_fennel(edges: DataFrame, parts: int, upsilon: float = UPSILON, gamma: float = GAMMA, rounds: int = 4,
                     ptable: DataFrame | None = None) -> DataFrame:
    """Rounds of fennel_round over hash slices of the new sources; each round sees the ones before.

    What does not fit in a round is tried again in the next; the rest fills the free room evenly.
    The edges are read once, as counts per (node, dst).
    """
    _check(parts)
    table = freeze(ptable if ptable is not None else empty_ptable(edges.sparkSession), "ptable")
    alpha, capacity = _fennel_terms(edges, parts, upsilon)
    pairs = freeze(_pair_counts(edges), "pairs")
    one = F.lit(1).cast("bigint").alias("w")
    waiting = freeze(pairs.select("node").distinct().join(table.select("node"), "node", "left_anti")
                     .select("node", F.pmod(stable_hash(F.col("node")), F.lit(rounds)).alias("_slice"), one), "waiting")
    sizes = _loads(table, parts, F.count(F.lit(1)))
    for r in range(rounds):
        turn = waiting.filter(F.col("_slice") <= r).join(table.select("node"), "node", "left_anti")
        choices = _fennel_choice(pairs, turn, table, sizes, alpha, gamma, capacity).select("*", one)
        table = _commit(table, choices, sizes, capacity, "w")
        sizes = _loads(table, parts, F.count(F.lit(1)))
    left = waiting.join(table.select("node"), "node", "left_anti")
    return table if left.isEmpty() else _extend(table, _fill(left, sizes, "w", parts))


def partition_fennel_edge(edges: DataFrame, parts: int, rounds: int = 4, slack: float = SLACK,
                          ptable: DataFrame | None = None) -> DataFrame:
    """Rounds of fennel_edge_round, small degrees first: each round takes the next slice by degree."""
    _check(parts)
    table = freeze(ptable if ptable is not None else empty_ptable(edges.sparkSession), "ptable")
    pairs = freeze(_pair_counts(edges), "pairs")
    degree = freeze(pairs.groupBy("node").agg(F.sum("c").alias("degree")), "degree")
    limit = slack * (degree.agg(F.sum("degree")).first()[0] or 0) / parts
    waiting = freeze(dense_ordinal(degree.join(table.select("node"), "node", "left_anti"), ["degree", "node"]), "waiting")
    n = waiting.count()
    owned = _with_degree(table, degree)
    loads = _loads(owned, parts, F.sum("degree"))
    for r in range(rounds):
        turn = (waiting.filter(F.col("ord") < (n * (r + 1)) // rounds)
                .join(table.select("node"), "node", "left_anti"))
        table = _commit(table, _fennel_edge_choice(pairs, turn, owned, loads, limit), loads, limit, "degree")
        owned = _with_degree(table, degree)
        loads = _loads(owned, parts, F.sum("degree"))
    left = waiting.select("node", "degree").join(table.select("node"), "node", "left_anti")
    return table if left.isEmpty() else _extend(table, _fill(left, loads, "degree", parts))


def assign_by_dst_majority(edges: DataFrame, ptable: DataFrame) -> DataFrame:
    """New sources take the most common partition among their assigned destinations (ties: lowest)."""
    mine = edges.select(F.col("src").alias("node"), "dst").join(ptable.select("node"), "node", "left_anti")
    votes = (mine.join(ptable.select(F.col("node").alias("dst"), "pid"), "dst")
             .groupBy("node", "pid").agg(F.count(F.lit(1)).alias("c")))
    best = votes.groupBy("node").agg(F.max_by("pid", F.struct("c", -F.col("pid"))).alias("pid"))
    return _extend(ptable, best)


def dispatch_by_source(edges: DataFrame, ptable: DataFrame) -> DataFrame:
    """Edges with the partition of their source; NULL while the source has none."""
    return edges.join(ptable.select(F.col("node").alias("src"), "pid"), "src", "left")


def assign_residual(nodes: DataFrame, ptable: DataFrame, parts: int) -> DataFrame:
    """Nodes that never are a source, round-robin in id order; returns the merged table."""
    rest = nodes.select("node").distinct().join(ptable.select("node"), "node", "left_anti")
    return _extend(ptable, dense_ordinal(rest, ["node"]).withColumn("pid", F.pmod("ord", F.lit(parts))))


def _cascade(sizes: list[int]) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Intervals (pid, lo, hi, new_pid, base) of row ordinals after passing overflow downwards.

    The largest partition passes everything beyond the mean to the next smaller one, which appends
    it, and so on; what exceeds the mean in the smallest is left out.
    """
    parts = len(sizes)
    mean = sum(sizes) // parts
    order = sorted(range(parts), key=lambda i: (sizes[i], i))
    moved: list[tuple[int, int, int]] = []
    out = []
    for pid in reversed(order):
        pieces, filled, extra = [(pid, 0, sizes[pid]), *moved], 0, []
        for origin, lo, hi in pieces:
            take = min(hi - lo, mean - filled)
            if take > 0:
                out.append((origin, lo, lo + take, pid, filled))
                filled += take
            if lo + take < hi:
                extra.append((origin, lo + take, hi))
        moved = extra
    return mean, out


def equalize(edges: DataFrame, parts: int, order_by: tuple[str, ...] = ("eid",)) -> DataFrame:
    """Bring every partition to the mean size: `new_pid` and the position `pos` inside it.

    Only P sizes reach the driver; each row finds its interval by its ordinal in its partition.
    """
    _check(parts)
    placed = edges.filter(F.col("pid").isNotNull())
    counted = running_sum(placed, ["pid"], list(order_by), {"_n": F.lit(1)})
    sizes = _loads(placed, parts, F.count(F.lit(1)))
    _, moves = _cascade(sizes)
    by_pid = [(pid, sorted((hi, lo, new, base) for origin, lo, hi, new, base in moves if origin == pid))
              for pid in range(parts)]
    plan = edges.sparkSession.createDataFrame(
        by_pid, "pid int, _moves array<struct<hi:bigint,lo:bigint,new_pid:int,base:bigint>>")
    at = F.col("_n") - 1
    # at most P intervals per partition, and P rows in all
    hit = F.get(F.filter("_moves", lambda m: (m["lo"] <= at) & (at < m["hi"])), F.lit(0))
    return (counted.join(F.broadcast(plan), "pid").withColumn("_m", hit).filter("_m is not null")
            .withColumns({"new_pid": F.col("_m.new_pid"), "pos": F.col("_m.base") + at - F.col("_m.lo")})
            .drop("_m", "_moves", "_n"))


def interleave_workers(edges: DataFrame, workers: int, pid: str = "new_pid") -> DataFrame:
    """Row j of a partition goes to worker j mod L; the trailing remainder is dropped."""
    sizes = edges.groupBy(pid).agg(F.count(F.lit(1)).alias("_size"))
    whole = F.col("_size") - F.col("_size") % workers
    # one row per partition of the graph
    return (edges.join(F.broadcast(sizes), pid).filter(F.col("pos") < whole)
            .withColumn("worker", (F.col("pos") % workers).cast("int")).drop("_size"))


def place_edge_features(feats: DataFrame, edges: DataFrame, ptable: DataFrame) -> DataFrame:
    """Edge features go where the source of their edge is."""
    owner = dispatch_by_source(edges, ptable).groupBy("eid").agg(F.min_by("pid", "seq").alias("pid"))
    return feats.join(owner, "eid")


def place_node_features(feats: DataFrame, ptable: DataFrame, key: str = "id") -> DataFrame:
    """Node features and node state go where the node is."""
    return feats.join(ptable.select(F.col("node").alias(key), "pid"), key)


def partition_nodes_stats(ptable: DataFrame, parts: int) -> DataFrame:
    """Nodes per partition, and the load factor max/min (an empty minimum counts as 1)."""
    sizes = _loads(ptable, parts, F.count(F.lit(1)))
    factor = max(sizes) / (min(sizes) or 1)
    return ptable.sparkSession.createDataFrame(
        [(i, n, float(factor)) for i, n in enumerate(sizes)], "pid int, num_nodes long, load_factor double")


def partition_edge_stats(edges: DataFrame, parts: int) -> DataFrame:
    """Edges per partition, and their relative (population) standard deviation."""
    sizes = _loads(edges, parts, F.count(F.lit(1)))
    mean = sum(sizes) / parts
    spread = (sum((n - mean) ** 2 for n in sizes) / parts) ** 0.5
    return edges.sparkSession.createDataFrame(
        [(i, n, spread / mean if mean else 0.0) for i, n in enumerate(sizes)],
        "pid int, num_edges long, relative_std double")


def edge_cut(edges: DataFrame, ptable: DataFrame, skip_unassigned: bool = True) -> DataFrame:
    """Edges whose ends lie in different partitions: count, total, percent."""
    def end(side: str) -> DataFrame:
        return ptable.select(F.col("node").alias(side), F.col("pid").alias(f"_{side}"))

    both = edges.select("src", "dst").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    if skip_unassigned:
        both = both.filter("_src is not null and _dst is not null")
    cut = F.count_if(~F.col("_src").eqNullSafe(F.col("_dst")))
    return both.agg(cut.alias("cut"), F.count(F.lit(1)).alias("total")).withColumn(
        "percent", 100.0 * F.col("cut") / F.col("total"))
