"""Temporal neighbour sampling.

The obvious plan, joining roots to edges on `src = node AND ts < root_ts` and keeping the top k,
does roots x degree work. Both plans here sort edges and roots together once per node instead.

Most recent: in that order the k edges before a root are its answer; they are picked up with `lag`
while passing, so the edges are shuffled once and nothing is joined.

Uniform draws, later hops and large fanouts: edges and roots are shuffled once by node, each root's
window is found among its node's edges, and the chosen edges leave with the root (plans/meeting.py).
Nothing that grows with the fanout is shuffled.

Neither needs a whole node in one task: see plans/ordering.py and _last_k_ranged. A node of very many
roots meets its edges in several tasks; for one of very many edges, edges get a rank per source, each
root counts the edges before its window's start and end, and fetches ranks by an equi join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, stable_hash
from ..plans import meeting
from ..plans.ordering import by_group_size, dense_ordinal, max_group_rows, running_sum
from ..plans.storage import freeze
from ..schema import SamplingPreset

SAMPLE_COLUMNS = ("hop", "snapshot", "rid", "slot", "root_node", "root_ts", "src_node", "eid",
                  "edge_ts", "out_ts", "dt")


def rank_edges(edges: DataFrame, snapshots: int = 1, window=0, static: bool = False,
               strategy: str = "auto") -> DataFrame:
    """Edges with `rk`, 1 for the oldest edge of its source. Reuse it for every hop and root set.

    With one snapshot and no window the search starts at time 0, so earlier edges can never match
    and are left out; a root's candidates are then exactly ranks 1..hi.
    """
    if snapshots == 1 and window < 1e-6 and not static:
        edges = edges.filter(F.col("ts") >= 0)
    return running_sum(edges.select("src", "dst", "ts", "eid", "seq"), ["src"], ["ts", "seq"],
                       {"rk": F.lit(1)}, strategy)


def window_bounds(roots: DataFrame, snapshots: int = 1, window=0, static: bool = False) -> DataFrame:
    """[start, end) per root and snapshot; the last snapshot is the newest."""
    cols = ["rid", "node", "ts"]
    if static:
        kind = roots.schema["ts"].dataType.simpleString()
        # later than any time, and differences to it still fit a bigint
        top = F.lit(float("inf")) if kind in ("double", "float") else F.lit(1 << 62)
        return roots.select(*cols, F.lit(0).alias("snapshot"), F.lit(None).cast(kind).alias("start"),
                            top.cast(kind).alias("end"))
    if snapshots == 1:
        start, end = _window(snapshots, window)
        return roots.select(*cols, F.lit(0).alias("snapshot"), start.alias("start"), end.alias("end"))
    spread = roots.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(snapshots - 1))).alias("snapshot"))
    start, end = _window(snapshots, window)
    return spread.withColumn("end", end).withColumn("start", start)


def _window(snapshots: int, window) -> tuple[Column, Column]:
    """(start, end) of a row with `ts` and `snapshot`."""
    ts = F.col("ts")
    if snapshots == 1:
        return ts - window if window >= 1e-6 else ts * 0, ts
    end = ts - (snapshots - 1 - F.col("snapshot")) * window
    return end - window, end


def _count_before(ranked: DataFrame, probes: DataFrame, strategy: str) -> DataFrame:
    """probes(node, at, pid_cols...) plus `hi`: edges of that node strictly before `at`."""
    extra = [c for c in probes.columns if c not in ("node", "at")]
    marks = (ranked.select(F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("_edge"),
                           F.col("seq").alias("_tie"),
                           *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
             .unionByName(probes.withColumns({"_edge": F.lit(0), "_tie": F.lit(0).cast("bigint")})))
    # probes (0) sort before edges (1) of the same time: strictly earlier edges are counted
    counted = running_sum(marks, ["node"], ["at", "_edge", "_tie", *_tie_columns(extra)],
                          {"hi": F.col("_edge")}, strategy)
    return counted.filter("_edge = 0").drop("_edge", "_tie")


def _tie_columns(extra: Sequence[str]) -> list[str]:
    return [c for c in ("rid", "snapshot", "side") if c in extra]


def _finish(picked: DataFrame, ranked: DataFrame, hop: int, prop_time: bool, static: bool) -> DataFrame:
    edge = ranked.select(F.col("src").alias("node"), "rk", F.col("dst").alias("src_node"), "eid",
                         F.col("ts").alias("edge_ts"))
    found = picked.join(edge, ["node", "rk"])
    root_ts = F.col("end") if static else F.col("ts")
    found = found.select("snapshot", "rid", F.col("slot").cast("int").alias("slot"), F.col("node").alias("root_node"),
                         root_ts.alias("root_ts"), "src_node", "eid", "edge_ts", "start")
    return _with_times(found, hop, prop_time, "start")


# What a sample is read from again; the other columns follow from these.
STORED = ("snapshot", "rid", "slot", "root_node", "root_ts", "src_node", "eid", "edge_ts")


def _with_times(found: DataFrame, hop: int, prop_time: bool, *more: str) -> DataFrame:
    """Samples of the columns STORED with all SAMPLE_COLUMNS."""
    return found.withColumns({"hop": F.lit(hop), "out_ts": F.col("root_ts" if prop_time else "edge_ts"),
                              "dt": F.col("root_ts") - F.col("edge_ts")}).select(*SAMPLE_COLUMNS, *more)


# Above this the most recent k are fetched by rank like the uniform ones: lag columns grow with k. The
# choice changes the plan, never the rows.
MAX_LAGS = 32


def _with_last_k(marks: DataFrame, keys: Sequence[str], order_by: Sequence[str], k: int) -> DataFrame:
    """Add `_last`: the k nearest preceding edge payloads (`_edge` of probes is NULL), newest first."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order_by)})"
    lags = [F.expr(f"lag(_edge, {j}) IGNORE NULLS {over}") for j in range(1, k + 1)]
    return marks.withColumn("_last", F.array(*lags))


def _last_k_ranged(marks: DataFrame, order_by: Sequence[str], k: int) -> DataFrame:
    """`_last` for nodes of any size: a node may continue over several range partitions.

    Every partition finishes its own rows. What a continued node had before comes from a table of
    the last k edges at each partition boundary: at most k rows per partition, whatever the data.
    """
    ranged = freeze(marks.repartitionByRange("node", *order_by).withColumn("_pid", F.spark_partition_id()), "ranged")
    local = _with_last_k(ranged, ["_pid", "node"], order_by, k).filter("_edge IS NULL")
    # only the highest node of a partition can continue in the next one
    tops = ranged.groupBy("_pid").agg(F.max("node").alias("node"))
    newest = Window.partitionBy("_pid", "node").orderBy(F.desc("at"), F.desc("_tie"))
    tails = (ranged.filter("_edge IS NOT NULL").join(F.broadcast(tops), ["_pid", "node"])
             .withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k))
    spans = ranged.select("_pid", "node").distinct().join(
        F.broadcast(tops.select("node").distinct()), "node")
    bounds = tails.select("node", "_pid", F.lit(1).alias("_kind"), "at", "_tie", "_edge").unionByName(
        spans.select("node", "_pid", F.lit(0).alias("_kind")), allowMissingColumns=True)
    # per node at most (k + 1) rows per partition
    carried = (_with_last_k(bounds, ["node"], ["_pid", "_kind", "at", "_tie"], k).filter("_kind = 0")
               .select("_pid", "node", F.col("_last").alias("_before")))
    # one row of k edges per continued node and partition: left to AQE, which measures it
    joined = local.join(carried, ["_pid", "node"], "left")
    both = F.filter(F.concat("_last", "_before"), lambda e: e.isNotNull())
    return joined.withColumn("_last", F.when(F.col("_before").isNull(), F.col("_last")).otherwise(F.slice(both, 1, k)))


def _last_k(edges: DataFrame, probes: DataFrame, k: int, strategy: str) -> DataFrame:
    """probes(node, at, rid, snapshot, ...) plus `_last`: the k newest edges strictly before `at`."""
    extra = [c for c in probes.columns if c not in ("node", "at")]
    payload = F.struct(F.col("ts").alias("edge_ts"), F.col("dst").alias("src_node"), "eid")
    marks = edges.select(
        F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("_kind"), F.col("seq").alias("_tie"),
        payload.alias("_edge"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    marks = marks.unionByName(probes.withColumns({
        "_kind": F.lit(0), "_tie": F.lit(0).cast("bigint"), "_edge": F.lit(None).cast(marks.schema["_edge"].dataType)}))
    # probes (0) sort before edges (1) of the same time: only strictly earlier edges are seen
    order_by = ["at", "_kind", "_tie", *_tie_columns(extra)]
    columns = [*marks.columns, "_last"]
    return by_group_size(marks, ["node"], strategy,
                         lambda rows: _with_last_k(rows, ["node"], order_by, k).filter("_edge IS NULL").select(*columns),
                         lambda rows: _last_k_ranged(rows, order_by, k).select(*columns))


def _recent_by_rank(edges: DataFrame, bounds: DataFrame, k: int, prop_time: bool, hop: int, static: bool,
                    strategy: str) -> DataFrame:
    ranked = edges if "rk" in edges.columns else rank_edges(edges, static=True, strategy=strategy)
    probes = bounds.select("node", F.col("end").alias("at"), "rid", "snapshot", "ts", "start", "end")
    placed = _count_before(ranked, probes, strategy).filter("hi > 0")
    slots = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("hi")) - 1)
    picked = placed.withColumn("slot", F.explode(slots)).withColumn("rk", F.col("hi") - F.col("slot"))
    return _finish(picked, ranked, hop, prop_time, static)


# Questions about one node that a single task may answer, as a part of max_group_rows.
QUESTIONS = 8


def _meeting(edges: DataFrame, asked: DataFrame, spread: Callable[[DataFrame], DataFrame], choose, draws: int, whole: bool,
             once: bool, draw_hash, static: bool, by_rank: Callable[[DataFrame, DataFrame], DataFrame], strategy: str) -> DataFrame:
    """Samples (STORED) of the questions `asked` (rid, node, ts, ...), answered where their node's edges are.

    spread: rows with `asks` -> the questions among them with snapshot, start and end; it is applied
    after the shuffle. by_rank(edges, bounds): the same rows for nodes of very many edges.
    """
    if strategy not in ("auto", "plain", "ranged"):
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = edges.filter(F.col("src").isNotNull())
    asked = asked.filter(F.col("node").isNotNull() & F.col("ts").isNotNull())
    many = None
    if strategy == "auto":
        limit = max_group_rows(edges.sparkSession)
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("_e"), F.lit(0).alias("_q"))
        sizes = (ends.unionAll(asked.select("node", F.lit(0), F.lit(1))).groupBy("node")
                 .agg(F.sum("_e").alias("_e"), F.sum("_q").alias("_q")))
        most = max(1, limit // QUESTIONS)
        # a node's edges are copied for each part of its questions: together no more than its questions
        parts = F.least(F.ceil(F.col("_q") / most), F.floor(F.col("_q") / F.greatest("_e", F.lit(1))))
        sizes = sizes.select("node", F.when(F.col("_e") > limit, 0).otherwise(F.greatest(parts, F.lit(1))).cast("int").alias("_parts"))
        # fewer than rows / most, so it may be broadcast
        many = freeze(sizes.filter("_parts <> 1"), "hot-keys")
        if many.isEmpty():
            many = None
    by_ranks = None
    if strategy == "ranged":
        return by_rank(edges, spread(asked.withColumn("asks", F.lit(1)))).select(*STORED)
    if many is not None:
        hot = F.broadcast(many.filter("_parts = 0").select("node"))
        by_ranks = by_rank(edges.join(hot.withColumnRenamed("node", "src"), "src", "left_semi").select(*edges.columns),
                           spread(asked.join(hot, "node", "left_semi").withColumn("asks", F.lit(1)))).select(*STORED)

    time, root_time = edges.schema["ts"].dataType.simpleString(), asked.schema["ts"].dataType.simpleString()
    kind = "double" if {"double", "float"} & {time, root_time} else "bigint"
    lowest = F.lit(float("-inf") if kind == "double" else -(1 << 63)).cast(kind)
    extra = [c for c in asked.columns if c not in ("rid", "node", "ts")]
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra]
    # an edge without a time is older than any other
    rows = edges.select(F.col("src").alias("node"), F.lit(0).cast("tinyint").alias("asks"), F.coalesce(F.col("ts").cast(kind), lowest).alias("ts"),
                        F.col("seq").cast("bigint").alias("rid"), "dst", "eid", *nothing)
    rows = rows.unionByName(asked.select("node", F.lit(1).cast("tinyint").alias("asks"), F.col("ts").cast(kind).alias("ts"),
                                         F.col("rid").cast("bigint").alias("rid"), *extra), allowMissingColumns=True)
    if many is None:
        rows = rows.withColumn("salt", F.lit(0))
        placed = rows.repartition("node")
    else:
        few = F.broadcast(many)
        rows = rows.join(few, "node", "left").filter("_parts is null or _parts > 0").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        copies = F.when(F.col("asks") == 0, F.sequence(F.lit(0), F.col("_parts") - 1)) \
            .otherwise(F.array(F.pmod(F.xxhash64("rid", "ts"), F.col("_parts")).cast("int")))
        placed = rows.withColumn("salt", F.explode(copies)).drop("_parts").repartition("node", "salt")
    # edges have no window: the lowest time has none that fits a bigint
    questions = spread(placed.withColumns({"at": F.col("ts"), "ts": F.when(F.col("asks") == 1, F.col("ts"))}))
    top = F.lit(float("inf") if kind == "double" else 1 << 62).cast(kind)
    zero = F.lit(0).cast(kind)
    end = top if static else F.coalesce(F.col("end").cast(kind), zero)
    ready = questions.select(
        "node", "salt", "asks", "at", (zero if whole else F.coalesce(F.col("start").cast(kind), zero)).alias("start"),
        end.alias("end"), "ts", "rid", F.col("snapshot").cast("int").alias("snapshot"), "dst", "eid")
    ready = ready.sortWithinPartitions("node", "salt", "asks", "at", "rid", "snapshot")
    hashes = {f"draw_{i}": F.when(F.col("asks") == 1, draw_hash(F.lit(i).cast("bigint"))).otherwise(0) for i in range(draws)}
    ready = ready.withColumns(hashes) if hashes else ready
    dst, eid = (edges.schema[c].dataType.simpleString() for c in ("dst", "eid"))
    found = ready.mapInArrow(meeting.answers(choose, draws, whole, once),
                             f"snapshot int, rid bigint, slot int, node bigint, ts {kind}, src_node {dst}, eid {eid}, edge_ts {kind}")
    edge_ts = F.when(F.col("edge_ts") != lowest, F.col("edge_ts")).cast(time)
    root_ts = (top if static else F.col("ts")).cast(root_time)
    found = found.select("snapshot", "rid", "slot", F.col("node").alias("root_node"), root_ts.alias("root_ts"), "src_node", "eid", edge_ts.alias("edge_ts"))
    return found if by_ranks is None else found.unionByName(by_ranks)


def _as_given(rows: DataFrame) -> DataFrame:
    """Questions that have their snapshot, start and end."""
    return rows


def _spread(snapshots: int, window, static: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Every question (rid, node, ts) in its window of every snapshot."""
    def spread(rows: DataFrame) -> DataFrame:
        if static:
            return rows.withColumns({"snapshot": F.lit(0), **{c: F.lit(None).cast(rows.schema["ts"].dataType) for c in ("start", "end")}})
        each = F.when(F.col("asks") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(snapshots - 1)))
        rows = rows.withColumn("snapshot", F.explode(each) if snapshots > 1 else F.lit(0))
        return _windowed(snapshots, window)(rows)
    return spread


def _windowed(snapshots: int, window) -> Callable[[DataFrame], DataFrame]:
    """Questions (rid, node, ts, snapshot) with the window of their snapshot."""
    def spread(rows: DataFrame) -> DataFrame:
        start, end = _window(snapshots, window)
        return rows.withColumns({"start": start, "end": end})
    return spread


def _recent_meeting(edges: DataFrame, asked: DataFrame, spread, k: int, prop_time: bool, hop: int, static: bool, strategy: str) -> DataFrame:
    def by_rank(hot_edges: DataFrame, bounds: DataFrame) -> DataFrame:
        if static:
            bounds = window_bounds(bounds, static=True)
        found = _recent_by_rank(hot_edges.select("src", "dst", "ts", "eid", "seq"), bounds, k, prop_time, hop, static, "ranged")
        return found if static else found.filter("edge_ts >= start")

    found = _meeting(edges, asked, spread, meeting.newest(k), 0, static, False, None, static, by_rank, strategy)
    return _with_times(found, hop, prop_time)


def recent_within(edges: DataFrame, bounds: DataFrame, k: int, prop_time: bool = False, hop: int = 0,
                  static: bool = False, strategy: str = "auto") -> DataFrame:
    """The newest k edges in [start, end) of each row of `bounds`."""
    if k > MAX_LAGS:
        asked = bounds.select("rid", "node", "ts", "snapshot", "start", "end")
        return _recent_meeting(edges, asked, _as_given, k, prop_time, hop, static, strategy)
    probes = bounds.select("node", F.col("end").alias("at"), "rid", "snapshot", "ts", "start")
    seen = _last_k(edges, probes, k, strategy)
    each = seen.select("rid", "snapshot", "start", F.col("node").alias("root_node"),
                       F.col("at" if static else "ts").alias("root_ts"),
                       F.posexplode("_last").alias("slot", "e")).filter("e IS NOT NULL")
    found = each.select("snapshot", "rid", "slot", "root_node", "root_ts", "e.src_node", "e.eid", "e.edge_ts", "start")
    # the newest k before `end` that are also >= start are the newest k of the window
    if not static:
        found = found.filter("edge_ts >= start")
    return _with_times(found, hop, prop_time)


def sample_recent(edges: DataFrame, roots: DataFrame, k: int, window=0, snapshots: int = 1,
                  prop_time: bool = False, hop: int = 0, static: bool = False,
                  strategy: str = "auto") -> DataFrame:
    """The k most recent neighbours strictly before each root's time (newest first, `slot` 0)."""
    if k > MAX_LAGS:
        return _recent_meeting(edges, roots.select("rid", "node", "ts"), _spread(snapshots, window, static), k, prop_time, hop, static, strategy)
    bounds = window_bounds(roots, snapshots, window, static)
    return recent_within(edges, bounds, k, prop_time, hop, static, strategy)


def sample_uniform(ranked: DataFrame, roots: DataFrame, k: int, window=0, snapshots: int = 1,
                   seed: int = 0, prop_time: bool = False, hop: int = 0, static: bool = False,
                   strategy: str = "auto") -> DataFrame:
    """k independent draws with replacement among each root's candidates; none without candidates."""
    whole = static or (snapshots == 1 and window < 1e-6)
    return _uniform_meeting(ranked, roots.select("rid", "node", "ts"), _spread(snapshots, window, static), k, seed, whole,
                            prop_time, hop, static, strategy, not whole)


def _uniform_meeting(edges: DataFrame, asked: DataFrame, spread, k: int, seed: int, whole: bool, prop_time: bool, hop: int,
                     static: bool, strategy: str, once: bool) -> DataFrame:
    """k draws in the window of each question; `whole`: every earlier edge is a candidate; `once`: rows
    of `asked` that are equal draw once."""
    def by_rank(hot_edges: DataFrame, bounds: DataFrame) -> DataFrame:
        if static:
            bounds = window_bounds(bounds, static=True)
        ranked = hot_edges if "rk" in hot_edges.columns else rank_edges(hot_edges, static=True, strategy="ranged")
        return _uniform_by_rank(ranked, bounds, k, seed, whole, prop_time, hop, static, "ranged", once)

    def draw_hash(slot: Column) -> Column:
        return stable_hash(seed, hop, F.col("snapshot"), F.col("rid"), slot)

    found = _meeting(edges, asked, spread, meeting.drawn, k, whole, once, draw_hash, static, by_rank, strategy)
    return _with_times(found, hop, prop_time)


def _uniform_by_rank(ranked: DataFrame, bounds: DataFrame, k: int, seed: int, whole: bool, prop_time: bool, hop: int,
                     static: bool, strategy: str, once: bool) -> DataFrame:
    keep = ["rid", "snapshot", "ts", "start", "end"]
    if whole:
        probes = bounds.select("node", F.col("end").alias("at"), *keep)
        placed = _count_before(ranked, probes, strategy).withColumn("n", F.col("hi"))
    else:
        # rows that are equal keep a number each, unless they are to draw once
        twin = F.lit(0).cast("bigint") if once else F.monotonically_increasing_id()
        both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("at")),
                                 F.struct(F.lit(1).alias("side"), F.col("end").alias("at"))))
        bounds = bounds.withColumn("_twin", twin)
        bounds = bounds if once else freeze(bounds.select("node", *keep, "_twin"), "bounds")
        probes = bounds.select("node", *keep, "_twin", both.alias("b")).select("node", "b.at", "b.side", *keep, "_twin")
        sides = _count_before(ranked, probes, strategy)
        placed = (sides.groupBy("rid", "snapshot", "node", "ts", "start", "end", "_twin")
                  .agg(F.max(F.when(F.col("side") == 1, F.col("hi"))).alias("hi"),
                       F.max(F.when(F.col("side") == 0, F.col("hi"))).alias("lo"))
                  .withColumn("n", F.col("hi") - F.col("lo")))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    picked = (placed.filter("n > 0").withColumn("slot", F.explode(slots))
              .withColumn("rk", F.col("hi") - draw(F.col("n"), seed, hop, F.col("snapshot"),
                                                   F.col("rid"), F.col("slot"))))
    return _finish(picked, ranked, hop, prop_time, static).select(*SAMPLE_COLUMNS)


def sample_layer(edges: DataFrame, roots: DataFrame, k: int, how: str = "recent", hop: int = 0,
                 snapshot: int | None = None, snapshots: int = 1, window=0, seed: int = 0, **options) -> DataFrame:
    """One hop, optionally one snapshot of several. Uniform sampling needs ranked edges."""
    if how == "recent":
        found = sample_recent(edges, roots, k, window, snapshots, hop=hop, **options)
    elif how == "uniform":
        found = sample_uniform(edges, roots, k, window, snapshots, seed, hop=hop, **options)
    else:
        raise ValueError(f"unknown sampling {how!r}")
    return found if snapshot is None else found.filter(F.col("snapshot") == snapshot)


def sample_static(edges: DataFrame, roots: DataFrame, k: int, how: str = "recent", seed: int = 0,
                  strategy: str = "auto") -> DataFrame:
    """Sample from the whole history: the graph is read as having no time."""
    if how == "uniform":
        edges = rank_edges(edges, static=True, strategy=strategy)
    return sample_layer(edges, roots, k, how, seed=seed, static=True, strategy=strategy)


def frontier(roots: DataFrame, samples: DataFrame, k: int, span: int, snapshot: int = 0) -> DataFrame:
    """Next hop's roots: all current roots, then every sampled neighbour at its out time.

    Ids keep that order without a sort: roots keep theirs (below `span`), the neighbour in slot s of
    root r gets span + r*k + s.
    """
    mine = samples.filter(F.col("snapshot") == snapshot)
    below = mine.select((F.lit(span) + F.col("rid") * k + F.col("slot")).alias("rid"),
                        F.col("src_node").alias("node"), F.col("out_ts").alias("ts"))
    return roots.select("rid", "node", "ts").unionByName(below)


def sample_multi_hop(edges: DataFrame, roots: DataFrame, fanouts: Sequence[int], how: str = "recent",
                     snapshots: int = 1, window=0, seed: int = 0, prop_time: bool = False,
                     static: bool = False, strategy: str = "auto", max_rid: int | None = None) -> list[DataFrame]:
    """Samples of every hop, outermost (last) hop first. Every hop is written before the next reads it."""
    if how == "uniform" and snapshots == 1 and window < 1e-6 and not static:
        edges = edges.filter(F.col("ts") >= 0)  # as in rank_edges
    if max_rid is None:
        max_rid = roots.agg(F.max("rid")).first()[0]
    span = (max_rid if max_rid is not None else -1) + 1
    layers: list[DataFrame] = []
    current = {s: roots.select("rid", "node", "ts") for s in range(snapshots)}
    for hop, k in enumerate(fanouts):
        options = dict(prop_time=prop_time, static=static, strategy=strategy)
        if hop == 0:
            layer = sample_layer(edges, roots, k, how, hop, None, snapshots, window, seed, **options)
        else:
            layer = _later_hop(edges, current, k, how, hop, snapshots, window, seed, options)
        if hop + 1 < len(fanouts):
            layer = _with_times(freeze(layer.select(*STORED), f"hop{hop}"), hop, prop_time)
            current = {s: frontier(current[s], layer, k, span, s) for s in current}
            span += span * k
        layers.append(layer)
    return layers[::-1]


def sample_preset(edges: DataFrame, roots: DataFrame, preset: SamplingPreset, seed: int = 0,
                  strategy: str = "auto") -> list[DataFrame]:
    """sample_multi_hop with named settings, see schema.PRESETS."""
    return sample_multi_hop(edges, roots, preset.fanouts, preset.strategy, preset.snapshots, preset.window, seed,
                            preset.prop_time, preset.static, strategy)


def _later_hop(edges, fronts, k, how, hop, snapshots, window, seed, options) -> DataFrame:
    """Every snapshot has a frontier of its own and is asked in its own window, all in one probe."""
    if options["static"]:
        return sample_layer(edges, fronts[0], k, how, hop, None, 1, window, seed, **options)
    asked = None
    for s, front in fronts.items():
        part = front.withColumn("snapshot", F.lit(s))
        asked = part if asked is None else asked.unionByName(part)
    spread, prop_time, strategy = _windowed(snapshots, window), options["prop_time"], options["strategy"]
    if how == "recent":
        return _recent_meeting(edges, asked, spread, k, prop_time, hop, False, strategy)
    whole = snapshots == 1 and window < 1e-6
    return _uniform_meeting(edges, asked, spread, k, seed, whole, prop_time, hop, False, strategy, False)


def to_block(samples: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One hop and snapshot as (edges, frontier) with dense ordinals.

    edges: row = ordinal of the root, col = number of roots + ordinal of the sampled edge.
    frontier: ord, node, ts, with the roots first; roots without neighbours stay.
    """
    numbered = dense_ordinal(roots.select("rid", "node", "ts"), ["rid"], "row")
    num_roots = numbered.count()
    edges = dense_ordinal(samples.join(numbered.select("rid", "row"), "rid"), ["row", "slot"], "col", num_roots)
    front = (numbered.select(F.col("row").alias("ord"), "node", "ts")
             .unionByName(edges.select(F.col("col").alias("ord"), F.col("src_node").alias("node"),
                                       F.col("out_ts").alias("ts"))))
    return edges, front


def block_counts(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(num_dst_nodes, num_src_nodes, num_edges) of one block: roots, frontier rows, sampled edges."""
    marked = front.select(F.lit(0).alias("e")).unionAll(edges.select(F.lit(1).alias("e")))
    n_front, n_edges = F.count_if(F.col("e") == 0), F.count_if(F.col("e") == 1)
    return marked.agg((n_front - n_edges).alias("num_dst_nodes"), n_front.alias("num_src_nodes"),
                      n_edges.alias("num_edges"))


def sample_bucketed(spark: SparkSession, table: str, roots: DataFrame, k: int, window=0, snapshots: int = 1,
                    prop_time: bool = False, strategy: str = "auto") -> DataFrame:
    """sample_recent on a table of graph.write_bucketed: its edges are not shuffled.

    Only the roots are, to the table's buckets, and each bucket's edges and roots meet where it is
    read. Hot sources still leave the buckets, as everywhere.
    """
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} has no buckets")
    placed = roots.select("rid", "node", "ts").repartition(int(rows[0].data_type), "node")
    return sample_recent(spark.table(table), placed, k, window, snapshots, prop_time, strategy=strategy)


def sample_partitioned(spark: SparkSession, path: str, roots: DataFrame, ptable: DataFrame, k: int, window=0,
                       strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Sampling from a folder of io.write_partitioned_edges: (samples with pid, all roots with pid).

    A root is answered from its owner's edges. The owners asked for, at most as many as there are
    partitions, are listed first, and no other owner's files are read. Roots of nodes without a
    partition return no edges but stay in the root list; `rid` is the order.
    """
    placed = roots.join(ptable.select("node", "pid"), "node", "left").select("rid", "node", "ts", "pid")
    owned = placed.filter(F.col("pid").isNotNull())
    owners = [r.pid for r in owned.select("pid").distinct().collect()]
    edges = spark.read.parquet(path).filter(F.col("pid").isin(owners))
    found = sample_recent(edges, owned, k, window, strategy=strategy)
    return found.join(owned.select("rid", "pid"), "rid"), placed


def unique_frontier(front: DataFrame) -> DataFrame:
    """Distinct node ids to fetch; join back to the frontier on node."""
    return front.select("node").distinct()


def sort_frontier(roots: DataFrame) -> DataFrame:
    """The roots in the order of their nodes, `place` being where each stands."""
    return dense_ordinal(roots, ["node", "rid"], "place")


def compare_windows(edges: DataFrame, roots: DataFrame, k: int, windows: Sequence[float],
                    strategy: str = "auto") -> DataFrame:
    """The same recent query under several windows (0 = whole history) in one run.

    `snapshot` is the position in `windows`.
    """
    options = F.array(*[F.struct(F.lit(i).alias("snapshot"), F.lit(w).alias("w")) for i, w in enumerate(windows)])
    spread = roots.select("rid", "node", "ts", F.explode(options).alias("o"))
    start = F.when(F.col("o.w") < 1e-6, F.col("ts") * 0).otherwise(F.col("ts") - F.col("o.w"))
    bounds = spread.select("rid", "node", "ts", "o.snapshot", start.alias("start"), F.col("ts").alias("end"))
    return recent_within(edges, bounds, k, strategy=strategy)
