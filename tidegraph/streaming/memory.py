"""Memory and mailbox of nodes, kept up to date by a stream of edges.

An edge changes both its ends and needs the memory of both, so state can't live under one key of a
stateful operator. It lives in a versioned table instead: a micro-batch looks up its own nodes in
version n, computes their new memories, sends the mails, and writes the changed nodes, one row each,
as version n + 1. What a micro-batch costs depends on its edges, not on the number of nodes.

The version is the micro-batch's id plus one, and a complete version is never written again. So a
batch that is repeated after a failure either finds its version complete and does nothing, or reads
the same version n as before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import STATE_COLUMNS, last_mail, last_memory, node_state_lookup
from ..plans.storage import freeze, scratch
from ..sources import versioned
from .ingest import start

# (memory, mail, time since the memory's last change) -> new memory
Updater = Callable[[Column, Column, Column], Column]


def unchanged(mem: Column, mail: Column, dt: Column) -> Column:
    return mem


def towards_mail(share: float) -> Updater:
    """Memory moves by `share` towards the first part of its mail, as long as a memory."""
    def update(mem: Column, mail: Column, dt: Column) -> Column:
        return F.zip_with(mem, F.slice(mail, F.lit(1), F.size(mem)), lambda m, x: m * (1 - share) + x * share)
    return update


def batch_update(edges: DataFrame, state: DataFrame, mem_dim: int, edge_dim: int, updater: Updater = unchanged) -> DataFrame:
    """The new state rows (STATE_COLUMNS) of all nodes of one batch of edges(src, dst, ts, eid[, feat]).

    Every end of every edge gets a new memory from its state before the batch; of a node's new
    memories the last one stays, sources first, then destinations, by eid. Mails are made of the new
    memories of both ends and the edge's features; the last one by eid stays.
    """
    low, high = edges.agg(F.min("eid"), F.max("eid")).first()
    span = high - low + 1
    at = F.col("eid") - low
    ends = F.explode(F.array(F.struct(F.lit("src").alias("role"), F.col("src").alias("node"), at.alias("pos")),
                             F.struct(F.lit("dst").alias("role"), F.col("dst").alias("node"), (at + span).alias("pos"))))
    rows = edges.select("eid", "ts", ends.alias("e")).select("eid", "ts", "e.*")
    front = node_state_lookup(rows, state, mem_dim, 2 * mem_dim + edge_dim)
    new = updater(F.col("mem"), F.col("mail"), F.col("ts") - F.col("mem_ts"))
    # read for memories and for mails
    front = freeze(front.select("eid", "role", "node", "ts", "pos", new.alias("mem"), F.lit(0).alias("batch_id")), "batch-memory")
    sides = [front.filter(F.col("role") == role).select("eid", F.col("mem").alias(f"mem_{role}")) for role in ("src", "dst")]
    talks = edges.withColumns({"i": at, "batch_id": F.lit(0)}).join(sides[0], "eid").join(sides[1], "eid")
    return last_memory(front).join(last_mail(talks, edge_dim), "node").select(*STATE_COLUMNS)


def empty_state(spark: SparkSession, ts_type: str = "bigint") -> DataFrame:
    return spark.createDataFrame([], f"node bigint, mem array<double>, mem_ts {ts_type}, mail array<double>, mail_ts {ts_type}")


def apply_batch(edges: DataFrame, path: str, version: int, mem_dim: int, edge_dim: int, updater: Updater = unchanged) -> bool:
    """Take the stored state from version - 1 to `version` by one batch; False if it is there already."""
    spark = edges.sparkSession
    if version in versioned.versions(spark, path):
        return False
    with scratch(spark):
        # a micro-batch would be read from its source again each time
        edges = freeze(edges, "batch")
        if edges.isEmpty():
            fresh = versioned.read(spark, path, version - 1, "node").limit(0)
        else:
            nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
            state = versioned.read(spark, path, version - 1, "node", wanted=nodes)
            fresh = freeze(batch_update(edges, state, mem_dim, edge_dim, updater), "state-rows")
        return versioned.append(fresh, path, version, "node")


def node_memory_stream(stream: DataFrame, path: str, checkpoint: str, mem_dim: int, edge_dim: int, updater: Updater = unchanged,
                       compact_every: int | None = None, every: str | None = None) -> StreamingQuery:
    """Keep the state table at `path` up to date with a stream of edges(src, dst, ts, eid[, feat]).

    The table is made beforehand by versioned.create(state, path, "node"), of `empty_state` or any
    start; it belongs to this checkpoint. Eids are unique (see ingest.drop_late). Read it with
    versioned.read(spark, path, key="node") or lookup; every `compact_every` batches its deltas are
    folded.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, path, batch_id + 1, mem_dim, edge_dim, updater)
        if compact_every and (batch_id + 1) % compact_every == 0:
            versioned.compact(batch.sparkSession, path, batch_id + 1, "node")

    return start(stream, store, checkpoint, every=every)
