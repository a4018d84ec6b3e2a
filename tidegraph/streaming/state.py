"""Per-node state kept continuously.

The last k neighbours live under (node, salt): the rows of a hot node are spread over `salts` state
groups, and reading merges the salts exactly (last k of last k's). The last write of a node is a
built-in streaming aggregate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from heapq import nlargest
from itertools import chain
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.hashing import stable_hash
from ..plans.ordering import running_sum
from .ingest import start

# Workers get the processors by value, so this package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG = T.LongType()
RECENT = T.StructType([T.StructField(c, _LONG) for c in ("ts", "seq", "dst", "eid")])
RECENT_OUT = T.StructType([T.StructField("node", _LONG), T.StructField("salt", T.IntegerType()), *RECENT])
_OUT_ROW = Row(*RECENT_OUT.fieldNames())


def _age(edge: tuple) -> tuple:
    """Order of edges (ts, seq, ...), those without a number first."""
    return edge[0] is not None, edge[0] or 0, edge[1] is not None, edge[1] or 0


class RecentNeighbors(StatefulProcessor):
    """Keeps the k newest edges of a key in a list state; idle keys expire after `ttl_ms`."""

    def __init__(self, k: int, ttl_ms: int | None):
        self.k, self.ttl_ms = k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", RECENT, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # most keys have a few rows in a batch: plain tuples cost less than a frame for each key
        best = nlargest(self.k, chain(self.kept.get(), map(itemgetter(*RECENT.fieldNames()), rows)), key=_age)
        self.kept.put([tuple(edge) for edge in best])
        for edge in best:
            yield _OUT_ROW(key[0], key[1], *edge)

    def close(self) -> None:
        pass


def _salted(stream: DataFrame, salts: int) -> DataFrame:
    return stream.withColumn("salt", F.pmod(stable_hash(F.col("eid")), F.lit(salts)).cast("int"))


def recent_neighbors_state(stream: DataFrame, k: int, salts: int = 16, ttl_ms: int | None = None) -> DataFrame:
    """Stream of edges(src, dst, ts, eid, seq) -> updated last-k lists per (node, salt).

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass = ROCKSDB).
    """
    keyed = _salted(stream.select(F.col("src").alias("node"), "ts", "seq", "dst", "eid"), salts)
    return keyed.groupBy("node", "salt").transformWithState(
        RecentNeighbors(k, ttl_ms), RECENT_OUT, "Update", "None" if ttl_ms is None else "ProcessingTime")


def node_state_stream(stream: DataFrame, size: int) -> DataFrame:
    """Stream of edges -> last interaction per node, in batches of `size` by eid; update mode.

    A batch is the stacked [sources, destinations], so within a batch destinations come later. The
    aggregate is combined before it is shuffled, so a hot node needs no salts.
    """
    batch, i = F.floor(F.col("eid") / size), F.col("eid") % size
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), i.alias("pos")),
                             F.struct(F.col("dst").alias("node"), (i + size).alias("pos"))))
    last = F.max_by(F.struct("ts", "eid", "batch_id", "pos"), F.struct("batch_id", "pos"))
    return (stream.select(batch.alias("batch_id"), "ts", "eid", ends.alias("e"))
            .select(F.col("e.node").alias("node"), "batch_id", F.col("e.pos").alias("pos"), "ts", "eid")
            .groupBy("node").agg(last.alias("_l")).select("node", "_l.ts", "_l.eid", "_l.batch_id", "_l.pos"))


def write_updates(updates: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  every: str | None = None) -> StreamingQuery:
    """Store each micro-batch's rows in its own folder; `batch` orders them."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(updates, store, checkpoint, mode, every)


def compact(spark: SparkSession, path: str, into: str, keys: list[str], through: int) -> DataFrame:
    """Rewrite the stored updates of batches up to `through` as the newest rows of each key.

    They go to the folder `into`/batch=`through`; a reader takes that together with the batches
    after it, and the folders up to `through` can be dropped once it is written.
    """
    stored = spark.read.parquet(path).filter(F.col("batch") <= through)
    _newest(stored, keys).drop("batch").write.mode("overwrite").parquet(f"{into}/batch={through}")
    return spark.read.parquet(into).unionByName(spark.read.parquet(path).filter(F.col("batch") > through))


def _newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the newest batch of every key; the rest is superseded."""
    last = updates.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return updates.join(last, [*keys, "batch"], "left_semi")


def merge_recent(updates: DataFrame, k: int, strategy: str = "auto") -> DataFrame:
    """Last k neighbours per node from the stored updates of recent_neighbors_state."""
    down = _newest(updates, ["node", "salt"]).withColumns({"_t": -F.col("ts"), "_s": -F.col("seq")})
    ranked = running_sum(down, ["node"], ["_t", "_s"], {"_n": F.lit(1)}, strategy)
    return ranked.filter(F.col("_n") <= k).select("node", (F.col("_n") - 1).alias("slot"), "dst", "ts", "eid")


def recent_at(spark: SparkSession, checkpoint: str, k: int, batch_id: int | None = None, strategy: str = "auto") -> DataFrame:
    """Last k neighbours per node as they were after micro-batch `batch_id` (None: the last one), read
    from the state of recent_neighbors_state itself: no stored updates are needed.

    The checkpoint keeps the state of as many batches as spark.sql.streaming.minBatchesToRetain says.
    """
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    kept = reader.load().select("key.node", "list_element.*").withColumns({"_t": -F.col("ts"), "_s": -F.col("seq")})
    ranked = running_sum(kept, ["node"], ["_t", "_s"], {"_n": F.lit(1)}, strategy)
    return ranked.filter(F.col("_n") <= k).select("node", (F.col("_n") - 1).alias("slot"), "dst", "ts", "eid")


def merge_last(updates: DataFrame) -> DataFrame:
    """Last interaction per node from the stored updates of node_state_stream."""
    return _newest(updates, ["node"]).select("node", "ts", "eid")
