"""Continuous ingestion of edges with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..sources.commits import commit, commits, delete, forget


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    """Files arriving in a folder, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def drop_late(stream: DataFrame, delay: str, event_time: str = "event_time") -> DataFrame:
    """Deduplicate by eid and drop rows older than the newest time minus `delay`.

    Dropped rows are counted in the progress (see LateRows); they never fail the query.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["eid"])


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, batch by batch, for as long as it is registered.

    The progress a query keeps itself goes back a limited number of batches only.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        # a repeated batch counts once
        self.dropped.setdefault(str(progress.id), {})[progress.batchId] = found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return sum(self.dropped.get(str(query.id), {}).values())


def start(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """Run `store` for every micro-batch: until the files at hand are read, or, with `every` (such as
    "1 minute"), for ever at that interval."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def store_batch(batch: DataFrame, graph_path: str, batch_id: int) -> bool:
    """Write one micro-batch of edges, sorted within its files, and name it as complete with its range
    of eids. False if it is complete already: then it is the same batch again.

    It is hashed by source and not by range: ranges would have to be sampled by running it once more.
    """
    spark = batch.sparkSession
    if any(c.values[0] == batch_id for c in commits(spark, graph_path, "batch")):
        return False
    path = f"{graph_path}/batch={batch_id}"
    (batch.repartition("src", F.pmod("eid", F.lit(8))).sortWithinPartitions("src", "ts", "eid").write.mode("overwrite").parquet(path))
    low, high = spark.read.schema(batch.schema).parquet(path).agg(F.min("eid"), F.max("eid")).first()
    commit(spark, graph_path, "batch", batch_id, low, high)
    return True


def stream_edges(stream: DataFrame, graph_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append every micro-batch to the graph folder. A micro-batch owns its folder, so a retry adds
    nothing twice, and readers see it when it is complete."""
    return start(stream, lambda batch, batch_id: store_batch(batch, graph_path, batch_id), checkpoint, every=every)


def _offsets(spark: SparkSession, graph_path: str) -> list[tuple[int, int]]:
    """(batch, what is added to its eids): each batch has as many numbers as its eids span."""
    found, at = [], 0
    for _, (batch, low, high) in commits(spark, graph_path, "batch"):
        found.append((batch, at - (low or 0)))
        at += 0 if low is None else high - low + 1
    if at >= 1 << 63:
        raise ValueError("the ranges of eids don't fit a bigint")
    return found


def _cover(spark: SparkSession, graph_path: str, through: int | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The runs (first, last batch) and batches (batch, offset) that hold each complete batch once,
    the longest runs first."""
    batches = [b for b in _offsets(spark, graph_path) if through is None or b[0] <= through]
    runs = sorted((c.values for c in commits(spark, graph_path, "run")), key=lambda r: (r[0], -r[1]))
    taken, last = [], -1
    for low, high in runs:
        if low > last and (through is None or high <= through):
            taken.append((low, high))
            last = high
    return taken, [b for b in batches if not any(low <= b[0] <= high for low, high in taken)]


def read_graph(spark: SparkSession, graph_path: str, through: int | None = None) -> DataFrame:
    """The ingested edges of all complete batches, or of those up to `through`.

    `seq` is the arrival order: by batch, then by eid, whatever their size. Compaction leaves it as
    it is. Only folders that are named as complete are listed.
    """
    runs, batches = _cover(spark, graph_path, through)
    if not runs and not batches:
        raise ValueError(f"no complete batch in {graph_path}")
    parts = [_numbered(spark, graph_path, batches)] if batches else []
    if runs:
        parts.append(spark.read.parquet(*[f"{graph_path}/run_{low}_{high}" for low, high in runs]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _numbered(spark: SparkSession, graph_path: str, batches: list[tuple[int, int]]) -> DataFrame:
    """The rows of some batches with their `seq`; one number per batch is broadcast."""
    offsets = F.broadcast(spark.createDataFrame(batches, "batch int, _add bigint"))
    rows = spark.read.option("basePath", graph_path).parquet(*[f"{graph_path}/batch={b}" for b, _ in batches])
    return (rows.withColumn("batch", F.col("batch").cast("int")).join(offsets, "batch")
            .withColumn("seq", F.col("eid") + F.col("_add")).drop("batch", "_add"))


def compact_graph(spark: SparkSession, graph_path: str, through: int | None = None, merge_runs: bool = False) -> tuple[int, int] | None:
    """Rewrite the batches since the last run, up to `through`, as one run: few files, each a range of
    times. With `merge_runs` earlier runs go into it. Returns its first and last batch.

    What it replaces stays until drop_compacted, so readers that have listed it go on.
    """
    runs, batches = _cover(spark, graph_path, through)
    numbers = [b for b, _ in batches] + ([b for run in runs for b in run] if merge_runs else [])
    if not batches and not (merge_runs and len(runs) > 1):
        return None
    low, high = min(numbers), max(numbers)
    rows = read_graph(spark, graph_path, high) if merge_runs else _numbered(spark, graph_path, batches)
    (rows.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq").write.mode("overwrite").parquet(f"{graph_path}/run_{low}_{high}"))
    commit(spark, graph_path, "run", low, high)
    return low, high


def drop_compacted(spark: SparkSession, graph_path: str) -> None:
    """Delete the folders of batches and runs that a run has replaced. Their names stay: they number
    the edges."""
    runs, _ = _cover(spark, graph_path, None)
    for part in commits(spark, graph_path):
        if part.kind == "batch" and any(low <= part.values[0] <= high for low, high in runs):
            delete(spark, f"{graph_path}/batch={part.values[0]}")
        elif part.kind == "run" and tuple(part.values) not in runs:
            forget(spark, graph_path, part, f"{graph_path}/run_{part.values[0]}_{part.values[1]}")
