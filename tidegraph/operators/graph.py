"""Building a timestamped graph from edge tables, its catalogue, and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordering import dense_ordinal, running_sum

REQUIRED = ("src", "dst", "ts")


def validate_edges(edges: DataFrame) -> DataFrame:
    """Fail on missing columns, an empty batch, or (while running) a NULL in a required column."""
    missing = [c for c in REQUIRED if c not in edges.columns]
    if missing:
        raise ValueError(f"edges lack columns {missing}")
    if edges.isEmpty():
        raise ValueError("an edge batch must not be empty")
    checked = {c: F.coalesce(c, F.raise_error(F.lit(f"NULL in edge column {c}"))) for c in REQUIRED}
    return edges.withColumns(checked)


def num_edges(edges: DataFrame) -> int:
    """Distinct edge ids: both directions of a reversed edge count once."""
    return edges.agg(F.count_distinct("eid")).first()[0]


def assign_edge_ids(edges: DataFrame, order_by: Sequence[str], offset: int = 0) -> DataFrame:
    """Number edges densely from `offset` in the given total order."""
    return dense_ordinal(edges, order_by, "eid", offset)


def add_reverse(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, same eid; all forward rows come before the swapped rows."""
    low, high = edges.agg(F.min("seq"), F.max("seq")).first()
    span = 0 if low is None else high - low + 1
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "seq": F.col("seq") + span})
    return edges.unionByName(swapped)


def append_edges(graph: DataFrame | None, edges: DataFrame, order_by: Sequence[str] = ("ts", "src", "dst"),
                 reverse: bool = False, known: tuple[int, int] | None = None) -> DataFrame:
    """Append a batch. Missing eids continue from the number of edges; missing seq follows the eid.

    `order_by` is the arrival order, needed (as a total order) only when eids are missing. `known`
    is (number of edges, highest seq) of the graph so far, if the caller keeps them; without it the
    stored graph is read for them.
    """
    edges = validate_edges(edges)
    if "eid" not in edges.columns:
        have = 0 if graph is None else known[0] if known else num_edges(graph)
        edges = assign_edge_ids(edges, order_by, have)
    if "seq" not in edges.columns:
        edges = edges.withColumn("seq", F.col("eid"))
    if graph is not None:
        last = known[1] if known else graph.agg(F.max("seq")).first()[0]
        first = edges.agg(F.min("seq")).first()[0]
        shift = 0 if last is None else last + 1 - first
        edges = edges.withColumn("seq", F.col("seq") + shift)
    if reverse:
        edges = add_reverse(edges)
    return edges if graph is None else graph.unionByName(edges.select(*graph.columns))


def temporal_sort(edges: DataFrame) -> DataFrame:
    """Edges of a source together, oldest first; a hot source is spread over several partitions."""
    return (edges.repartitionByRange("src", "ts", "seq").sortWithinPartitions("src", "ts", "seq"))


def write_graph(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted files: min/max statistics on src and ts let scans skip row groups."""
    temporal_sort(edges).write.mode(mode).parquet(path)


def write_bucketed(edges: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Saved table hash-bucketed by source for co-located joins on src."""
    writer = edges.write.bucketBy(buckets, "src").sortBy("src", "ts", "seq").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def temporal_neighbors(edges: DataFrame, nodes: DataFrame, strategy: str = "auto") -> DataFrame:
    """All neighbours of the given nodes, `slot` 0 being the newest (ties: later inserted first)."""
    wanted = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    newest = wanted.withColumns({"_t": -F.col("ts"), "_s": -F.col("seq")})
    ranked = running_sum(newest, ["src"], ["_t", "_s"], {"_n": F.lit(1)}, strategy)
    return ranked.select(F.col("src").alias("node"), (F.col("_n") - 1).alias("slot"),
                         "dst", "ts", "eid")


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows per source for the given nodes, 0 when a node is no source."""
    counts = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return (nodes.select("node").join(counts, "node", "left")
            .select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")))


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ids on either end. Each end is reduced before the union is."""
    ends = edges.select(F.col("src").alias("node")).distinct()
    return ends.union(edges.select(F.col("dst").alias("node")).distinct()).distinct()


def src_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct()


def edge_ids(edges: DataFrame) -> DataFrame:
    return edges.select("eid").distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    """(metric, value): vertices, source vertices, distinct edges, highest vertex id.

    The ends are reduced to one row per vertex before anything is counted; ids are a second pass.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("source")),
                             F.struct(F.col("dst").alias("node"), F.lit(0).alias("source"))))
    vertices = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.max("source").alias("source"))
    metrics = {"num_vertices": F.count(F.lit(1)), "num_source_vertices": F.coalesce(F.sum("source"), F.lit(0)),
               "max_vertex_id": F.max("node")}
    counted = vertices.agg(*[value.cast("bigint").alias(name) for name, value in metrics.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in metrics]))
    num = edge_ids(edges).agg(F.count(F.lit(1)).alias("value")).select(F.lit("num_edges").alias("metric"), "value")
    return counted.select(rows.alias("m")).select("m.metric", "m.value").union(num)


def retain_since(edges: DataFrame, since) -> DataFrame:
    """Keep rows not older than `since`; the filter reaches the file scan."""
    return edges.filter(F.col("ts") >= F.lit(since))


def archive_before(edges: DataFrame, before: int, path: str, unit: int = 86_400_000_000,
                   run: str | None = None) -> DataFrame:
    """Write rows older than `before` to date-partitioned files and return the rows that stay.

    Every run has a folder of its own, named by `before` unless `run` is given, and a repeated run
    replaces it. If nothing is old nothing is written, so an earlier archive is never emptied.
    """
    old = edges.filter(F.col("ts") < F.lit(before)).withColumn("day", F.floor(F.col("ts") / unit))
    # day and src order: many files per day when a day is large, few small ones otherwise
    if not old.isEmpty():
        (old.repartitionByRange("day", "src", "ts", "seq").sortWithinPartitions("day", "src", "ts", "seq")
         .write.partitionBy("day").mode("overwrite").parquet(f"{path}/run={run or before}"))
    return edges.filter(F.col("ts") >= F.lit(before))


def restore_archive(edges: DataFrame, path: str, since: int | None = None,
                    unit: int = 86_400_000_000) -> DataFrame:
    """Union archived rows of all runs back; `since` prunes whole days. No archive: nothing to add."""
    spark = edges.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return edges
    old = spark.read.schema(T.StructType(list(edges.schema)).add("day", "long").add("run", "string")).parquet(path)
    if since is not None:
        old = old.filter((F.col("day") >= since // unit) & (F.col("ts") >= F.lit(since)))
    return edges.unionByName(old.select(*edges.columns))


def edges_per_batch_stats(edges: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Distinct nodes and rows per ingested chunk."""
    ends = (edges.select(chunk, F.col("src").alias("node")).distinct()
            .union(edges.select(chunk, F.col("dst").alias("node")).distinct()).distinct())
    per_nodes = ends.groupBy(chunk).agg(F.count(F.lit(1)).alias("num_nodes"))
    per_rows = edges.groupBy(chunk).agg(F.count(F.lit(1)).alias("num_edges"))
    return per_rows.join(per_nodes, chunk)
