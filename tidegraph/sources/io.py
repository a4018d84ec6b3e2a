"""Reading and writing edges, features, partition tables and state. Schemas are declared."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_float32
from ..operators.partition import dispatch_by_source
from ..plans.ordering import dense_ordinal
from ..schema import EDGE_FILE, FEATURES, PARTITION_TABLE

SPLITS = ("train", "val", "test")
INDEX_NAMES = ("Unnamed: 0", "_c0", "eid")  # a column without a name reads as _c0


def read_edges(spark: SparkSession, path: str, fmt: str = "csv", time_type: str = "double") -> DataFrame:
    """Edge file with an unnamed index column: the index becomes the eid, time becomes ts.

    Columns are found by name, wherever they stand; other columns are not read. Files of one folder
    must have one header.
    """
    raw = (spark.read.option("header", True).csv(path) if fmt == "csv"
           else spark.read.format(fmt).load(path))
    index = next((c for c in INDEX_NAMES if c in raw.columns), INDEX_NAMES[0])
    wanted = {f.name if f.name != INDEX_NAMES[0] else index: f.dataType for f in EDGE_FILE}
    if missing := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"the edge file lacks columns {missing}")
    typed = raw.select(*[F.col(f"`{c}`").cast(kind).alias("eid" if c == index else c) for c, kind in wanted.items()])
    return typed.select("src", "dst", F.col("time").cast(time_type).alias("ts"), "eid", F.col("eid").alias("seq"), "ext_roll")


def split_by_roll(edges: DataFrame) -> dict[str, DataFrame]:
    """train / val / test by ext_roll 0 / 1 / 2."""
    return {name: edges.filter(F.col("ext_roll") == i).drop("ext_roll") for i, name in enumerate(SPLITS)}


def edge_chunks(edges: DataFrame, first: int, following: int, order_by: tuple[str, ...] = ("eid",)) -> DataFrame:
    """`chunk` number per row: one large first chunk, then chunks of `following` rows."""
    ordered = dense_ordinal(edges, order_by)
    return ordered.withColumn("chunk", F.when(F.col("ord") < first, F.lit(0).cast("bigint"))
                              .otherwise(1 + F.floor((F.col("ord") - first) / following)))


def write_edge_shards(edges: DataFrame, path: str, world: int, order_by: tuple[str, ...] = ("eid",)) -> None:
    """Rows of each split dealt out to `world` workers, laid out for partition pruning."""
    dealt = dense_ordinal(edges, order_by).withColumn("rank", F.pmod("ord", F.lit(world)).cast("int")).drop("ord")
    # order columns in the range key keep one big (split, rank) from becoming one task
    (dealt.repartitionByRange("split", "rank", *order_by).sortWithinPartitions("split", "rank", *order_by)
     .write.partitionBy("split", "rank").parquet(path))


def read_edge_shard(spark: SparkSession, path: str, rank: int, split: str) -> DataFrame:
    """One worker's rows of one split: only its folders are listed and read."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return spark.read.parquet(path).filter((F.col("split") == split) & (F.col("rank") == rank)).drop("split", "rank")


def read_features(spark: SparkSession, node: str | None = None,
                  edge: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Node features (id, feat) and edge features (eid, feat) as float32; each is optional.

    A path may be a folder of row-split parts; values stored as another number type are cast.
    """
    def load(path: str | None) -> DataFrame | None:
        if path is None:
            return None
        return spark.read.parquet(path).select("id", to_float32("feat").alias("feat"))

    nodes, edges = load(node), load(edge)
    return nodes, None if edges is None else edges.withColumnRenamed("id", "eid")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix in .npy files, one or several parts in the order of their names, as (id, feat): row i
    belongs to id i, values become float32.

    Spark reads the files, from wherever it can; a part is one value of a row and so below 2 GB. One
    number per part, its rows, comes to the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(np.load(BytesIO(content))) for content in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["path", "rows"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matrix = np.load(BytesIO(content))
                step = max(1, 4_000_000 // max(1, matrix.shape[1]))
                for low in range(0, len(matrix), step):
                    part = matrix[low:low + step].astype(np.float32)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(start + low, start + low + len(part), dtype=np.int64)),
                         pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["id", "feat"])

    sizes = sorted(files.select("path", "content").mapInArrow(counted, "path string, rows bigint").collect())
    starts = spark.createDataFrame(list(zip((r.path for r in sizes), accumulate((r.rows for r in sizes), initial=0))), "path string, start bigint")
    return files.join(F.broadcast(starts), "path").select("content", "start").mapInArrow(rows, FEATURES)


def write_partitioned_edges(edges: DataFrame, ptable: DataFrame, path: str) -> None:
    """Every partition's edges in its own folder, sorted for its sampler."""
    placed = dispatch_by_source(edges, ptable).filter(F.col("pid").isNotNull())
    (placed.repartitionByRange("pid", "src", "ts", "seq").sortWithinPartitions("pid", "src", "ts", "seq")
     .write.partitionBy("pid").parquet(path))


def read_partition_table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A precomputed node -> partition table, if there is one; -1 reads as unassigned."""
    if path is None:
        return None
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.schema(PARTITION_TABLE).parquet(path).filter("pid >= 0")


def snapshot_state(state: DataFrame, path: str, version: int) -> None:
    """Back up the node state under a version number."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def restore_state(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A backed-up state, with the time type it had."""
    return spark.read.parquet(f"{path}/version={version}")
