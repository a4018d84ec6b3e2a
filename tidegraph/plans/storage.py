"""Durable intermediate tables.

Some plans read an intermediate result twice and need both reads to see the same rows in the same
partitions. Those results are written once, as parquet, to the shared folder the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a different answer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegraph-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


# The folder of the innermost `scratch` block, if any.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidegraph/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder; all of one application lie together, so they can be dropped when it is over."""
    return f"{_SCRATCH.get() or _application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block goes when it ends.

    Frames made in it can't be used afterwards; write what is to stay to a path made before.
    """
    path = new_path(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        _delete(spark, path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all that this application has written here; frames read from it can't be used any more."""
    _delete(spark, _application_dir(spark))


def write_to(df: DataFrame, path: str) -> DataFrame:
    """`df` written to a path of one's own and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and return it read back: cut lineage, fixed content."""
    return write_to(df, new_path(df.sparkSession, label))
