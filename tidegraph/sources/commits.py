"""Which parts of a stored table are complete.

A part is a folder of files that is written first and named in `_commits` afterwards, by an empty
file whose name says all a reader must know. Readers list that folder once and open nothing that has
no name there, so they never see a part that is half written, or is being written again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession

FOLDER = "_commits"


class Commit(NamedTuple):
    kind: str
    values: tuple[int | None, ...]


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}")
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def commit(spark: SparkSession, path: str, kind: str, *values: int | None) -> None:
    """Name a part as complete; naming it twice is naming it once."""
    files, folder = _folder(spark, path)
    name = ".".join([kind, *("" if v is None else str(v) for v in values)])
    files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True).close()


def commits(spark: SparkSession, path: str, kind: str | None = None) -> list[Commit]:
    """All complete parts, by kind and values."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName().split(".") for s in files.listStatus(folder)]
    found = [Commit(k, tuple(int(v) if v else None for v in values)) for k, *values in names if k and kind in (None, k)]
    return sorted(found, key=lambda c: (c.kind, *(0 if v is None else v for v in c.values)))


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(spark: SparkSession, path: str, part: Commit, data: str) -> None:
    """Take a part's name away, then its files."""
    delete(spark, ".".join([f"{path}/{FOLDER}/{part.kind}", *("" if v is None else str(v) for v in part.values)]))
    delete(spark, data)
