"""Keyed tables stored as a base and deltas: an update writes its own rows, a read merges.

    base/version=V    all rows as of version V, at most one per key
    delta/version=V   the rows that version V wrote, at most one per key

Files are sorted by key, so a lookup in a range of keys reads few row groups; a delta's range is part
of its name, so deltas that can't hold a wanted key are not opened. A merge compares keys and
versions only; vectors are moved once, after their row has won. Compaction folds the deltas up to a
version into a new base, and earlier versions stay readable until they are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Commit, commit, commits, forget

VERSION = "version"


def _data(path: str, kind: str, version: int) -> str:
    return f"{path}/{kind}/{VERSION}={version}"


def _write(rows: DataFrame, path: str, kind: str, version: int, key: str) -> None:
    spark, where = rows.sparkSession, _data(path, kind, version)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(where)
    low = high = None
    if isinstance(rows.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        low, high = spark.read.schema(rows.schema).parquet(where).agg(F.min(key), F.max(key)).first()
    commit(spark, path, kind, version, low, high)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are complete, oldest first."""
    return sorted({c.values[0] for c in commits(spark, path) if c.kind in ("base", "delta")})


def create(table: DataFrame, path: str, key: str = "id", version: int = 0) -> None:
    """Store `table`, which has one row per key, as the first base."""
    _write(table, path, "base", version, key)


def append(updates: DataFrame, path: str, version: int, key: str = "id", order: str | None = None) -> bool:
    """Write `updates` as a delta; of several rows of a key the one with the highest `order` stays.

    A version that is complete is not written again, whatever it holds: then False. Versions rise.
    """
    spark = updates.sparkSession
    have = versions(spark, path)
    if version in have:
        return False
    if not have or version < have[-1]:
        raise ValueError(f"version {version} is older than {have[-1:]} or there is no base")
    if order:
        values = [c for c in updates.columns if c not in (key, order)]
        last = updates.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_l"))
        updates = last.select(key, *[F.col(f"_l.{c}").alias(c) for c in values])
    _write(updates, path, "delta", version, key)
    return True


def _parts(spark: SparkSession, path: str, version: int | None) -> tuple[Commit, list[Commit]]:
    found = [c for c in commits(spark, path) if version is None or c.values[0] <= version]
    bases = [c for c in found if c.kind == "base"]
    if not bases:
        raise ValueError(f"no complete version of {path} at {version}")
    base = bases[-1]
    return base, [c for c in found if c.kind == "delta" and c.values[0] > base.values[0]]


def read(spark: SparkSession, path: str, version: int | None = None, key: str = "id", wanted: DataFrame | None = None) -> DataFrame:
    """The rows as of `version`, the newest one if it is None; with `wanted` only those of its keys.

    The smallest and the largest wanted key are asked for first and prune deltas and row groups.
    """
    base, deltas = _parts(spark, path, version)
    rows = spark.read.parquet(_data(path, "base", base.values[0]))
    kept = lambda df: df
    if wanted is not None:
        keys = wanted.select(F.col(key)).distinct()
        low, high = keys.agg(F.min(key), F.max(key)).first()
        deltas = [c for c in deltas if low is not None and (c.values[1] is None or c.values[1] <= high and c.values[2] >= low)]
        kept = lambda df: df.filter(F.col(key).between(low, high)).join(keys, key, "left_semi")
    if not deltas:
        return kept(rows)
    changed = kept(spark.read.option("basePath", f"{path}/delta").parquet(*[_data(path, "delta", c.values[0]) for c in deltas]))
    newest = changed.groupBy(key).agg(F.max(VERSION).alias(VERSION))
    return (kept(rows).join(newest.select(key), key, "left_anti")
            .unionByName(changed.join(newest, [key, VERSION], "left_semi").drop(VERSION)))


def lookup(spark: SparkSession, path: str, requests: DataFrame, version: int | None = None, key: str = "id") -> DataFrame:
    """One row per request (`req`, key), repeats kept, NULL for unknown keys, as of `version`."""
    found = read(spark, path, version, key, wanted=requests)
    return requests.select("req", key).join(found, key, "left")


def compact(spark: SparkSession, path: str, through: int | None = None, key: str = "id") -> int:
    """Fold the deltas up to version `through` into a base of that version; its number."""
    base, deltas = _parts(spark, path, through)
    version = max([base.values[0], *(c.values[0] for c in deltas)])
    if deltas:
        _write(read(spark, path, version, key), path, "base", version, key)
    return version


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Delete what only versions below `before` need. They can't be read any more."""
    base, _ = _parts(spark, path, before)
    for part in commits(spark, path):
        v = part.values[0]
        if part.kind == "base" and v < base.values[0] or part.kind == "delta" and v <= base.values[0]:
            forget(spark, path, part, _data(path, part.kind, v))
