"""A stored graph whose edges carry their rank within their source, kept up by appends.

    edges/version=V   edges with `rk` (1 for the oldest edge of its source), sorted by source and time
    sources           a versioned table: per source the number of edges, the newest (ts, seq), and
                      `since`, the version that ranked the source anew, 0 if none did

An append ranks its own rows and adds what their source has already. Only a source that gets a row
older than its newest one is read again: its edges are ranked anew as part of this version, and what
earlier versions hold of it no longer counts. The sources' version is complete last, so readers see
a version whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import running_sum
from ..plans.storage import freeze, scratch
from . import versioned
from .commits import commit, commits

EDGE = ("src", "dst", "ts", "eid", "seq")


def _sources(path: str) -> str:
    return f"{path}/sources"


def _rank(edges: DataFrame, strategy: str) -> DataFrame:
    return running_sum(edges.select(*EDGE), ["src"], ["ts", "seq"], {"rk": F.lit(1)}, strategy)


def append_ranked(edges: DataFrame, path: str, version: int, strategy: str = "auto") -> bool:
    """Add edges(src, dst, ts, eid, seq) as `version`; False if that is complete already.

    Within a source (ts, seq) is unique. Times are 0 or later, so that ranks from 1 on are all the
    candidates a sampler has.
    """
    spark = edges.sparkSession
    have = versioned.versions(spark, _sources(path))
    if version in have:
        return False
    if have and version < have[-1]:
        raise ValueError(f"version {version} is older than {have[-1]}")
    checked = F.when(F.col("ts") >= 0, F.col("ts")).otherwise(F.raise_error(F.lit("an edge without a time, or before 0")).cast(edges.schema["ts"].dataType))
    with scratch(spark):
        new = freeze(edges.select(*EDGE).withColumn("ts", checked), "new-edges")
        place = F.struct("ts", "seq")
        seen = new.groupBy("src").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
        zero = F.lit(0).cast("bigint")
        if have:
            known = versioned.read(spark, _sources(path), key="src", wanted=seen.select("src"))
            known = known.select("src", F.col("n").alias("had"), F.struct(F.col("last_ts").alias("ts"), F.col("last_seq").alias("seq")).alias("was"), "since")
            seen = (seen.join(known, "src", "left")
                    .select("src", "n", F.greatest("last", "was").alias("last"), F.coalesce("had", zero).alias("had"),
                            F.coalesce(F.col("first") < F.col("was"), F.lit(False)).alias("late"), F.coalesce("since", zero).alias("since")))
        else:
            seen = seen.select("src", "n", "last", zero.alias("had"), F.lit(False).alias("late"), zero.alias("since"))
        seen = freeze(seen, "new-sources")
        late = seen.filter("late").select("src")
        any_late = bool(have) and not late.isEmpty()
        ranked = (_rank(new, strategy).join(seen.filter("NOT late").select("src", "had"), "src")
                  .withColumn("rk", F.col("rk") + F.col("had")).drop("had"))
        if any_late:
            old = read_ranked(spark, path).drop("rk").join(late, "src", "left_semi")
            ranked = ranked.unionByName(_rank(old.unionByName(new.join(late, "src", "left_semi")), strategy))
        (ranked.repartitionByRange("src", "ts", "seq").sortWithinPartitions("src", "ts", "seq")
         .write.mode("overwrite").parquet(f"{path}/edges/version={version}"))
        if any_late:
            commit(spark, path, "reranked", version)
        rows = seen.select("src", (F.col("n") + F.col("had")).alias("n"), F.col("last.ts").alias("last_ts"), F.col("last.seq").alias("last_seq"),
                           F.when(F.col("late"), F.lit(version)).otherwise(F.col("since")).cast("bigint").alias("since"))
        if have:
            return versioned.append(rows, _sources(path), version, "src")
        versioned.create(rows, _sources(path), "src", version)
        return True


def read_ranked(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """src, dst, ts, eid, seq, rk of all edges as of `version` (the newest if None): a plain scan,
    joined with the sources that were ranked anew if there are any."""
    have = [v for v in versioned.versions(spark, _sources(path)) if version is None or v <= version]
    if not have:
        raise ValueError(f"no complete version of {path} at {version}")
    rows = spark.read.option("basePath", f"{path}/edges").parquet(*[f"{path}/edges/version={v}" for v in have])
    if any(c.values[0] in have for c in commits(spark, path, "reranked")):
        anew = versioned.read(spark, _sources(path), have[-1], "src").filter("since > 0").select("src", "since")
        rows = rows.join(anew, "src", "left").filter(F.col("version") >= F.coalesce("since", F.lit(0)))
    return rows.select(*EDGE, "rk")


def source_sizes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(src, n, last_ts, last_seq): a row per source, without reading edges."""
    return versioned.read(spark, _sources(path), version, "src").drop("since")
