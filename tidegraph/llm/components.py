"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi join, so neither a node with very many links nor a long
chain needs more than one row at a time; the number of rounds grows with the logarithm of the
longest path. Each round is a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) bigint links, in any order, repeats and loops allowed -> (node, root).

    `root` is the smallest node reachable. Nodes without a link to another node have no row.
    """
    edges = freeze(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        low = ends.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = freeze(edges.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("low").alias("b"))
                       .filter("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = freeze(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
