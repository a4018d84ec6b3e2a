"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries are run once to warm up, then each twice; the faster run counts. Results are written to
the no-op sink, so every row is computed. BENCH_DIRECT=1 also times the direct time-range join.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators import graph as G
from tidegraph.operators import sampling as S
from tidegraph.plans.storage import new_path
from tidegraph.queries import QUERIES
from tidegraph.queries.common import both_ways, end_roots, event_edges, event_roots
from tidegraph.session import local_session
from tidegraph.sources import ranked

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ORDER_LINES = ("sample_recent_with_ties", "partition_balanced_edgecount")


def direct_join(edges: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """The plan the sampler avoids: join on a time range, then keep the newest k."""
    e = edges.select(F.col("src").alias("node"), F.col("ts").alias("edge_ts"), "eid", "seq")
    newest = Window.partitionBy("rid").orderBy(F.desc("edge_ts"), F.desc("seq"))
    return (roots.join(e, "node").filter("edge_ts < ts").withColumn("n", F.row_number().over(newest))
            .filter(F.col("n") <= k))


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), memory=os.environ.get("BENCH_MEMORY", "12g"), name="bench")
    n_events = spark.read.parquet(f"{SF}/events.parquet").count()
    n_lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()

    def hops(fanouts, how="recent"):
        layers = S.sample_multi_hop(both_ways(spark, SF), end_roots(spark, SF), fanouts, how, seed=1)
        return layers[0].select("rid", "slot", "src_node", "eid", "dt")

    def hot_split(k):
        """Nodes with more rows than a fiftieth of the events count as hot."""
        spark.conf.set("spark.tidegraph.maxGroupRows", str(n_events // 50))
        try:
            return S.sample_recent(both_ways(spark, SF), end_roots(spark, SF), k)
        finally:
            spark.conf.unset("spark.tidegraph.maxGroupRows")

    stored: dict[str, str] = {}

    def bucketed() -> str:
        """A table bucketed by source, written once and not timed."""
        if "table" not in stored:
            path = new_path(spark, "bucketed")
            stored["table"] = f"edges_{path[-32:]}"
            G.write_bucketed(both_ways(spark, SF), stored["table"], int(CPUS), path)
        return stored["table"]

    def ranks() -> DataFrame:
        """Edges with stored ranks, written once and not timed."""
        if "ranks" not in stored:
            stored["ranks"] = new_path(spark, "ranked")
            ranked.append_ranked(both_ways(spark, SF), stored["ranks"], 1)
        return ranked.read_ranked(spark, stored["ranks"])

    # name -> (query, units of work, unit)
    work = {
        "ingest_and_sort": (lambda: G.temporal_sort(both_ways(spark, SF)), 2 * n_events, "edges"),
        "recent_k10": (lambda: S.sample_recent(event_edges(spark, SF), event_roots(spark, SF), 10), n_events, "roots"),
        "recent_k10_both_ways": (lambda: S.sample_recent(both_ways(spark, SF), end_roots(spark, SF), 10), 2 * n_events, "roots"),
        "recent_k10_hot_safe": (lambda: S.sample_recent(both_ways(spark, SF), end_roots(spark, SF), 10, strategy="ranged"),
                                2 * n_events, "roots"),
        "uniform_k10": (lambda: S.sample_uniform(S.rank_edges(both_ways(spark, SF)), end_roots(spark, SF), 10),
                        2 * n_events, "roots"),
        "recent_10_10": (lambda: hops([10, 10]), 2 * n_events, "roots"),
        "uniform_3_3": (lambda: hops([3, 3], "uniform"), 2 * n_events, "roots"),
        "recent_k10_hot_split": (lambda: hot_split(10), 2 * n_events, "roots"),
        "recent_k10_bucketed": (lambda: S.sample_bucketed(spark, bucketed(), end_roots(spark, SF), 10), 2 * n_events, "roots"),
        "uniform_k10_stored_ranks": (lambda: S.sample_uniform(ranks(), end_roots(spark, SF), 10), 2 * n_events, "roots"),
        "snapshots_3": (lambda: QUERIES["sample_snapshots"](spark, SF), 2 * n_events, "roots"),
    }
    for name in ("sample_recent_with_ties", "target_triples", "neighbor_mean", "update_mailbox", "roc_auc",
                 "fennel_round", "partition_balanced_edgecount", "equalize", "prequential"):
        units = (n_lines, "order lines") if name in ORDER_LINES else (n_events, "events")
        work[name] = (lambda name=name: QUERIES[name](spark, SF), *units)
    if os.environ.get("BENCH_DIRECT"):
        work["direct_join_k10_both_ways"] = (lambda: direct_join(both_ways(spark, SF), end_roots(spark, SF), 10),
                                             2 * n_events, "roots")
    only = sys.argv[1:]
    work = {name: w for name, w in work.items() if not only or name in only}
    seconds, rates = {}, {}

    def run(build) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name, (build, _, _) in work.items():
        if not name.startswith("direct_join"):
            run(build)
    for name, (build, units, unit) in work.items():
        best = min(run(build) for _ in range(2))
        seconds[name] = round(best, 3)
        rates[name] = f"{units / best:.0f} {unit}/s"
        print(f"# {name}: {seconds[name]} s, {rates[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rates": rates, "sf": SF.rstrip("/").rsplit("/sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
