"""Graph partitioning and its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import partition as P
from ..plans.storage import freeze, new_path
from .common import (PARTS, both_ways, edge_features, event_edges, item_ptable, node_vectors, order_edges, query,
                     sql_hash, table)

WORKERS = 3


def _table(ptable):
    return ptable.select("node", F.col("pid").cast("bigint").alias("pid"))


@query(f"SELECT node, {sql_hash('node')} % {PARTS} AS pid FROM (SELECT DISTINCT src AS node FROM oe)")
def partition_hash(spark, sf):
    return _table(P.partition_hash(order_edges(spark, sf), PARTS))


@query(f"""SELECT node, pid FROM item_pt UNION ALL SELECT node, (row_number() OVER (ORDER BY node) - 1) % {PARTS}
    FROM (SELECT DISTINCT src AS node FROM rv) WHERE node NOT IN (SELECT node FROM item_pt)""")
def partition_round_robin(spark, sf):
    """Items keep their partition, users are new."""
    return _table(P.partition_round_robin(both_ways(spark, sf), PARTS, item_ptable(spark, sf)))


def balanced_sql(weight: str) -> str:
    return f"""WITH per AS (SELECT src AS node, {weight} AS w FROM oe, (SELECT min(ts) AS t0 FROM oe) GROUP BY src),
        run AS (SELECT node, w, sum(w) OVER (ORDER BY node) AS cum, sum(w) OVER () AS total FROM per)
        SELECT node, least({PARTS - 1}, ({PARTS} * (cum - w)) // total)::BIGINT AS pid FROM run"""


@query(balanced_sql("count(*)::HUGEINT"))
def partition_balanced_edgecount(spark, sf):
    return _table(P.partition_balanced(order_edges(spark, sf), PARTS, "edgecount"))


@query(balanced_sql("sum((ts - t0)::HUGEINT)"))
def partition_balanced_timestampsum(spark, sf):
    return _table(P.partition_balanced(order_edges(spark, sf), PARTS, "timestampsum"))


@query(balanced_sql("sum((ts - t0)::HUGEINT) // count(*)"))
def partition_balanced_timestampavg(spark, sf):
    return _table(P.partition_balanced(order_edges(spark, sf), PARTS, "timestampavg"))


FENNEL = f"""WITH size AS (SELECT p.pid, count(item_pt.node) AS n FROM (SELECT unnest(range(0, {PARTS})) AS pid) p
      LEFT JOIN item_pt USING (pid) GROUP BY p.pid),
    g AS (SELECT count(*) AS m, (SELECT count(*) FROM (SELECT src FROM rv UNION SELECT dst FROM rv)) AS maxn FROM rv),
    near AS (SELECT src AS node, pid, count(*) AS c FROM rv JOIN item_pt ON item_pt.node = dst
      WHERE src NOT IN (SELECT node FROM item_pt) GROUP BY ALL),
    score AS (SELECT u.node, s.pid, coalesce(c, 0)
        - sqrt({PARTS}) * m / power(maxn, 1.5) * 1.5 * power(s.n, 0.5) AS score
      FROM (SELECT DISTINCT src AS node FROM rv WHERE src NOT IN (SELECT node FROM item_pt)) u CROSS JOIN size s CROSS JOIN g
      LEFT JOIN near ON near.node = u.node AND near.pid = s.pid WHERE s.n < maxn * 1.1 / {PARTS})
    SELECT node, pid FROM (SELECT node, pid, row_number() OVER (PARTITION BY node ORDER BY score DESC, pid) AS k FROM score)
    WHERE k = 1"""


def fill_sql(held: str, fresh: str) -> str:
    """Clauses up to `filled`(node, pid): nodes of `fresh`(node, w), in id order, laid end to end over
    the room below one level that the partitions of `held`(pid, l) leave."""
    return f"""ranked AS (SELECT pid, l, row_number() OVER (ORDER BY l, pid) - 1 AS i, sum(l) OVER (ORDER BY l, pid) - l AS below,
      lead(l) OVER (ORDER BY l, pid) AS nxt FROM {held}),
    laid AS (SELECT node, w, sum(w) OVER (ORDER BY node) - w AS begins FROM {fresh}),
    tot AS (SELECT coalesce(sum(w), 0) AS total FROM laid),
    used AS (SELECT min(i + 1) AS u FROM ranked, tot WHERE nxt IS NULL OR total + below + l <= (i + 1) * nxt),
    lv AS (SELECT u, total + (SELECT sum(l) FROM ranked WHERE i < u) AS level FROM used, tot),
    starts AS (SELECT pid, i, ceil((i * level - u * below)::DOUBLE / u)::BIGINT AS s FROM ranked, lv WHERE i < u),
    filled AS (SELECT node, arg_max(pid, i) AS pid FROM laid JOIN starts ON begins >= s OR i = 0 GROUP BY node)"""


@query(f"""WITH per AS (SELECT src AS node, count(*) AS w FROM rv GROUP BY src),
    held AS (SELECT p.pid, coalesce(sum(w), 0) AS l FROM (SELECT unnest(range(0, {PARTS})) AS pid) p
      LEFT JOIN item_pt USING (pid) LEFT JOIN per USING (node) GROUP BY p.pid),
    fresh AS (SELECT node, w FROM per WHERE node NOT IN (SELECT node FROM item_pt)),
    {fill_sql('held', 'fresh')}
    SELECT node, pid FROM item_pt UNION ALL SELECT node, pid FROM filled""")
def partition_balanced_on_table(spark, sf):
    """Items keep their partition; users fill the room that the items' edges leave."""
    return _table(P.partition_balanced(both_ways(spark, sf), PARTS, "edgecount", item_ptable(spark, sf)))


@query(FENNEL)
def fennel_round(spark, sf):
    return _table(P.fennel_round(both_ways(spark, sf), item_ptable(spark, sf), PARTS))


ROUNDS = 4
EMPTY = "t0 AS (SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS pid WHERE false)"
PIDS = f"(SELECT unnest(range(0, {PARTS})) AS pid) p"


def fennel_rounds_sql() -> str:
    """All rounds unrolled; what no round had room for is filled in at the end."""
    steps = [EMPTY, "g AS (SELECT count(*) AS m, (SELECT count(*) FROM (SELECT src FROM rv UNION SELECT dst FROM rv)) AS maxn FROM rv)",
             f"slices AS (SELECT node, {sql_hash('node')} % {ROUNDS} AS slice FROM (SELECT DISTINCT src AS node FROM rv))"]
    for r in range(ROUNDS):
        steps += [
            f"size{r} AS (SELECT p.pid, count(t.node) AS n FROM {PIDS} LEFT JOIN t{r} t ON t.pid = p.pid GROUP BY p.pid)",
            f"turn{r} AS (SELECT node FROM slices WHERE slice <= {r} AND node NOT IN (SELECT node FROM t{r}))",
            f"near{r} AS (SELECT src AS node, t.pid, count(*) AS c FROM rv JOIN t{r} t ON t.node = dst GROUP BY ALL)",
            f"""score{r} AS (SELECT u.node, s.pid, coalesce(c, 0) - sqrt({PARTS}) * m / power(maxn, 1.5) * 1.5 * power(s.n, 0.5) AS score
                FROM turn{r} u CROSS JOIN size{r} s CROSS JOIN g LEFT JOIN near{r} x ON x.node = u.node AND x.pid = s.pid
                WHERE s.n < maxn * 1.1 / {PARTS})""",
            f"""best{r} AS (SELECT node, pid, row_number() OVER (PARTITION BY pid ORDER BY node) AS nth FROM (SELECT node, pid,
                row_number() OVER (PARTITION BY node ORDER BY score DESC, pid) AS k FROM score{r}) WHERE k = 1)""",
            f"""t{r + 1} AS (SELECT * FROM t{r} UNION ALL SELECT node, pid FROM best{r} JOIN size{r} USING (pid), g
                WHERE n + nth <= maxn * 1.1 / {PARTS})"""]
    steps += [f"held AS (SELECT p.pid, count(t.node) AS l FROM {PIDS} LEFT JOIN t{ROUNDS} t ON t.pid = p.pid GROUP BY p.pid)",
              f"fresh AS (SELECT node, 1 AS w FROM slices WHERE node NOT IN (SELECT node FROM t{ROUNDS}))", fill_sql("held", "fresh")]
    return f"WITH {', '.join(steps)} SELECT node, pid FROM t{ROUNDS} UNION ALL SELECT node, pid FROM filled"


@query(fennel_rounds_sql())
def partition_fennel(spark, sf):
    return _table(P.partition_fennel(both_ways(spark, sf), PARTS))


FENNEL_EDGE = f"""WITH deg AS (SELECT src AS node, count(*) AS d FROM rv GROUP BY src),
    load AS (SELECT p.pid, coalesce(sum(d), 0) AS l FROM (SELECT unnest(range(0, {PARTS})) AS pid) p
      LEFT JOIN item_pt USING (pid) LEFT JOIN deg USING (node) GROUP BY p.pid),
    new AS (SELECT node, d FROM deg WHERE node NOT IN (SELECT node FROM item_pt)),
    near AS (SELECT node, pid, sum(c) + sum(d) AS loc FROM (
        SELECT e.src AS node, i.pid, e.dst, count(*) AS c, any_value(deg.d) AS d FROM rv e JOIN item_pt i ON i.node = e.dst
        LEFT JOIN deg ON deg.node = e.dst GROUP BY e.src, i.pid, e.dst) GROUP BY node, pid),
    score AS (SELECT new.node, load.pid, l, CASE WHEN l + d <= 1.25 * (SELECT count(*) FROM rv) / {PARTS}
        THEN coalesce(loc, 0) - l END AS score FROM new CROSS JOIN load LEFT JOIN near ON near.node = new.node AND near.pid = load.pid)
    SELECT node, pid FROM (SELECT node, pid, row_number() OVER (PARTITION BY node
      ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN l END, pid) AS k FROM score) WHERE k = 1"""


@query(FENNEL_EDGE)
def fennel_edge_round(spark, sf):
    return _table(P.fennel_edge_round(both_ways(spark, sf), item_ptable(spark, sf), PARTS))


def fennel_edge_rounds_sql() -> str:
    """All rounds unrolled, with the load limit, then the rest filled up to one level."""
    limit = f"1.25 * (SELECT count(*) FROM rv) / {PARTS}"
    steps = [EMPTY, "deg AS (SELECT src AS node, count(*) AS d FROM rv GROUP BY src)",
             "waiting AS (SELECT node, d, row_number() OVER (ORDER BY d, node) - 1 AS o, count(*) OVER () AS n FROM deg)"]
    for r in range(ROUNDS + 1):
        steps.append(f"""load{r} AS (SELECT p.pid, coalesce(sum(d), 0)::BIGINT AS l FROM {PIDS} LEFT JOIN t{r} t ON t.pid = p.pid
            LEFT JOIN deg ON deg.node = t.node GROUP BY p.pid)""")
        if r == ROUNDS:
            break
        steps += [
            f"turn{r} AS (SELECT node, d FROM waiting WHERE o < (n * {r + 1}) // {ROUNDS} AND node NOT IN (SELECT node FROM t{r}))",
            f"""near{r} AS (SELECT node, pid, sum(c + d) AS loc FROM (SELECT e.src AS node, t.pid, e.dst, count(*) AS c, any_value(d) AS d
                FROM rv e JOIN t{r} t ON t.node = e.dst JOIN deg ON deg.node = e.dst GROUP BY e.src, t.pid, e.dst) GROUP BY node, pid)""",
            f"""score{r} AS (SELECT u.node, u.d, s.pid, l, CASE WHEN l + u.d <= {limit} THEN coalesce(loc, 0) - l END AS score
                FROM turn{r} u CROSS JOIN load{r} s LEFT JOIN near{r} x ON x.node = u.node AND x.pid = s.pid)""",
            f"""choice{r} AS (SELECT node, d, pid, l + sum(d) OVER (PARTITION BY pid ORDER BY d, node) AS filled FROM (
                SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC NULLS LAST,
                  CASE WHEN score IS NULL THEN l END, pid) AS k FROM score{r}) WHERE k = 1)""",
            f"t{r + 1} AS (SELECT * FROM t{r} UNION ALL SELECT node, pid FROM choice{r} WHERE filled <= {limit})"]
    last = f"t{ROUNDS}"
    steps += [
        f"""rest AS (SELECT node, sum(d) OVER (ORDER BY d, node) - d AS before, sum(d) OVER () AS total
            FROM waiting WHERE node NOT IN (SELECT node FROM {last}))""",
        f"""places AS (SELECT pid, l, row_number() OVER (ORDER BY l, pid) AS u, sum(l) OVER (ORDER BY l, pid) AS upto,
            lead(l) OVER (ORDER BY l, pid) AS following FROM load{ROUNDS})""",
        """used AS (SELECT min(u) AS used, min_by(upto, u) AS s FROM places
            WHERE following IS NULL OR (SELECT any_value(total) FROM rest) + upto <= u * following)""",
        """starts AS (SELECT pid, u, CASE WHEN u = 1 THEN 0 ELSE
            ceil(((u - 1) * ((SELECT any_value(total) FROM rest) + s) - used * (upto - l)) / used) END AS start
            FROM places, used WHERE u <= used)"""]
    return f"""WITH {', '.join(steps)} SELECT node, pid FROM {last} UNION ALL
        SELECT node, max_by(pid, u) FROM rest JOIN starts ON before >= start GROUP BY node"""


@query(fennel_edge_rounds_sql())
def partition_fennel_edge(spark, sf):
    return _table(P.partition_fennel_edge(both_ways(spark, sf), PARTS))


MAJORITY = """SELECT node, pid FROM item_pt UNION ALL SELECT node, pid FROM (
    SELECT src AS node, pid, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, pid) AS k
    FROM rv JOIN item_pt ON node = dst WHERE src NOT IN (SELECT node FROM item_pt) GROUP BY src, pid) WHERE k = 1"""


@query(MAJORITY)
def assign_by_dst_majority(spark, sf):
    return _table(P.assign_by_dst_majority(both_ways(spark, sf), item_ptable(spark, sf)))


@query("SELECT src, dst, eid, pid FROM rv LEFT JOIN item_pt ON node = src")
def dispatch_by_source(spark, sf):
    return P.dispatch_by_source(both_ways(spark, sf), item_ptable(spark, sf)).select(
        "src", "dst", "eid", F.col("pid").cast("bigint").alias("pid"))


@query(f"""WITH pt AS (SELECT node, {sql_hash('node')} % {PARTS} AS pid FROM (SELECT DISTINCT src AS node FROM ev))
    SELECT node, pid FROM pt UNION ALL SELECT node, (row_number() OVER (ORDER BY node) - 1) % {PARTS}
    FROM (SELECT DISTINCT dst AS node FROM ev) WHERE node NOT IN (SELECT node FROM pt)""")
def assign_residual(spark, sf):
    edges = event_edges(spark, sf)
    return _table(P.assign_residual(G.nodes(edges), P.partition_hash(edges, PARTS), PARTS))


def equal_sql() -> str:
    """The cascade spelled out: the i-th largest passes rows beyond the mean to the next."""
    steps = []
    for i in range(1, PARTS + 1):
        own = f"SELECT eid, pid, o FROM ranked WHERE place = {i}"
        passed = (f" UNION ALL SELECT eid, (SELECT pid FROM sizes WHERE place = {i}), o - mean + (SELECT n FROM sizes WHERE place = {i}) "
                  f"FROM s{i - 1}, mean WHERE o >= mean") if i > 1 else ""
        steps.append(f"s{i} AS ({own}{passed})")
    final = " UNION ALL ".join(f"SELECT eid, pid, o FROM s{i}, mean WHERE o < mean" for i in range(1, PARTS + 1))
    return f"""placed AS (SELECT eid, {sql_hash('src')} % {PARTS} AS pid FROM ev),
        sizes AS (SELECT pid, n, row_number() OVER (ORDER BY n DESC, pid DESC) AS place FROM
          (SELECT p.pid, count(eid) AS n FROM (SELECT unnest(range(0, {PARTS})) AS pid) p LEFT JOIN placed USING (pid) GROUP BY p.pid)),
        mean AS (SELECT sum(n) // {PARTS} AS mean FROM sizes),
        ranked AS (SELECT eid, placed.pid, place, row_number() OVER (PARTITION BY placed.pid ORDER BY eid) - 1 AS o
          FROM placed JOIN sizes USING (pid)), {', '.join(steps)}, equal AS ({final})"""


def equalized(spark, sf):
    edges = event_edges(spark, sf)
    return P.equalize(P.dispatch_by_source(edges, P.partition_hash(edges, PARTS)), PARTS)


@query(f"WITH {equal_sql()} SELECT eid, pid::BIGINT AS new_pid, o::BIGINT AS pos FROM equal")
def equalize(spark, sf):
    return equalized(spark, sf).select("eid", F.col("new_pid").cast("bigint").alias("new_pid"), "pos")


@query(f"""WITH {equal_sql()} SELECT eid, pid::BIGINT AS new_pid, (o % {WORKERS})::BIGINT AS worker FROM equal, mean
    WHERE o < mean - mean % {WORKERS}""")
def interleave_workers(spark, sf):
    return P.interleave_workers(equalized(spark, sf), WORKERS).select(
        "eid", F.col("new_pid").cast("bigint").alias("new_pid"), F.col("worker").cast("bigint").alias("worker"))


@query("""SELECT 'node' AS kind, node AS id, pid FROM item_pt UNION ALL
    SELECT 'edge', eid, pid FROM (SELECT eid, pid FROM rv JOIN item_pt ON node = src)""")
def place_features(spark, sf):
    """Features written by owner and read back; here items are the sources."""
    ptable, path = item_ptable(spark, sf), new_path(spark, "placed")
    reverse = event_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts", "eid", "seq")
    P.place_node_features(node_vectors(spark, sf), ptable).write.partitionBy("pid").parquet(f"{path}/node")
    P.place_edge_features(edge_features(spark, sf), reverse, ptable).write.partitionBy("pid").parquet(f"{path}/edge")
    pid = F.col("pid").cast("bigint").alias("pid")
    return (spark.read.parquet(f"{path}/node").select(F.lit("node").alias("kind"), "id", pid)
            .unionByName(spark.read.parquet(f"{path}/edge").select(F.lit("edge").alias("kind"), F.col("eid").alias("id"), pid)))


@query(f"""WITH s AS (SELECT p.pid, count(node) AS n FROM (SELECT unnest(range(0, {PARTS})) AS pid) p LEFT JOIN item_pt USING (pid)
    GROUP BY p.pid) SELECT pid, n AS num_nodes, round((SELECT max(n) / greatest(min(n), 1) FROM s), 6) AS load_factor FROM s""")
def partition_nodes_stats(spark, sf):
    got = P.partition_nodes_stats(item_ptable(spark, sf), PARTS)
    return got.select(F.col("pid").cast("bigint").alias("pid"), "num_nodes", F.round("load_factor", 6).alias("load_factor"))


@query(f"""WITH s AS (SELECT {sql_hash('src')} % {PARTS} AS pid, count(*) AS n FROM oe GROUP BY pid)
    SELECT pid, n AS num_edges, round((SELECT stddev_pop(n) / avg(n) FROM s), 6) AS relative_std FROM s""")
def partition_edge_stats(spark, sf):
    edges = order_edges(spark, sf)
    placed = freeze(P.dispatch_by_source(edges, P.partition_hash(edges, PARTS)), "placed")
    got = P.partition_edge_stats(placed, PARTS)
    return got.select(F.col("pid").cast("bigint").alias("pid"), "num_edges", F.round("relative_std", 6).alias("relative_std"))


@query(f"""SELECT count(*) FILTER (WHERE a <> b) AS cut, count(*) AS total,
    round(100.0::DOUBLE * count(*) FILTER (WHERE a <> b) / count(*), 6) AS percent FROM
    (SELECT {sql_hash('src')} % {PARTS} AS a, {sql_hash('dst')} % {PARTS} AS b FROM rv)""")
def edge_cut(spark, sf):
    edges = both_ways(spark, sf)
    return P.edge_cut(edges, P.partition_hash(edges, PARTS)).withColumn("percent", F.round("percent", 6))


@query("""SELECT count(*) AS cut, count(*) AS total, 100.0::DOUBLE AS percent FROM rv""")
def edge_cut_with_unassigned(spark, sf):
    """Only items are assigned, so every edge has one end without a partition and counts as cut."""
    return P.edge_cut(both_ways(spark, sf), item_ptable(spark, sf), skip_unassigned=False)


@query("SELECT count(*) AS new_customers FROM (SELECT DISTINCT src FROM oe WHERE src NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def new_sources(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("node"), F.lit(0).alias("pid"))
    return P.new_sources(order_edges(spark, sf), known).agg(F.count(F.lit(1)).alias("new_customers"))
