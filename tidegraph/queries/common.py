"""Registry of queries over the standard tables, each with its SQL equivalent where one is feasible.

Edges come from two places: `events` (user -> item, microsecond times) and `orders` x `lineitem`
(customer -> part, day-grained times, many ties).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import in_millionths
from ..operators.graph import add_reverse
from ..plans.ordering import dense_ordinal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; `sql` may refer to the views in VIEWS by name."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_views(sql)
        return fn
    return register


def whole(column):
    """All components of a vector in millionths, as one text: every number is compared."""
    return in_millionths(column)


def whole_sql(vector: str) -> str:
    return f"array_to_string([CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) FOR x IN {vector}], ',')"


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY = 86_400_000_000
ITEM = 1_000_000
PART = 10_000_000
PARTS = 4
SEED = 7
BATCH = 600
MID = 1_705_363_200_000_000  # 2024-01-16, the middle of the event period


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, ts, eid, seq; one edge per event."""
    return edges_from_events(table(spark, sf, "events"))


def edges_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("src"), (F.get_json_object("props", "$.k").cast("bigint") + ITEM).alias("dst"),
        micros("ts").alias("ts"), F.col("event_id").alias("eid"), F.col("event_id").alias("seq"))


def both_ways(spark: SparkSession, sf: str) -> DataFrame:
    return add_reverse(event_edges(spark, sf))


ORDER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*ORDER_KEYS)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        *ORDER_KEYS, F.col("o_custkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"),
        micros("o_orderdate").alias("ts"))
    return dense_ordinal(joined, ORDER_KEYS, "eid").select("src", "dst", "ts", "eid", F.col("eid").alias("seq"))


def event_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks about its user at its time."""
    return event_edges(spark, sf).select(F.col("eid").alias("rid"), F.col("src").alias("node"), "ts")


def end_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks about its user (rid 2*eid) and its item (rid 2*eid + 1)."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("src").alias("node")),
                             F.struct(F.lit(1).alias("i"), F.col("dst").alias("node"))))
    return (event_edges(spark, sf).select("eid", "ts", ends.alias("e"))
            .select((F.col("eid") * 2 + F.col("e.i")).alias("rid"), "e.node", "ts"))


def edge_features(spark: SparkSession, sf: str) -> DataFrame:
    """eid, feat = [value, k]."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("eid"),
        F.array(F.col("value").cast("float"), F.get_json_object("props", "$.k").cast("float")).alias("feat"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, feat (64 floats)."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("feat"))


def node_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for every user and item of the events: node mod number of vectors."""
    base = vectors(spark, sf)
    n = base.count()
    ev = event_edges(spark, sf)
    ids = ev.select(F.col("src").alias("id")).distinct().union(ev.select("dst").distinct())
    keyed = ids.withColumn("_v", F.pmod("id", F.lit(n)))
    return keyed.join(base.select(F.col("id").alias("_v"), "feat"), "_v").select("id", "feat")


def item_ptable(spark: SparkSession, sf: str) -> DataFrame:
    """Items already hashed to partitions; users are still new."""
    from ..operators.partition import partition_hash
    ev = event_edges(spark, sf)
    return partition_hash(ev.select(F.col("dst").alias("src")), PARTS)


def sql_hash(*parts: str) -> str:
    texts = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 15) AS BIGINT)"


VIEWS = {
    "ev": f"""SELECT user_id AS src, {ITEM} + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst,
        epoch_us(ts) AS ts, event_id AS eid, event_id AS seq FROM events""",
    "ev_ord": "SELECT *, row_number() OVER (ORDER BY eid) - 1 AS ord FROM ev",
    "rv": """SELECT src, dst, ts, eid, seq FROM ev UNION ALL
        SELECT dst, src, ts, eid, seq + (SELECT max(seq) - min(seq) + 1 FROM ev) FROM ev""",
    "oe": f"""SELECT o_custkey AS src, {PART} + l_partkey AS dst, epoch_us(o_orderdate) AS ts,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS eid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "roots": "SELECT eid AS rid, src AS node, ts FROM ev",
    "end_roots": "SELECT 2 * eid AS rid, src AS node, ts FROM ev UNION ALL SELECT 2 * eid + 1, dst, ts FROM ev",
    "ef": """SELECT event_id AS eid, CAST(value AS FLOAT) AS f0,
        CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS FLOAT) AS f1 FROM events""",
    "nv": """SELECT id, embedding AS feat FROM
        (SELECT DISTINCT src AS id FROM ev UNION SELECT DISTINCT dst FROM ev)
        JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)""",
    "item_pt": f"SELECT node, {sql_hash('node')} % {PARTS} AS pid FROM (SELECT DISTINCT dst AS node FROM ev)",
    # last 5 edges strictly before every event's time
    "recent5": """SELECT * FROM (SELECT rid, node, r.ts AS root_ts, e.dst AS src_node, e.eid, e.ts AS edge_ts,
        row_number() OVER (PARTITION BY rid ORDER BY e.ts DESC, e.seq DESC) - 1 AS slot
        FROM roots r JOIN ev e ON e.src = r.node AND e.ts < r.ts AND e.ts >= 0) WHERE slot < 5""",
    "batches": f"SELECT *, ord // {BATCH} AS batch_id, ord % {BATCH} AS pos FROM ev_ord",
    "pool": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT dst AS id FROM ev)",
    "src_pool": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT src AS id FROM ev)",
    "with_neg": f"""SELECT b.*, p.id AS neg FROM batches b JOIN pool p
        ON p.idx = {sql_hash(str(SEED), "'dst'", 'ord')} % (SELECT count(*) FROM pool)""",
}


def with_views(sql: str) -> str:
    """Prefix the WITH clauses of every view the text needs, in dependency order."""
    import re
    own = set(re.findall(r"(\w+)\s+AS\s*\(", sql))

    def needed(text: str, found: dict[str, None]) -> dict[str, None]:
        for view in VIEWS:
            if view not in own and re.search(rf"\b{view}\b", text) and view not in found:
                needed(VIEWS[view], found)
                found[view] = None
        return found

    clauses = [f"{v} AS ({VIEWS[v]})" for v in needed(sql, {})]
    sql = sql.strip()
    if not clauses:
        return sql
    if sql[:4].upper() == "WITH":
        return f"WITH {', '.join(clauses)}, {sql[4:].strip()}"
    return f"WITH {', '.join(clauses)} {sql}"
