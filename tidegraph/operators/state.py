"""Per-node state: memory and mailbox with last-write-wins updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import time_encode, zero_like, zeros

STATE_COLUMNS = ("node", "mem", "mem_ts", "mail", "mail_ts")


def _empty_state(nodes: DataFrame, mem_dim: int, mail_dim: int, ts_type) -> DataFrame:
    zero = F.lit(0).cast(ts_type)
    return nodes.select("node", zeros(mem_dim).alias("mem"), zero.alias("mem_ts"),
                        zeros(mail_dim).alias("mail"), zero.alias("mail_ts"))


def insert_missing_state(state: DataFrame, nodes: DataFrame, mem_dim: int, mail_dim: int) -> DataFrame:
    """Zero rows for nodes the table does not know yet; known rows stay."""
    unseen = nodes.select("node").distinct().join(state.select("node"), "node", "left_anti")
    return state.unionByName(_empty_state(unseen, mem_dim, mail_dim, state.schema["mem_ts"].dataType))


def reset_state(state: DataFrame) -> DataFrame:
    """Zero every value and time, keep the keys."""
    zero = {c: F.lit(0).cast(state.schema[c].dataType) for c in ("mem_ts", "mail_ts")}
    return state.withColumns({"mem": zero_like("mem"), "mail": zero_like("mail"), **zero})


def node_state_lookup(front: DataFrame, state: DataFrame, mem_dim: int, mail_dim: int) -> DataFrame:
    """State per frontier row; unknown nodes read as zeros at time 0."""
    zero = F.lit(0).cast(state.schema["mem_ts"].dataType)
    return front.join(state, "node", "left").withColumns({
        "mem": F.coalesce("mem", zeros(mem_dim)), "mem_ts": F.coalesce("mem_ts", zero),
        "mail": F.coalesce("mail", zeros(mail_dim)), "mail_ts": F.coalesce("mail_ts", zero)})


def _last_positions(marks: DataFrame) -> DataFrame:
    """(node, batch_id, pos) of the last row of each node: the latest batch, then the latest position.

    Only fixed-width numbers are aggregated, combined on the map side, and no vector is moved before
    its row has won."""
    batch = marks.groupBy("node").agg(F.max("batch_id").alias("batch_id"))
    return marks.join(batch, ["node", "batch_id"]).groupBy("node", "batch_id").agg(F.max("pos").alias("pos"))


def last_memory(batch: DataFrame) -> DataFrame:
    """Last memory per node over the positive rows of stacked batches.

    batch: batch_id, pos, role, node, ts, mem. Later batch wins, then later position; the
    aggregation combines on the map side, so a hot node sends one row per task.
    """
    positive = batch.filter(F.col("role").isin("src", "dst"))
    last = _last_positions(positive.select("node", "batch_id", "pos"))
    return positive.join(last, ["node", "batch_id", "pos"]).select("node", "mem", F.col("ts").alias("mem_ts"))


def last_mail(interactions: DataFrame, edge_dim: int = 0) -> DataFrame:
    """Last mail per node from interactions(batch_id, i, src, dst, ts, mem_src, mem_dst[, feat]).

    The source receives [mem_src, mem_dst, edge], the destination [mem_dst, mem_src, edge]; within
    a batch mails are ordered by interaction, source before destination.
    """
    edge = F.col("feat") if "feat" in interactions.columns else zeros(edge_dim)
    edge = F.transform(edge, lambda x: x.cast("double"))
    # where each end stands: interaction i, source before destination
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), (2 * F.col("i")).alias("pos")),
                             F.struct(F.col("dst").alias("node"), (2 * F.col("i") + 1).alias("pos"))))
    last = _last_positions(interactions.select("batch_id", ends.alias("_r")).select("_r.node", "batch_id", "_r.pos"))
    # mails are made for the winners only
    won = last.select("node", "batch_id", F.col("pos").alias("_pos"), F.floor(F.col("pos") / 2).alias("i"))
    theirs = won.join(interactions, ["batch_id", "i"])
    mail = F.when(F.col("_pos") % 2 == 0, F.concat("mem_src", "mem_dst", edge)).otherwise(F.concat("mem_dst", "mem_src", edge))
    return theirs.select("node", mail.alias("mail"), F.col("ts").alias("mail_ts"))


def _merge(state: DataFrame, fresh: DataFrame, columns: tuple[str, str], mem_dim: int, mail_dim: int) -> DataFrame:
    known = insert_missing_state(state, fresh, mem_dim, mail_dim)
    renamed = fresh.select("node", *[F.col(c).alias(f"_{c}") for c in columns])
    return (known.join(renamed, "node", "left")
            .withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*STATE_COLUMNS))


def update_memory(state: DataFrame, batch: DataFrame, mem_dim: int, mail_dim: int) -> DataFrame:
    return _merge(state, last_memory(batch), ("mem", "mem_ts"), mem_dim, mail_dim)


def update_mailbox(state: DataFrame, interactions: DataFrame, mem_dim: int, mail_dim: int) -> DataFrame:
    return _merge(state, last_mail(interactions, mail_dim - 2 * mem_dim), ("mail", "mail_ts"), mem_dim, mail_dim)


def message_input(front: DataFrame, time_dim: int, scale: float = 1.0) -> DataFrame:
    """Mail followed by the time code of (ts - mem_ts) * scale."""
    dt = (F.col("ts") - F.col("mem_ts")) * F.lit(scale)
    return front.withColumn("message", F.concat("mail", time_encode(dt, time_dim)))
