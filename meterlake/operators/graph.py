"""Message graphs: the nearest ancestor of a role, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.session import discard, written

#: A walk of at most 2**ROUNDS steps: how far the accounting looks for an ancestor, a limit of its definition.
ROUNDS = 12


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (session, node): the parent and role of its latest registration that has one."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    return nodes.groupBy("session", "node").agg(latest("parent"), latest("role"), F.min("ordinal").alias("ordinal"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (session, node): its first registration."""
    w = Window.partitionBy(F.xxhash64("session", "node"), "session", "node").orderBy("ordinal")
    return nodes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def nearest(nodes: DataFrame, roles: tuple[str, ...], from_parent: bool = False) -> DataFrame:
    """session, node, ancestor: the closest node of one of the roles on the way up, the node itself included.

    Each round doubles how far every pointer reaches, so a chain of n messages takes log2 n joins, each on (session,
    node). Pointers that have arrived or left the graph drop out of the joins; cycles end after the last round, so
    walks of more than 2**ROUNDS steps have no ancestor. known_at: the largest ordinal (column of nodes, 0 without it) on
    the way, the ancestor's included: who reads a log from its start knows the ancestor from there on.
    """
    role = F.coalesce(F.lower("role").isin(*roles), F.lit(False))
    ordinal = F.col("ordinal") if "ordinal" in nodes.columns else F.lit(0).cast("long")
    known = nodes.select("session", "node", "parent", role.alias("hit"), ordinal.alias("known_at"))
    # at: where the pointer is; done: it is at a node of the role, or nowhere.
    start = known.select("session", "node", F.when(F.col("hit"), F.col("node")).otherwise(F.col("parent")).alias("at"), F.col("hit").alias("done"), "known_at")
    state = written(start.withColumn("done", F.col("done") | F.col("at").isNull()), "walk")
    for _ in range(ROUNDS):
        if state.where(~F.col("done")).isEmpty():
            break
        moving = state.where(~F.col("done"))
        step = state.select("session", F.col("node").alias("at"), F.col("at").alias("next"), F.col("done").alias("arrived"), F.col("known_at").alias("later"))
        moved = moving.join(step, ["session", "at"], "left").select(
            "session", "node", F.col("next").alias("at"), (F.coalesce("arrived", F.lit(True)) | F.col("next").isNull()).alias("done"), F.greatest("known_at", "later").alias("known_at")
        )
        after = written(state.where("done").union(moved), "walk")
        discard(state)
        state = after
    out = state.select("session", "node", F.when(F.col("done"), F.col("at")).alias("ancestor"), "known_at")
    if not from_parent:
        return out
    up = out.withColumnsRenamed({"node": "parent"})
    return nodes.select("session", "node", "parent").join(up, ["session", "parent"], "left").select("session", "node", "ancestor", "known_at")
