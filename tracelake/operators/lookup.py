"""Lookups, memberships, filters and groups over nodes, trees and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ACTIVE = ("running", "stalled")


def find_nodes(nodes: DataFrame, wanted: DataFrame, by: Sequence[str] = ("session_id",), key: str = "agent_key", call_id: str = "tool_use_id") -> DataFrame:
    """The node each request names by its key or, where it gives none, by the call that started it.

    ``wanted``: ``by`` and ``key`` and/or ``call_id``.  Requests that name no node are left out.
    """
    out = None
    for col in (c for c in (key, call_id) if c in wanted.columns and c in nodes.columns):
        asked = wanted.where(F.col(col).isNotNull() & (F.lit(True) if col == key or key not in wanted.columns else F.col(key).isNull()))
        hit = nodes.where(F.col(col).isNotNull()).join(asked.select(*by, col).distinct(), [*by, col], "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.dropDuplicates([*by, key]) if out is not None else nodes.limit(0)


def in_tree(tree: DataFrame, claims: DataFrame, root: str = "root", id: str = "id", by: Sequence[str] = (), as_: str = "belongs") -> DataFrame:
    """``claims`` (root, id) with whether the node hangs in the tree of that root; a node that is no root has no tree."""
    known = tree.select(*by, root, id).distinct().withColumn("__in", F.lit(True))
    out = claims.join(known, [*by, root, id], "left")
    return out.withColumn(as_, F.coalesce("__in", F.lit(False))).drop("__in")


def preorder(tree: DataFrame, path: str = "order_path") -> list[Column]:
    """The order in which a tree is listed: roots, and below each node its children in their order."""
    return [F.col(path)]


def node_filter(nodes: DataFrame, which: str = "all") -> DataFrame:
    """``running``: active agents, and mains while they run; ``failed``; or ``all``."""
    if which == "running":
        return nodes.where(F.when(F.col("is_main"), F.col("state") == "running").otherwise(F.col("state").isin(*ACTIVE)))
    return nodes.where(F.col("state") == "failed") if which == "failed" else nodes


def text_only(events: DataFrame) -> DataFrame:
    """What was said: no calls, results, thoughts or notes."""
    return events.where(F.col("kind").isin("user", "assistant"))


def running_groups(running: DataFrame, name: str = "session_name") -> DataFrame:
    """One row per session of running agents, the busiest first, then by name (``place`` within the group stays)."""
    groups = running.groupBy("session_id").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("agents"))
    return groups.orderBy(F.col("agents").desc(), F.lower(name), "session_id")


def session_groups(members: DataFrame) -> DataFrame:
    """The agents of each topic under their sessions: number of agents, of running ones, and the first place.

    Sessions of a topic come in the order of their first agent.
    """
    g = members.groupBy("topic_id", "session_id").agg(
        F.min("session_name").alias("session_name"), F.min("place").alias("first_place"), F.count(F.lit(1)).alias("agents"),
        F.count_if(F.col("state").isin(*ACTIVE)).alias("running"),
    )
    w = Window.partitionBy("topic_id").orderBy("first_place")
    return g.withColumn("place", F.row_number().over(w)).drop("first_place")
