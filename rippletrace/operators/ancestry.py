"""Containment: ancestors, nearest ancestors and level projection.

Only containers (nodes that are somebody's parent) are climbed, which are far fewer
than the nodes; a node then needs one join with the chain of its parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import level_admits
from ..plans.durable import materialize, stored
from ..schemas import MAX_ANCESTORS

_KEY = ["repo_id", "node"]
_DOUBLINGS_PER_JOB = 2


def parent_links(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent") != "").select("repo_id", F.col("id").alias("node"), "parent")


def _climb(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(existing containers, ancestors of containers at depth 1..limit).

    By doubling: what is up to 2k above a node is what is up to k above it, and up to k above its
    k-th ancestor, so 64 levels take six steps. Chains in a parent cycle just go round.
    """
    ids = nodes.select("repo_id", F.col("id").alias("node"))
    links = parent_links(nodes)
    containers = stored(
        links.select("repo_id", F.col("parent").alias("node")).distinct()
        .join(ids, _KEY, "left_semi"), "containers")
    up = stored(
        links.join(containers, _KEY, "left_semi")
        .join(containers.withColumnRenamed("node", "parent"), ["repo_id", "parent"], "left_semi")
        .select("repo_id", "node", "parent"), "up")
    at = ["repo_id", "node"]
    far = up.select(*at, F.col("parent").alias("ancestor"))
    table, span, found = far.withColumn("depth", F.lit(1)), 1, 1
    while found and span < limit:
        began = span
        for _ in range(_DOUBLINGS_PER_JOB):
            if span >= limit:
                break
            # all ancestors up to ``span`` of the node that is ``span`` above
            jump = far.select(*at, F.col("ancestor").alias("over"))
            further = jump.join(table.select("repo_id", F.col("node").alias("over"), "ancestor", "depth"), ["repo_id", "over"]).select(
                *at, "ancestor", (F.col("depth") + span).alias("depth"))
            table = table.unionByName(further.where(F.col("depth") <= limit))
            far = jump.join(far.select("repo_id", F.col("node").alias("over"), "ancestor"), ["repo_id", "over"]).select(*at, "ancestor")
            span *= 2
        table, found = materialize(table, "climb", F.count_if(F.col("depth") > began))
        if span < limit:
            far = table.where(F.col("depth") == span).select(*at, "ancestor")
    return containers, table


def container_chain(nodes: DataFrame, limit: int = MAX_ANCESTORS) -> DataFrame:
    """repo_id, node, ancestor, depth for every container, itself at depth 0."""
    containers, above = _climb(nodes, limit)
    own = containers.select("repo_id", "node", F.col("node").alias("ancestor"),
                            F.lit(0).alias("depth"))
    # inside a parent cycle a container is met again: the nearest meeting counts
    return stored(own.unionByName(above).groupBy("repo_id", "node", "ancestor").agg(F.min("depth").alias("depth")),
                  "chain")


def parent_cycles(nodes: DataFrame, limit: int = MAX_ANCESTORS) -> DataFrame:
    """Nodes that are their own ancestor."""
    _, above = _climb(nodes, limit)
    return above.where("node = ancestor").select("repo_id", "node").distinct()


def ancestors(nodes: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """repo_id, node, ancestor, depth for every node, itself at depth 0."""
    chain = container_chain(nodes) if chain is None else chain
    own = nodes.select("repo_id", F.col("id").alias("node"), F.col("id").alias("ancestor"),
                       F.lit(0).alias("depth"))
    above = parent_links(nodes).join(
        chain.withColumnRenamed("node", "parent"), ["repo_id", "parent"]).select(
        "repo_id", "node", "ancestor", (F.col("depth") + 1).alias("depth"))
    return own.unionByName(above.where("node <> ancestor"))


def nearest(nodes: DataFrame, targets: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Nearest ancestor, the node itself included, that is listed in ``targets``.

    targets: repo_id, node. Result: repo_id, node, ancestor, depth; a node with no such
    ancestor has no row.
    """
    chain = container_chain(nodes) if chain is None else chain
    wanted = targets.select("repo_id", F.col("node").alias("ancestor")).distinct()
    by_parent = (chain.join(wanted, ["repo_id", "ancestor"])
                 .groupBy("repo_id", F.col("node").alias("parent"))
                 .agg(F.min(F.struct("depth", "ancestor")).alias("up")))
    own = wanted.select("repo_id", F.col("ancestor").alias("node"), F.lit(True).alias("self_hit"))
    return (nodes.select("repo_id", F.col("id").alias("node"), "parent")
            .join(own, _KEY, "left")
            .join(by_parent, ["repo_id", "parent"], "left")
            .where("self_hit or up is not null")
            .select("repo_id", "node",
                    F.when(F.col("self_hit"), F.col("node")).otherwise(F.col("up.ancestor"))
                    .alias("ancestor"),
                    F.when(F.col("self_hit"), F.lit(0)).otherwise(F.col("up.depth") + 1)
                    .alias("depth")))


def ancestor_of_kind(nodes: DataFrame, kind: str, chain: DataFrame | None = None) -> DataFrame:
    """Nearest ancestor of ``kind`` (self included) per node."""
    targets = nodes.where(F.col("kind") == kind).select("repo_id", F.col("id").alias("node"))
    return nearest(nodes, targets, chain)


def project(nodes: DataFrame, picked: DataFrame, level: str,
            chain: DataFrame | None = None, labels: list[str] | None = None) -> DataFrame:
    """``picked`` (repo_id, node) at ``level``: itself when admitted, else its ancestor there.

    ``labels`` are columns of ``picked`` that stay with its nodes.
    """
    who = [*_KEY, *(labels or [])]
    admitted = nodes.where(level_admits(level, F.col("kind"))).select(
        "repo_id", F.col("id").alias("node"))
    picked = stored(picked.select(*who).distinct(), "picked")
    direct = picked.join(admitted, _KEY, "left_semi")
    rest, missing = materialize(picked.join(admitted, _KEY, "left_anti"), "lift")
    if not missing:
        return picked
    chain = container_chain(nodes) if chain is None else chain
    targets = nodes.where(F.col("kind") == level).select("repo_id", F.col("id").alias("node"))
    lifted = nearest(nodes.join(rest.withColumnRenamed("node", "id"), ["repo_id", "id"], "left_semi"),
                     targets, chain)
    raised = rest.join(lifted, _KEY).drop("node").withColumnRenamed("ancestor", "node").select(*who)
    return direct.unionByName(raised).distinct()
