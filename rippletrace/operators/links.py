"""Neighbourhoods: focus distance, boundary links, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_dependency_kind, kind_weight
from ..plans.durable import stored
from ..plans.frontier import reach_set
from .ancestry import container_chain, nearest, parent_links
from .cycles import STRUCTURAL_KINDS
from .impact import active

UNREACHED = 2147483647


def focus_distance(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Hops from the focus of each repository over edges read as undirected.

    focus: repo_id, node. Repositories without a focus have no rows; a node out of
    reach has ``UNREACHED`` hops.
    """
    flat = edges.where(~F.col("kind").isin(STRUCTURAL_KINDS)).select("repo_id", "src", "dst")
    flat = flat.join(focus.select("repo_id").distinct(), "repo_id", "left_semi")
    both = stored(flat.unionByName(flat.select(
        "repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    start = focus.join(nodes.select("repo_id", F.col("id").alias("node")), ["repo_id", "node"],
                       "left_semi")
    hops = reach_set(both, start, ["repo_id"])
    shown = nodes.join(start.select("repo_id"), "repo_id", "left_semi").select(
        "repo_id", F.col("id").alias("node"))
    return shown.join(hops, ["repo_id", "node"], "left").withColumn(
        "hops", F.coalesce("hops", F.lit(UNREACHED)))


def focus_distance_of_edges(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """An edge is as far as its farther end: repo_id, id, hops."""
    at = distances.select("repo_id", F.col("node"), F.col("hops"))
    far = F.lit(UNREACHED)
    return (edges.select("repo_id", "id", "src", "dst")
            .join(distances.select("repo_id").distinct(), "repo_id", "left_semi")
            .join(at.withColumnRenamed("node", "src").withColumnRenamed("hops", "a"),
                  ["repo_id", "src"], "left")
            .join(at.withColumnRenamed("node", "dst").withColumnRenamed("hops", "b"),
                  ["repo_id", "dst"], "left")
            .select("repo_id", "id",
                    F.greatest(F.coalesce("a", far), F.coalesce("b", far)).alias("hops")))


def boundary_links(nodes: DataFrame, edges: DataFrame, focus: DataFrame, visible: DataFrame,
                   chain: DataFrame | None = None) -> DataFrame:
    """Dependencies that cross the edge of the focus's subtree, one row per far end.

    Result: repo_id, far, outgoing, kind, edge_id.
    """
    chain = container_chain(nodes) if chain is None else chain
    held = chain.join(focus.select("repo_id", F.col("node").alias("ancestor")), ["repo_id", "ancestor"],
                      "left_semi").select("repo_id", F.col("node").alias("parent"))
    below = parent_links(nodes).join(held, ["repo_id", "parent"], "left_semi")
    inside = stored(focus.select("repo_id", "node").unionByName(below.select("repo_id", "node")).distinct(),
                    "inside")
    mark = F.lit(True)
    live = active(edges).where(is_dependency_kind(F.col("kind")))
    crossing = (live.select("repo_id", "id", "kind", "src", "dst")
                .join(inside.select("repo_id", F.col("node").alias("src"), mark.alias("src_in")),
                      ["repo_id", "src"], "left")
                .join(inside.select("repo_id", F.col("node").alias("dst"), mark.alias("dst_in")),
                      ["repo_id", "dst"], "left")
                .where("(src_in is null) <> (dst_in is null)")
                .select("repo_id", "id", "kind", F.col("src_in").isNotNull().alias("outgoing"),
                        F.when(F.col("src_in"), F.col("dst")).otherwise(F.col("src")).alias("node")))
    lifted = nearest(nodes, visible, chain).select("repo_id", "node", F.col("ancestor").alias("far"))
    return (crossing.join(lifted, ["repo_id", "node"])
            .join(inside.withColumnRenamed("node", "far"), ["repo_id", "far"], "left_anti")
            .groupBy("repo_id", "far", "outgoing")
            .agg(F.min(F.struct((-kind_weight(F.col("kind"))).alias("w"), "id", "kind")).alias("best"))
            .select("repo_id", "far", "outgoing", "best.kind", F.col("best.id").alias("edge_id")))


def neighbours(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Active edges of the given nodes, by direction: repo_id, node, direction, id, kind, other."""
    live = active(edges)
    out = live.join(node.select("repo_id", F.col("node").alias("src")), ["repo_id", "src"],
                    "left_semi").select("repo_id", F.col("src").alias("node"),
                                        F.lit("out").alias("direction"), "id", "kind",
                                        F.col("dst").alias("other"))
    into = live.join(node.select("repo_id", F.col("node").alias("dst")), ["repo_id", "dst"],
                     "left_semi").select("repo_id", F.col("dst").alias("node"),
                                         F.lit("in").alias("direction"), "id", "kind",
                                         F.col("src").alias("other"))
    return out.unionByName(into)


def degrees(nodes: DataFrame, edges: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Active in and out edges per node; ``label_degree`` adds the visible children."""
    live = active(edges)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    children = nodes if visible is None else nodes.join(
        visible.select("repo_id", F.col("node").alias("id")), ["repo_id", "id"], "left_semi")

    def tally(df, column, role):
        return df.select("repo_id", F.col(column).alias("node"),
                         *[(one if role == r else zero).alias(r)
                           for r in ("in_degree", "out_degree", "children")])

    counts = (tally(live, "src", "out_degree").unionByName(tally(live, "dst", "in_degree"))
              .unionByName(tally(children.where("parent <> ''"), "parent", "children"))
              .groupBy("repo_id", "node")
              .agg(*[F.sum(c).alias(c) for c in ("in_degree", "out_degree", "children")]))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree", "children")]
    return (nodes.select("repo_id", F.col("id").alias("node"))
            .join(counts, ["repo_id", "node"], "left").select("repo_id", "node", *filled)
            .withColumn("label_degree", F.expr("in_degree + out_degree + children")))
