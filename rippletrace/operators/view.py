"""Which nodes and edges a view shows, and how edges fold onto what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import comma_list, valid_patterns
from .ancestry import ancestors, container_chain, nearest
from .impact import active

_KEY = ["repo_id", "id"]


def hidden_nodes(nodes: DataFrame, patterns: list[str], chain: DataFrame | None = None) -> DataFrame:
    """Nodes whose own or any ancestor's name or path matches a pattern, ignoring case."""
    patterns = valid_patterns(nodes.sparkSession, patterns)
    match = F.lit(False)
    for pattern in patterns:
        regex = F.lit(f"(?i){pattern}")
        match = match | F.coalesce(F.rlike("name", regex), F.lit(False)) | F.coalesce(
            F.rlike("path", regex), F.lit(False))
    hit = nodes.where(match).select("repo_id", F.col("id").alias("node"))
    if not patterns:
        return hit
    return nearest(nodes, hit, chain).select("repo_id", "node")


def hide_by_pattern(nodes: DataFrame, patterns: list[str], chain: DataFrame | None = None) -> DataFrame:
    gone = hidden_nodes(nodes, patterns, chain).withColumnRenamed("node", "id")
    return nodes.join(gone, _KEY, "left_anti")


def text_filter(nodes: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of name or path."""
    needle = F.lit(text.lower())
    return nodes.where(F.lower("name").contains(needle) | F.lower("path").contains(needle))


def view_nodes(nodes: DataFrame, mode: str, show_external: bool = False) -> DataFrame:
    """Nodes of the ``architecture``, ``filesystem`` or ``file_graph`` view."""
    if mode == "filesystem":
        return nodes.where(F.col("kind").isin("repository", "directory", "file", "package"))
    if mode == "file_graph":
        return nodes.where("kind = 'file'")
    units = ["repository", "package", "build_target"] + (["external_package"] if show_external else [])
    owners = nodes.where(F.col("kind").isin("package", "build_target")).select(
        "repo_id", F.col("id").alias("parent"))
    own_modules = (nodes.where(F.col("kind") == "package")
                   .select("repo_id", F.col("id").alias("parent"),
                           F.explode(comma_list(F.col("attrs")["module_nodes"])).alias("id")))
    files = (nodes.where("kind = 'file'").join(owners, ["repo_id", "parent"], "left_semi")
             .join(own_modules, ["repo_id", "parent", "id"], "left_anti"))
    return nodes.where(F.col("kind").isin(units)).unionByName(files.select(*nodes.columns))


def exempt_nodes(nodes: DataFrame, changed: DataFrame, seeds: DataFrame,
                 chain: DataFrame | None = None) -> DataFrame:
    """Changed files, the ancestors that are nearest of their kind, and impact seeds."""
    chain = container_chain(nodes) if chain is None else chain
    files = changed.select("repo_id", "node").distinct()
    kinds = nodes.select("repo_id", F.col("id").alias("ancestor"), "kind")
    touched = nodes.join(files.withColumnRenamed("node", "id"), _KEY, "left_semi")
    above = (ancestors(touched, chain)
             .join(kinds, ["repo_id", "ancestor"])
             .groupBy("repo_id", "node", "kind").agg(F.min_by("ancestor", "depth").alias("ancestor"))
             .select("repo_id", F.col("ancestor").alias("node")))
    return files.unionByName(above).unionByName(seeds.select("repo_id", "node")).distinct()


def relevance_filter(nodes: DataFrame, scores: DataFrame, minimum: float,
                     exempt: DataFrame) -> DataFrame:
    """Drop nodes scored below ``minimum`` unless exempt; unscored nodes count as 1."""
    low = (scores.where((F.col("population") > 1) & (F.col("specificity") < minimum))
           .join(exempt, ["repo_id", "node"], "left_anti")
           .select("repo_id", F.col("node").alias("id")))
    return nodes.join(low, _KEY, "left_anti")


def hidden_count(scores: DataFrame, minimum: float, exempt: DataFrame) -> DataFrame:
    """How many nodes of the scored population the relevance filter hides, per repository."""
    low = (scores.where((F.col("population") > 1) & (F.col("specificity") < minimum))
           .join(exempt, ["repo_id", "node"], "left_anti").groupBy("repo_id")
           .agg(F.count(F.lit(1)).alias("hidden")))
    return scores.select("repo_id").distinct().join(low, "repo_id", "left").select(
        "repo_id", F.coalesce("hidden", F.lit(0)).alias("hidden"))


def only_affected(nodes: DataFrame, impact: DataFrame, minimum: float, depth: int,
                  exempt: DataFrame) -> DataFrame:
    """Keep exempt nodes and those impacted within ``depth`` with enough relevance."""
    hit = impact.where((F.col("distance") <= depth)
                       & ((F.col("distance") == 0) | (F.col("relevance") >= minimum)))
    keep = hit.select("repo_id", "node").unionByName(exempt.select("repo_id", "node"))
    return nodes.join(keep.withColumnRenamed("node", "id"), _KEY, "left_semi")


def stale_filter(rows: DataFrame, show_stale: bool) -> DataFrame:
    """Nodes or edges with or without the stale ones."""
    return rows if show_stale else rows.where("freshness <> 'stale'")


def representative(nodes: DataFrame, visible: DataFrame, hidden: DataFrame | None = None,
                   chain: DataFrame | None = None) -> DataFrame:
    """Nearest visible ancestor, self included; none if a hidden node comes first.

    visible, hidden: repo_id, node. Result: repo_id, node, representative.
    """
    stops = visible.select("repo_id", "node")
    if hidden is not None:
        stops = stops.unionByName(hidden.select("repo_id", "node"))
    found = nearest(nodes, stops, chain).select(
        "repo_id", "node", F.col("ancestor").alias("representative"))
    if hidden is not None:
        blocked = hidden.select("repo_id", F.col("node").alias("representative")).join(
            visible.select("repo_id", F.col("node").alias("representative")),
            ["repo_id", "representative"], "left_anti")
        found = found.join(blocked, ["repo_id", "representative"], "left_anti")
    return found.select("repo_id", "node", "representative")


def _shown(edges: DataFrame, show_heuristic: bool, show_stale: bool) -> DataFrame:
    kept = active(edges)
    if not show_heuristic:
        kept = kept.where(~F.col("confidence").isin("heuristic", "unresolved"))
    return stale_filter(kept, show_stale)


def collapse_edges(nodes: DataFrame, edges: DataFrame, reps: DataFrame,
                   show_heuristic: bool = True, show_stale: bool = True) -> DataFrame:
    """Imports folded onto representatives: repo_id, src, dst, weight, edge_id."""
    roots = nodes.where("kind = 'repository'").select("repo_id", F.col("id").alias("rep"))
    usable = reps.select("repo_id", "node", F.col("representative").alias("rep")).join(
        roots, ["repo_id", "rep"], "left_anti")
    return (_shown(edges, show_heuristic, show_stale).where("kind = 'imports'")
            .select("repo_id", "id", "src", "dst")
            .join(usable.select("repo_id", F.col("node").alias("src"), F.col("rep").alias("src_rep")),
                  ["repo_id", "src"])
            .join(usable.select("repo_id", F.col("node").alias("dst"), F.col("rep").alias("dst_rep")),
                  ["repo_id", "dst"])
            .where("src_rep <> dst_rep")
            .groupBy("repo_id", F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"))
            .agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("edge_id")))


def view_edges(edges: DataFrame, visible: DataFrame, mode: str,
               show_heuristic: bool = True, show_stale: bool = True) -> DataFrame:
    """Edges a non-folding view draws: both ends visible, imports in the file graph only."""
    kept = _shown(edges, show_heuristic, show_stale)
    kept = kept.where("kind = 'imports'") if mode == "file_graph" else kept.where("false")
    return (kept.join(visible.select("repo_id", F.col("node").alias("src")), ["repo_id", "src"],
                      "left_semi")
            .join(visible.select("repo_id", F.col("node").alias("dst")), ["repo_id", "dst"],
                  "left_semi").select(*edges.columns))


def containment_edges(nodes: DataFrame, visible: DataFrame, hidden: DataFrame | None = None,
                      chain: DataFrame | None = None) -> DataFrame:
    """Synthetic ``contains`` edge from the nearest visible ancestor of each visible node."""
    reps = representative(nodes, visible, hidden, chain)
    children = nodes.where("parent <> ''").select("repo_id", "id", "parent").join(
        visible.select("repo_id", F.col("node").alias("id")), _KEY, "left_semi")
    return (children.join(reps.select("repo_id", F.col("node").alias("parent"),
                                      F.col("representative").alias("src")), ["repo_id", "parent"])
            .select("repo_id", F.concat(F.lit("tree:"), "id").alias("id"),
                    F.lit("contains").alias("kind"), "src", F.col("id").alias("dst")))
