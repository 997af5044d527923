"""What a change can break: policy, blast radius, explanation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_dependency_kind, level_admits, worse_freshness
from ..plans.blocks import sequence_number
from ..plans.durable import stored
from ..plans.frontier import asked, spread_bits, trace_back
from ..schemas import DEPENDENCY_KINDS, MAX_DEPTH
from .ancestry import container_chain, nearest, project
from .diff import graph_delta


@dataclass(frozen=True)
class Filters:
    """Which edges a question may use."""

    max_depth: int = MAX_DEPTH
    edge_kinds: tuple[str, ...] = field(default_factory=lambda: tuple(DEPENDENCY_KINDS))
    include_heuristic: bool = False


def is_active(valid_to: Column) -> Column:
    return valid_to.isNull()


def active(edges: DataFrame) -> DataFrame:
    return edges.where(is_active(F.col("valid_to")))


def active_at(edges: DataFrame, generation: int) -> DataFrame:
    """Edges valid at a generation: ``valid_from <= g < valid_to``."""
    return edges.where((F.col("valid_from") <= generation)
                       & (F.col("valid_to").isNull() | (F.col("valid_to") > generation)))


def traversable(edges: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Edges a question may follow. Stale evidence stays; invalid evidence does not."""
    keep = (is_active(F.col("valid_to")) & is_dependency_kind(F.col("kind"))
            & F.col("kind").isin(list(filters.edge_kinds)) & (F.col("freshness") != "invalid"))
    if not filters.include_heuristic:
        keep = keep & ~F.col("confidence").isin("heuristic", "unresolved")
    return edges.where(keep)


def admitted_ids(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.where(level_admits(level, F.col("kind"))).select("repo_id", "id")


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, level: str,
                 filters: Filters = Filters(), chain: DataFrame | None = None) -> DataFrame:
    """Every node that can feel a change of ``seeds`` (repo_id, node), seeds included.

    Result: repo_id, node, distance, direct, changed, freshness, cause, paths.
    """
    start = project(nodes, seeds, level, chain)
    usable = traversable(edges, filters).select(
        "repo_id", "id", "src", "dst", (F.col("freshness") == "stale").alias("stale"), "valid_from")
    hits = trace_back(usable, start, filters.max_depth, admitted_ids(nodes, level).withColumnRenamed("id", "node"))
    own = asked(nodes.select("repo_id", F.col("id").alias("node"), "freshness"), hits, ["repo_id", "node"])
    return hits.join(own, ["repo_id", "node"], "left").select(
        "repo_id", "node", "distance",
        (F.col("distance") == 1).alias("direct"), (F.col("distance") == 0).alias("changed"),
        F.when(F.col("stale"), F.lit("stale"))
        .otherwise(F.coalesce("freshness", F.lit("current"))).alias("freshness"),
        F.lit("implementation").alias("cause"),
        F.when(F.size("path") > 0, F.array("path"))
        .otherwise(F.array().cast("array<array<string>>")).alias("paths"))


def seed_overlap(nodes: DataFrame, edges: DataFrame, groups: DataFrame, level: str,
                 filters: Filters = Filters(), chain: DataFrame | None = None) -> DataFrame:
    """Which of several changes can be felt at a node: repo_id, node, grps ARRAY, hits, distance.

    groups: repo_id, grp, node, the seeds of each change, any number of them. All changes share the
    rounds of one search, in which a change is a bit; ``distance`` is that of the nearest. Where
    ``hits`` is above 1 they meet.
    """
    numbered = stored(sequence_number(groups.select("repo_id", "grp").distinct(), ["repo_id"], ["grp"], "idx").select(
        "repo_id", "grp", F.expr("idx div 64").alias("word"), F.expr("shiftleft(1L, cast(idx % 64 as int))").alias("bits")), "groups")
    start = project(nodes, groups, level, chain, ["grp"]).join(numbered, ["repo_id", "grp"])
    dependents = admitted_ids(nodes, level).withColumnRenamed("id", "src")
    usable = traversable(edges, filters).join(dependents, ["repo_id", "src"], "left_semi")
    back = stored(usable.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "back")
    found = spread_bits(back, start.select("repo_id", "node", "word", "bits"), ["repo_id"], filters.max_depth)
    named = (found.join(numbered.withColumnRenamed("bits", "bit"), ["repo_id", "word"])
             .where(F.col("bits").bitwiseAND(F.col("bit")) != 0))
    return named.groupBy("repo_id", "node").agg(
        F.array_sort(F.collect_list("grp")).alias("grps"), F.count(F.lit(1)).cast("int").alias("hits"),
        F.min("hops").alias("distance"))


def affected_between(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], level: str,
                     filters: Filters = Filters()) -> DataFrame:
    """What the step from one revision (nodes, edges) to another can be felt by.

    Result: repo_id, node, distance, present (in the later revision). Nodes that came, changed
    or got or lost a dependency are the seeds in the later graph; what is gone is looked up
    in the earlier one, because only there its dependents still point to it.
    """
    (was_nodes, was_edges), (now_nodes, now_edges) = before, after
    moved = graph_delta(was_nodes, now_nodes)
    ends = was_edges.select("repo_id", "id", "src").unionByName(now_edges.select("repo_id", "id", "src")).distinct()
    rewired = graph_delta(was_edges, now_edges).join(ends, ["repo_id", "id"]).select("repo_id", F.col("src").alias("node"))
    seeds = stored(moved.select("repo_id", F.col("id").alias("node")).unionByName(rewired).distinct(), "moved")
    here = now_nodes.select("repo_id", F.col("id").alias("node"))
    later = blast_radius(now_nodes, now_edges, seeds.join(here, ["repo_id", "node"], "left_semi"), level, filters)
    gone = moved.where("change = 'removed'").select("repo_id", F.col("id").alias("node"))
    earlier = blast_radius(was_nodes, was_edges, gone, level, filters)
    both = later.select("repo_id", "node", "distance").unionByName(earlier.select("repo_id", "node", "distance"))
    felt = both.groupBy("repo_id", "node").agg(F.min("distance").alias("distance"))
    return felt.join(here.withColumn("present", F.lit(True)), ["repo_id", "node"], "left").select(
        "repo_id", "node", "distance", F.coalesce("present", F.lit(False)).alias("present"))


def provider_reach(edges: DataFrame, seeds: DataFrame, baseline: DataFrame,
                   max_depth: int = MAX_DEPTH) -> DataFrame:
    """Reverse reach without node policy; an edge newer than the baseline names the cause.

    baseline: repo_id, baseline_generation. Result as ``blast_radius``.
    """
    sure = edges.where(~F.col("confidence").isin("heuristic", "unresolved")).select(
        "repo_id", "id", "src", "dst", F.lit(False).alias("stale"), "valid_from")
    hits = trace_back(sure, seeds, max_depth).join(baseline, "repo_id", "left")
    added = F.col("newest") > F.coalesce("baseline_generation", F.lit(0))
    return hits.select(
        "repo_id", "node", "distance",
        (F.col("distance") == 1).alias("direct"), (F.col("distance") == 0).alias("changed"),
        F.lit("current").alias("freshness"),
        F.when(added, F.lit("dependency_added")).otherwise(F.lit("implementation")).alias("cause"),
        F.when(F.size("path") > 0, F.array("path"))
        .otherwise(F.array().cast("array<array<string>>")).alias("paths"))


def impact_all_levels(nodes: DataFrame, edges: DataFrame, changed: DataFrame,
                      baseline: DataFrame, chain: DataFrame | None = None,
                      max_depth: int = MAX_DEPTH) -> DataFrame:
    """Impact of changed files at file, symbol, package and build-target level.

    The four searches are independent, so they share their rounds: the level is part of
    the key the traversal runs on. A level without seeds has no rows.
    """
    files = changed.select("repo_id", "node")
    symbols = (nodes.where("kind = 'symbol'")
               .select("repo_id", F.col("id").alias("node"), F.col("parent"))
               .join(files.withColumnRenamed("node", "parent"), ["repo_id", "parent"], "left_semi"))
    seeds = {
        "file": files,
        "symbol": symbols.select("repo_id", "node"),
        "package": project(nodes, files, "package", chain),
        "build_target": project(nodes, files, "build_target", chain),
    }
    code_level = F.when(F.col("kind") == "imports", F.lit("file")).otherwise(F.lit("symbol"))
    live = active(edges)
    ends = nodes.select("repo_id", F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    unit = live.where("kind = 'depends_on'").join(ends, ["repo_id", "src"], "left")
    unit_level = F.when(F.col("src_kind") == "build_target", F.lit("build_target")).otherwise(
        F.lit("package"))
    cols = ["repo_id", "id", "src", "dst", "confidence", "valid_from"]
    labelled = (live.where(F.col("kind").isin("imports", "references", "calls"))
                .select(code_level.alias("level"), *cols)
                .unionByName(unit.select(unit_level.alias("level"), *cols)))
    keyed = labelled.withColumn("repo_id", F.struct("repo_id", "level"))
    start = None
    for level, rows in seeds.items():
        rows = rows.select(F.struct("repo_id", F.lit(level).alias("level")).alias("repo_id"), "node")
        start = rows if start is None else start.unionByName(rows)
    hits = trace_back(
        keyed.where(~F.col("confidence").isin("heuristic", "unresolved"))
        .withColumn("stale", F.lit(False)), start, max_depth)
    flat = hits.select(F.col("repo_id.level").alias("level"), F.col("repo_id.repo_id").alias("repo_id"),
                       "node", "distance", "path", "newest")
    added = F.col("newest") > F.coalesce("baseline_generation", F.lit(0))
    return flat.join(baseline, "repo_id", "left").select(
        "level", "repo_id", "node", "distance", (F.col("distance") == 1).alias("direct"),
        (F.col("distance") == 0).alias("changed"), F.lit("current").alias("freshness"),
        F.when(added, F.lit("dependency_added")).otherwise(F.lit("implementation")).alias("cause"),
        F.when(F.size("path") > 0, F.array("path"))
        .otherwise(F.array().cast("array<array<string>>")).alias("paths"))


def what_if(nodes: DataFrame, edges: DataFrame, node: DataFrame, level: str,
            depth: int = MAX_DEPTH, include_heuristic: bool = False,
            chain: DataFrame | None = None) -> DataFrame:
    """Blast radius of one hypothetical change per repository."""
    return blast_radius(nodes, edges, node, level,
                        Filters(depth, ("depends_on", "imports"), include_heuristic), chain)


def explain(impact: DataFrame, edges: DataFrame, path_index: int | None = None) -> DataFrame:
    """Paths as hops. ``path_index`` picks one path per node, wrapped modulo their count."""
    if path_index is None:
        listed = impact.select("repo_id", "node", F.posexplode("paths").alias("path_no", "path"))
    else:
        at = F.pmod(F.lit(path_index), F.size("paths"))
        listed = impact.where(F.size("paths") > 0).select(
            "repo_id", "node", at.alias("path_no"), F.get("paths", at).alias("path"))
    hops = listed.select("repo_id", "node", "path_no", F.posexplode("path").alias("hop", "edge_id"))
    known = edges.select("repo_id", F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"),
                         "src", "dst", "confidence", "freshness", "evidence")
    return hops.join(known, ["repo_id", "edge_id"], "left").select(
        "repo_id", "node", "path_no", "hop", "edge_id", "edge_kind", "src", "dst",
        F.col("evidence.artifact").alias("artifact"), F.col("evidence.line").alias("line"),
        F.col("evidence.snippet").alias("snippet"),
        (F.col("confidence") != "exact").alias("not_exact"),
        (F.col("freshness") != "current").alias("not_current"))


def changed_nodes(nodes: DataFrame, changed: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Nodes that count as changed when the files in ``changed`` (repo_id, node) did."""
    chain = container_chain(nodes) if chain is None else chain
    files = changed.select("repo_id", "node").distinct()
    touched = nodes.join(files.withColumnRenamed("node", "id"), ["repo_id", "id"], "left_semi")
    out = touched.select("repo_id", F.col("id").alias("node"))
    for kind in ("package", "directory"):
        targets = nodes.where(F.col("kind") == kind).select("repo_id", F.col("id").alias("node"))
        out = out.unionByName(nearest(touched, targets, chain).select(
            "repo_id", F.col("ancestor").alias("node")))
    symbols = (nodes.where("kind = 'symbol'").select("repo_id", F.col("id").alias("sym"),
                                                     F.col("parent").alias("node"))
               .join(files, ["repo_id", "node"], "left_semi")
               .select("repo_id", F.col("sym").alias("node")))
    return out.unionByName(symbols).distinct()


def impact_for_view(impacts: DataFrame, nodes: DataFrame, level: str,
                    architecture: bool) -> DataFrame:
    """One impact row per node: the chosen level first, then package, then file results.

    impacts: level, repo_id, node, ... Fallback rows need a node the other level admits.
    """
    order = [level] + ([lv for lv in ("package", "file") if lv != level] if architecture else [])
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("level"))
    kinds = nodes.select("repo_id", F.col("id").alias("node"), F.col("kind").alias("_kind"))
    admitted = F.lit(False)
    for other in order[1:]:
        admitted = admitted | ((F.col("level") == other) & level_admits(other, F.col("_kind")))
    rest = [c for c in impacts.columns if c not in ("repo_id", "node")]
    kept = impacts.where(F.col("level").isin(order)).join(kinds, ["repo_id", "node"], "left").where(
        (F.col("level") == level) | F.coalesce(admitted, F.lit(False)))
    return (kept.groupBy("repo_id", "node")
            .agg(F.min_by(F.struct(*rest), rank).alias("pick"))
            .select("repo_id", "node", "pick.*"))


def impact_state(nodes: DataFrame, impact: DataFrame, changed: DataFrame,
                 min_relevance: float, max_depth: int) -> DataFrame:
    """Per node: is it changed, impacted, muted, and how fresh is what we know of it.

    impact: repo_id, node, distance, freshness, relevance. changed: repo_id, node.
    """
    hit = impact.where(F.col("distance") <= max_depth).select(
        "repo_id", F.col("node").alias("id"), "distance", "relevance",
        F.col("freshness").alias("path_freshness"))
    marks = changed.select("repo_id", F.col("node").alias("id"), F.lit(True).alias("is_changed"))
    joined = (nodes.select("repo_id", "id", "kind", "freshness")
              .join(hit, ["repo_id", "id"], "left").join(marks, ["repo_id", "id"], "left"))
    is_changed = F.coalesce("is_changed", F.lit(False))
    muted = (F.col("distance").isNotNull() & ~is_changed & (F.col("distance") > 0)
             & (F.col("relevance") < min_relevance))
    return joined.select(
        "repo_id", F.col("id").alias("node"), "kind", "distance", "relevance",
        is_changed.alias("changed"), F.col("distance").isNotNull().alias("impacted"),
        muted.alias("muted"),
        F.when(F.col("path_freshness").isNull(), F.col("freshness"))
        .otherwise(worse_freshness(F.col("freshness"), F.col("path_freshness")))
        .alias("effective_freshness"))


def view_stats(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts shown beside a view, per repository. ``edges`` are the edges of the view."""
    node_side = state.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("changed").alias("changed"),
        F.count_if(F.col("impacted") & (F.col("distance") > 0) & ~F.col("muted")).alias("impacted"),
        F.count_if("muted").alias("muted"),
        F.count_if(F.col("effective_freshness") != "current").alias("stale_nodes"))
    edge_side = edges.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("freshness") != "current").alias("stale_edges"))
    return node_side.join(edge_side, "repo_id", "full_outer").select(
        "repo_id", *[F.coalesce(c, F.lit(0)).alias(c)
                     for c in ("nodes", "edges", "changed", "impacted", "muted")],
        (F.coalesce("stale_nodes", F.lit(0)) + F.coalesce("stale_edges", F.lit(0))).alias("stale"))
