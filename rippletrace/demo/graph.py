"""Traversal, scores, cycles and explanation over the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fleet
from ..operators import ancestry, closure, cycles, impact, links, scores
from ..operators.impact import Filters
from .sqltext import ANC, IMPACT, RELEVANCE, SEEDS, ask, policy, spec, trace

IMPORTS = Filters(edge_kinds=("imports",))
_DEP = ("depends_on", "imports", "references", "calls", "inherits", "generated_from")


def seeds(spark, sf):
    ends = fleet.query(spark, sf, "SELECT repo_id, src, dst FROM imports")
    both = ends.groupBy("repo_id").agg(F.min("src").alias("a"), F.max("dst").alias("b"))
    return both.select("repo_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))


def file_impact(spark, sf):
    return impact.blast_radius(fleet.nodes(spark, sf), fleet.edges(spark, sf), seeds(spark, sf),
                               "file", IMPORTS)


def _flat(df):
    return df.withColumn("path", F.array_join(F.flatten("paths"), ",")).drop("paths")


def traversable_edges(spark, sf):
    return impact.traversable(fleet.edges(spark, sf)).select(
        "repo_id", "id", "kind", "src", "dst", "freshness", "valid_from")


def active_edges(spark, sf):
    return impact.active(fleet.edges(spark, sf)).select("repo_id", "id")


def edges_at_generation(spark, sf):
    return impact.active_at(fleet.edges(spark, sf), 200).select("repo_id", "id")


def nearest_package(spark, sf):
    return ancestry.ancestor_of_kind(fleet.nodes(spark, sf), "package")


def ancestor_table(spark, sf):
    return ancestry.ancestors(fleet.nodes(spark, sf))


def package_seeds(spark, sf):
    return ancestry.project(fleet.nodes(spark, sf), seeds(spark, sf), "package")


def blast_radius_files(spark, sf):
    return _flat(file_impact(spark, sf)).drop("cause")


def blast_radius_packages(spark, sf):
    return _flat(impact.blast_radius(fleet.nodes(spark, sf), fleet.edges(spark, sf), seeds(spark, sf),
                                     "package", fleet.PACKAGE_FILTERS)).drop("cause")


def provider_reach_files(spark, sf):
    base = fleet.query(spark, sf, "SELECT repo_id, CAST(min(gen) + 20 AS BIGINT) AS baseline_generation "
                                  "FROM lines GROUP BY repo_id")
    e = fleet.edges(spark, sf, table="imports")
    return _flat(impact.provider_reach(e, seeds(spark, sf), base)).drop("freshness")


def impact_levels(spark, sf):
    base = fleet.query(spark, sf, "SELECT repo_id, CAST(min(gen) + 20 AS BIGINT) AS baseline_generation "
                                  "FROM lines GROUP BY repo_id")
    return _flat(impact.impact_all_levels(fleet.nodes(spark, sf), fleet.edges(spark, sf),
                                          seeds(spark, sf), base)).drop("freshness")


def specificity_files(spark, sf):
    return _round(scores.specificity(fleet.nodes(spark, sf), fleet.edges(spark, sf), "file"),
                  "specificity", "dependent_fraction")


def specificity_packages(spark, sf):
    return _round(scores.specificity(fleet.nodes(spark, sf), fleet.edges(spark, sf), "package"),
                  "specificity", "dependent_fraction")


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def relevance_files(spark, sf):
    e = fleet.edges(spark, sf)
    spec_ = scores.specificity(fleet.nodes(spark, sf), e, "file")
    return _round(scores.relevance(file_impact(spark, sf), e, spec_), "relevance").select(
        "repo_id", "node", "distance", "relevance")


def hub_alert_packages(spark, sf):
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    hits = impact.blast_radius(n, e, seeds(spark, sf), "package", fleet.PACKAGE_FILTERS)
    spec_ = scores.specificity(n, e, "package", fleet.PACKAGE_FILTERS)
    return _round(scores.hub_alerts(hits, spec_), "specificity", "reach_fraction")


def hub_tiers(spark, sf):
    spec_ = scores.specificity(fleet.nodes(spark, sf), fleet.edges(spark, sf), "package")
    return _round(scores.hub_tier(spec_), "dependent_fraction", "tier")


def transitive_reach(spark, sf):
    return _round(closure.reach(fleet.nodes(spark, sf, "month"), fleet.edges(spark, sf, "month"), "file"),
                  "fraction")


def reach_rings(spark, sf):
    return closure.reach_rings(
        closure.reach(fleet.nodes(spark, sf, "month"), fleet.edges(spark, sf, "month"), "file"))


def cycle_groups(spark, sf):
    return cycles.cycle_groups(
        impact.traversable(fleet.edges(spark, sf, "half"), IMPORTS)).withColumnRenamed("group", "grp")


def cycle_edges(spark, sf):
    e = impact.traversable(fleet.edges(spark, sf, "half"), IMPORTS)
    return cycles.cycle_edges(e, cycles.cycle_groups(e)).withColumnRenamed("group", "grp")


def _focus(spark, sf):
    return fleet.query(spark, sf, "SELECT repo_id, min(src) AS node FROM imports GROUP BY repo_id")


def focus_distance(spark, sf):
    return links.focus_distance(fleet.nodes(spark, sf), fleet.edges(spark, sf, table="imports"),
                                _focus(spark, sf))


def focus_edge_distance(spark, sf):
    e = fleet.edges(spark, sf, table="imports")
    d = links.focus_distance(fleet.nodes(spark, sf), e, _focus(spark, sf))
    return links.focus_distance_of_edges(e, d)


def focus_rings(spark, sf):
    d = links.focus_distance(fleet.nodes(spark, sf), fleet.edges(spark, sf, table="imports"),
                             _focus(spark, sf))
    return closure.focus_rings(d, links.UNREACHED)


def neighbours(spark, sf):
    return links.neighbours(fleet.edges(spark, sf), seeds(spark, sf))


def degrees(spark, sf):
    return links.degrees(fleet.nodes(spark, sf), fleet.edges(spark, sf))


def what_if(spark, sf):
    return _flat(impact.what_if(fleet.nodes(spark, sf), fleet.edges(spark, sf), _focus(spark, sf),
                                "file", 4, True)).select("repo_id", "node", "distance", "path")


def explain_paths(spark, sf):
    return impact.explain(file_impact(spark, sf), fleet.edges(spark, sf)).select(
        "repo_id", "node", "path_no", "hop", "edge_id", "edge_kind", "dst", "artifact", "line",
        "not_exact", "not_current")


_FILE_IMPACT = [SEEDS, policy("trav", ("imports",)), trace("trav"), IMPACT]
_FLAT_FILE = ("SELECT repo_id, node, distance, direct, changed, freshness, "
              "array_to_string(path, ',') AS path FROM impact")
_PKG_SEEDS = """pseeds AS MATERIALIZED (
  SELECT DISTINCT s.repo_id, a.ancestor AS node FROM seeds s
  JOIN anc a ON a.repo_id = s.repo_id AND a.node = s.node
  JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor AND n.kind = 'package')"""
_PKG_IMPACT = [ANC, SEEDS, _PKG_SEEDS, policy("trav", ("depends_on",)), trace("trav", "pseeds"), IMPACT]
_BASE = ("base AS (SELECT repo_id, min(gen) + 20 AS baseline FROM lines GROUP BY repo_id)")
_SURE = ("sure AS MATERIALIZED (SELECT * FROM imports WHERE confidence NOT IN ('heuristic','unresolved'))")
_CLOSURE = """
usable AS MATERIALIZED (SELECT DISTINCT repo_id, src, dst FROM trav),
closed AS (
  SELECT repo_id, src, dst FROM usable
  UNION
  SELECT c.repo_id, u.src, c.dst FROM closed c JOIN usable u ON u.repo_id = c.repo_id AND u.dst = c.src)"""
_REACH = """
reached AS MATERIALIZED (
  SELECT n.repo_id, n.id AS node, coalesce(c.dependents, 0) AS dependents, p.population,
         coalesce(max(c.dependents) OVER (PARTITION BY n.repo_id), 0) AS widest
  FROM nodes n JOIN (SELECT repo_id, count(*) AS population FROM nodes WHERE kind = 'file' GROUP BY repo_id) p
    ON p.repo_id = n.repo_id
  LEFT JOIN (SELECT repo_id, dst, count(*) AS dependents FROM closed WHERE src <> dst
             GROUP BY repo_id, dst) c ON c.repo_id = n.repo_id AND c.dst = n.id
  WHERE n.kind = 'file')"""
_GROUPS = """
mutual AS MATERIALIZED (
  SELECT a.repo_id, a.src AS node, least(min(a.dst), a.src) AS grp FROM closed a
  JOIN closed b ON b.repo_id = a.repo_id AND b.src = a.dst AND b.dst = a.src
  WHERE a.src <> a.dst GROUP BY a.repo_id, a.src)"""
_HOPS = """
focus AS (SELECT repo_id, min(src) AS node FROM imports GROUP BY repo_id),
both_ways AS MATERIALIZED (SELECT repo_id, src, dst FROM imports UNION SELECT repo_id, dst, src FROM imports),
walk AS (
  SELECT repo_id, node, 0 AS hops FROM focus
  UNION
  SELECT w.repo_id, e.dst, w.hops + 1 FROM walk w JOIN both_ways e
    ON e.repo_id = w.repo_id AND e.src = w.node WHERE w.hops < 60),
dist AS MATERIALIZED (
  SELECT n.repo_id, n.id AS node, coalesce(min(w.hops), 2147483647) AS hops
  FROM nodes n LEFT JOIN walk w ON w.repo_id = n.repo_id AND w.node = n.id GROUP BY n.repo_id, n.id)"""
_COMPACT = """
compacted AS (
  SELECT repo_id, node, dense_rank() OVER (PARTITION BY repo_id ORDER BY idx) - 1 AS ring FROM placed)"""

QUERIES = {f.__name__: f for f in (
    traversable_edges, active_edges, edges_at_generation, nearest_package, ancestor_table,
    package_seeds, blast_radius_files, blast_radius_packages, provider_reach_files, impact_levels,
    specificity_files, specificity_packages, relevance_files, hub_alert_packages, hub_tiers,
    transitive_reach, reach_rings, cycle_groups, cycle_edges, focus_distance, focus_edge_distance,
    focus_rings, neighbours, degrees, what_if, explain_paths)}

SQL = {
    "traversable_edges": ask("SELECT repo_id, id, kind, src, dst, freshness, valid_from FROM trav",
                             policy("trav", _DEP)),
    "active_edges": ask("SELECT repo_id, id FROM edges WHERE valid_to IS NULL"),
    "edges_at_generation": ask("SELECT repo_id, id FROM edges WHERE valid_from <= 200 "
                               "AND (valid_to IS NULL OR valid_to > 200)"),
    "nearest_package": ask("""
SELECT a.repo_id, a.node, a.ancestor, a.depth FROM anc a
JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor AND n.kind = 'package'
QUALIFY row_number() OVER (PARTITION BY a.repo_id, a.node ORDER BY a.depth) = 1""", ANC),
    "ancestor_table": ask("SELECT repo_id, node, ancestor, depth FROM anc", ANC),
    "package_seeds": ask("SELECT repo_id, node FROM pseeds", ANC, SEEDS, _PKG_SEEDS),
    "blast_radius_files": ask(_FLAT_FILE, *_FILE_IMPACT),
    "blast_radius_packages": ask(_FLAT_FILE, *_PKG_IMPACT),
    "provider_reach_files": ask("""
SELECT f.repo_id, f.node, f.distance, f.distance = 1 AS direct, f.distance = 0 AS changed,
       CASE WHEN f.newest > b.baseline THEN 'dependency_added' ELSE 'implementation' END AS cause,
       array_to_string(f.path, ',') AS path
FROM found f JOIN base b ON b.repo_id = f.repo_id""", SEEDS, _BASE, _SURE, trace("sure")),
    "impact_levels": ask("""
SELECT f.level, f.repo_id, f.node, f.distance, f.distance = 1 AS direct, f.distance = 0 AS changed,
       CASE WHEN f.newest > b.baseline THEN 'dependency_added' ELSE 'implementation' END AS cause,
       array_to_string(f.path, ',') AS path
FROM found f JOIN base b ON b.repo_id = f.repo_id""", ANC, SEEDS, _PKG_SEEDS, _BASE, """
lseeds AS (SELECT 'file' AS level, repo_id, node FROM seeds
           UNION ALL SELECT 'package', repo_id, node FROM pseeds),
ledges AS MATERIALIZED (
  SELECT CASE WHEN kind = 'imports' THEN 'file' ELSE 'package' END AS level, * FROM edges
  WHERE valid_to IS NULL AND confidence NOT IN ('heuristic', 'unresolved'))""",
                         trace("ledges", "lseeds", keys="level, repo_id")),
    "specificity_files": ask("""
SELECT repo_id, node, dependents, population, round(specificity, 6) AS specificity,
       round(dependent_fraction, 6) AS dependent_fraction FROM spec""",
                             policy("trav", ("imports", "calls", "references", "inherits")),
                             spec("spec", "file", "trav")),
    "specificity_packages": ask("""
SELECT repo_id, node, dependents, population, round(specificity, 6) AS specificity,
       round(dependent_fraction, 6) AS dependent_fraction FROM spec""",
                                policy("trav", ("depends_on",)), spec("spec", "package", "trav")),
    "relevance_files": ask("SELECT repo_id, node, distance, round(relevance, 6) AS relevance FROM rel",
                           *_FILE_IMPACT, spec("spec", "file", "trav"), RELEVANCE),
    "hub_alert_packages": ask("""
SELECT s.repo_id, s.node, s.dependents, s.population, round(s.specificity, 6) AS specificity,
       r.reach, round(r.reach / s.population, 6) AS reach_fraction
FROM pseeds p JOIN spec s ON s.repo_id = p.repo_id AND s.node = p.node AND s.specificity <= 0.35
JOIN (SELECT repo_id, count(*) FILTER (distance > 0) AS reach FROM impact GROUP BY repo_id) r
  ON r.repo_id = p.repo_id""", *_PKG_IMPACT, spec("spec", "package", "trav")),
    "hub_tiers": ask("""
SELECT repo_id, node, round(dependent_fraction, 6) AS dependent_fraction,
       round(CASE WHEN population <= 1 THEN 1.0 WHEN dependent_fraction >= 0.55 THEN 1.6180339887 * 1.6180339887
             WHEN dependent_fraction >= 0.20 THEN 1.6180339887 ELSE 1.0 END::DOUBLE, 6) AS tier FROM spec""",
                     policy("trav", ("depends_on",)), spec("spec", "package", "trav")),
    "transitive_reach": ask("""
SELECT repo_id, node, dependents, round(dependents / population, 6) AS fraction, widest, population
FROM reached""", policy("trav", ("imports",)), _CLOSURE, _REACH, grain="month"),
    "reach_rings": ask("SELECT repo_id, node, ring FROM compacted",
                       policy("trav", ("imports",)), _CLOSURE, _REACH, """
ringed AS (SELECT *, greatest(2, least(7, greatest(widest, 1) + 1, round(sqrt(population)))) AS rings FROM reached),
placed AS (SELECT repo_id, node, greatest(0, least(rings - 1,
  round((1 - sqrt(dependents / greatest(widest, 1))) * (rings - 1)))) AS idx FROM ringed)""",
                       _COMPACT, grain="month"),
    "cycle_groups": ask("SELECT repo_id, grp, node FROM mutual",
                        policy("trav", ("imports",)), _CLOSURE, _GROUPS, grain="half"),
    "cycle_edges": ask("""
SELECT t.repo_id, a.grp, t.id, t.src, t.dst FROM trav t
JOIN mutual a ON a.repo_id = t.repo_id AND a.node = t.src
JOIN mutual b ON b.repo_id = t.repo_id AND b.node = t.dst AND b.grp = a.grp""",
                       policy("trav", ("imports",)), _CLOSURE, _GROUPS, grain="half"),
    "focus_distance": ask("SELECT repo_id, node, hops FROM dist", _HOPS),
    "focus_edge_distance": ask("""
SELECT e.repo_id, e.id, greatest(a.hops, b.hops) AS hops FROM imports e
JOIN dist a ON a.repo_id = e.repo_id AND a.node = e.src
JOIN dist b ON b.repo_id = e.repo_id AND b.node = e.dst""", _HOPS),
    "focus_rings": ask("SELECT repo_id, node, ring FROM compacted", _HOPS, """
placed AS (SELECT repo_id, node, least(hops, greatest(2, least(7, 1 + coalesce(max(
  CASE WHEN hops < 2147483647 THEN hops END) OVER (PARTITION BY repo_id), 0))) - 1) AS idx FROM dist)""",
                       _COMPACT),
    "neighbours": ask("""
SELECT e.repo_id, e.src AS node, 'out' AS direction, e.id, e.kind, e.dst AS other FROM edges e
JOIN seeds s ON s.repo_id = e.repo_id AND s.node = e.src WHERE e.valid_to IS NULL
UNION ALL
SELECT e.repo_id, e.dst, 'in', e.id, e.kind, e.src FROM edges e
JOIN seeds s ON s.repo_id = e.repo_id AND s.node = e.dst WHERE e.valid_to IS NULL""", SEEDS),
    "degrees": ask("""
SELECT n.repo_id, n.id AS node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree,
       coalesce(k.c, 0) AS children,
       coalesce(i.c, 0) + coalesce(o.c, 0) + coalesce(k.c, 0) AS label_degree
FROM nodes n
LEFT JOIN (SELECT repo_id, dst, count(*) c FROM edges WHERE valid_to IS NULL GROUP BY ALL) i
  ON i.repo_id = n.repo_id AND i.dst = n.id
LEFT JOIN (SELECT repo_id, src, count(*) c FROM edges WHERE valid_to IS NULL GROUP BY ALL) o
  ON o.repo_id = n.repo_id AND o.src = n.id
LEFT JOIN (SELECT repo_id, parent, count(*) c FROM nodes GROUP BY ALL) k
  ON k.repo_id = n.repo_id AND k.parent = n.id"""),
    "what_if": ask("SELECT repo_id, node, distance, array_to_string(path, ',') AS path FROM found",
                   "focus AS (SELECT repo_id, min(src) AS node FROM imports GROUP BY repo_id)",
                   policy("trav", ("imports",), True), trace("trav", "focus", 4)),
    "explain_paths": ask("""
SELECT h.repo_id, h.node, 0 AS path_no, h.hop - 1 AS hop, h.eid AS edge_id, e.kind AS edge_kind, e.dst,
       e.src AS artifact, e.line, e.confidence <> 'exact' AS not_exact, e.freshness <> 'current' AS not_current
FROM (SELECT repo_id, node, unnest(path) AS eid, unnest(range(1, len(path) + 1)) AS hop FROM impact) h
LEFT JOIN edges e ON e.repo_id = h.repo_id AND e.id = h.eid""", *_FILE_IMPACT),
}
