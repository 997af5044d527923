"""Views, filters and integrity checks over the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fleet
from ..operators import impact, integrity, links, ownership, scores, view
from ..operators.impact import Filters
from . import history
from .graph import IMPORTS, _round, file_impact, seeds
from .sqltext import ANC, IMPACT, RELEVANCE, SEEDS, ask, policy, spec, trace

_PATTERNS = ["/n1[0-4](/|$)", "ring$", "("]
_MIN, _DEPTH = 0.9, 6


def _nodes_with_modules(spark, sf):
    """Fleet nodes; a package's own module is the first of its files, which sit on it directly."""
    n = fleet.nodes(spark, sf)
    own = fleet.query(spark, sf, "SELECT repo_id, owner AS id, min(node) AS mod FROM owners GROUP BY repo_id, owner")
    own = own.withColumn("attrs", F.create_map(F.lit("module_nodes"), "mod")).drop("mod")
    flat = fleet.query(spark, sf, "SELECT repo_id, node AS id, owner FROM owners")
    return (n.drop("attrs").join(own, ["repo_id", "id"], "left").join(flat, ["repo_id", "id"], "left")
            .withColumn("parent", F.coalesce("owner", "parent"))
            .select("repo_id", "id", "kind", "name", "path", "parent", "language", "freshness", "attrs"))


def _visible(spark, sf):
    return fleet.nodes(spark, sf).where("kind in ('repository', 'workspace', 'directory')").select(
        "repo_id", F.col("id").alias("node"))


def _scored(spark, sf):
    return scores.specificity(fleet.nodes(spark, sf), fleet.edges(spark, sf), "file")


def hide_by_pattern(spark, sf):
    return view.hide_by_pattern(fleet.nodes(spark, sf), _PATTERNS).select("repo_id", "id")


def text_filter(spark, sf):
    return view.text_filter(fleet.nodes(spark, sf), "WIDGET").select("repo_id", "id")


def architecture_nodes(spark, sf):
    return view.view_nodes(_nodes_with_modules(spark, sf), "architecture").select("repo_id", "id", "kind")


def filesystem_nodes(spark, sf):
    return view.view_nodes(fleet.nodes(spark, sf), "filesystem").select("repo_id", "id")


def _exempt(spark, sf, n):
    s = seeds(spark, sf)
    return view.exempt_nodes(n, s, s)


def relevance_filter(spark, sf):
    n = fleet.nodes(spark, sf)
    return view.relevance_filter(n, _scored(spark, sf), _MIN, _exempt(spark, sf, n)).select("repo_id", "id")


def hidden_count(spark, sf):
    n = fleet.nodes(spark, sf)
    return view.hidden_count(_scored(spark, sf), _MIN, _exempt(spark, sf, n))


def only_affected(spark, sf):
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    hits = scores.relevance(file_impact(spark, sf), e, _scored(spark, sf))
    return view.only_affected(n, hits, _MIN, _DEPTH, _exempt(spark, sf, n)).select("repo_id", "id")


def stale_filter(spark, sf):
    return view.stale_filter(fleet.nodes(spark, sf), False).select("repo_id", "id")


def representatives(spark, sf):
    n = fleet.nodes(spark, sf)
    return view.representative(n, _visible(spark, sf), view.hidden_nodes(n, ["/n1$"]))


def collapsed_edges(spark, sf):
    n = fleet.nodes(spark, sf)
    reps = view.representative(n, _visible(spark, sf))
    return view.collapse_edges(n, fleet.edges(spark, sf), reps, show_heuristic=False, show_stale=False)


def file_graph_edges(spark, sf):
    shown = view.stale_filter(fleet.nodes(spark, sf), False).select("repo_id", F.col("id").alias("node"))
    return view.view_edges(fleet.edges(spark, sf), shown, "file_graph", False, True).select("repo_id", "id")


def containment_edges(spark, sf):
    shown = fleet.nodes(spark, sf).where("kind in ('repository', 'package', 'file')").select(
        "repo_id", F.col("id").alias("node"))
    return view.containment_edges(fleet.nodes(spark, sf), shown)


def boundary_links(spark, sf):
    n = fleet.nodes(spark, sf)
    focus = n.where("kind = 'package'").groupBy("repo_id").agg(F.min("id").alias("node"))
    return links.boundary_links(n, fleet.edges(spark, sf), focus, _visible(spark, sf))


def changed_nodes(spark, sf):
    return impact.changed_nodes(fleet.nodes(spark, sf), seeds(spark, sf))


def _state(spark, sf):
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    hits = scores.relevance(file_impact(spark, sf), e, _scored(spark, sf))
    return impact.impact_state(n, hits, impact.changed_nodes(n, seeds(spark, sf)), _MIN, _DEPTH)


def impact_state(spark, sf):
    return _round(_state(spark, sf), "relevance")


def view_stats(spark, sf):
    return impact.view_stats(_state(spark, sf), fleet.edges(spark, sf))


def impact_for_view(spark, sf):
    n, e, s = fleet.nodes(spark, sf), fleet.edges(spark, sf), seeds(spark, sf)
    both = None
    for level, kinds in (("file", ("imports",)), ("package", ("depends_on",))):
        hits = impact.blast_radius(n, e, s, level, Filters(edge_kinds=kinds)).select(
            F.lit(level).alias("level"), "repo_id", "node", "distance")
        both = hits if both is None else both.unionByName(hits)
    return impact.impact_for_view(both, n, "package", True)


def _two_changes(spark, sf):
    ends = fleet.query(spark, sf, "SELECT repo_id, src, dst FROM imports").groupBy("repo_id").agg(
        F.min("src").alias("a"), F.max("dst").alias("b"))
    return ends.select("repo_id", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("grp", "node"))


def seed_overlap(spark, sf):
    """Two changed files per repository, told apart."""
    hits = impact.seed_overlap(fleet.nodes(spark, sf), fleet.edges(spark, sf), _two_changes(spark, sf), "file",
                               Filters(edge_kinds=("imports",)))
    return hits.withColumn("grps", F.array_join("grps", ","))


def seed_overlap_many(spark, sf):
    """As many changes as the fleet has import lines of 1 at multiples of 40: hundreds in a repository."""
    heads = fleet.query(spark, sf, "SELECT repo_id, ord AS grp, src AS node FROM imports WHERE ord % 40 = 1")
    hits = impact.seed_overlap(fleet.nodes(spark, sf), fleet.edges(spark, sf), heads, "file", Filters(3, ("imports",)))
    return hits.withColumn("grps", F.array_join(F.col("grps").cast("array<string>"), ","))


def affected_between(spark, sf):
    """A revision without the edges found on line 2, against the whole graph."""
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    return impact.affected_between((n, e.where("evidence.line <> 2")), (n, e), "file", Filters(3, ("imports",)))


def affected_by_removal(spark, sf):
    """A revision without the edges found on line 2, against one that has lost its pending files and their edges."""
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    stays = n.where("not (kind = 'file' and freshness = 'pending')")
    ids = stays.select("repo_id", "id")
    kept = e.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi").select(*e.columns)
    return impact.affected_between((n, e.where("evidence.line <> 2")), (stays, kept), "file", Filters(3, ("imports",)))


def dangling_edges(spark, sf):
    """Endpoints checked against a graph that has lost its stale files."""
    return integrity.check_endpoints(fleet.nodes(spark, sf).where("freshness <> 'stale'"),
                                     fleet.edges(spark, sf))


def containment_problems(spark, sf):
    """The tree without its stale nodes' directories, and with workspaces under their packages."""
    return integrity.check_containment(_broken_tree(spark, sf))


def _broken_tree(spark, sf):
    n = fleet.nodes(spark, sf).where("kind <> 'directory' or freshness = 'stale'")
    low = n.where("kind = 'package'").groupBy("repo_id", F.col("parent").alias("id")).agg(
        F.min("id").alias("child"))
    return n.join(low, ["repo_id", "id"], "left").withColumn(
        "parent", F.when(F.col("kind") == "workspace", F.col("child")).otherwise(F.col("parent"))).drop("child")


def path_problems(spark, sf):
    """Stored paths checked against an edge table that lost the imports found on line 2."""
    e = fleet.edges(spark, sf).where("evidence.line <> 2")
    return integrity.check_paths(file_impact(spark, sf), e, seeds(spark, sf))


def impact_differences(spark, sf):
    """A search three hops deep against the full one."""
    n, e, s = fleet.nodes(spark, sf), fleet.edges(spark, sf), seeds(spark, sf)
    full = file_impact(spark, sf).withColumn("level", F.lit("file"))
    short = impact.blast_radius(n, e, s, "file", Filters(3, ("imports",), True)).withColumn(
        "level", F.lit("file"))
    return integrity.check_impact(full, short)


def integrity_report(spark, sf):
    """All five checks, each on input that is damaged in its own way."""
    report = integrity.check_report(
        endpoints=dangling_edges(spark, sf), containment=containment_problems(spark, sf),
        paths=path_problems(spark, sf), impact=impact_differences(spark, sf),
        warnings=history.endpoint_warnings(spark, sf))
    return report.withColumn("samples", F.array_join("samples", ";"))


def graph_counts(spark, sf):
    return integrity.graph_counts(fleet.nodes(spark, sf), fleet.edges(spark, sf))


def impact_description(spark, sf):
    e, s = fleet.edges(spark, sf), _scored(spark, sf)
    hits = scores.relevance(file_impact(spark, sf), e, s)
    return _round(integrity.describe_impact(hits, s), "relevance", "specificity")


def file_owners(spark, sf):
    n = fleet.nodes(spark, sf)
    dirs = n.where("kind = 'package'").select("repo_id", F.col("path").alias("rel"),
                                              F.col("id").alias("package"))
    files = n.where("kind = 'file'").select("repo_id", F.col("path").alias("rel"))
    return ownership.owner_of(files, dirs)


def package_dependencies(spark, sf):
    own = fleet.query(spark, sf, "SELECT repo_id, node, owner FROM owners")
    deps = ownership.aggregate_imports(fleet.edges(spark, sf, table="imports"), own, ["ord", "id"])
    return deps.select("repo_id", "src", "dst", "confidence", "valid_from", "imports",
                       F.col("evidence.line").alias("line"), F.col("evidence.artifact").alias("artifact"))


def common_directories(spark, sf):
    """Deepest common directory of what every file imports."""
    paths = fleet.nodes(spark, sf).select("repo_id", F.col("id").alias("dst"), F.col("path").alias("rel"))
    members = fleet.edges(spark, sf, table="imports").join(paths, ["repo_id", "dst"]).select(
        "repo_id", F.col("src").alias("unit"), "rel")
    return ownership.common_dir(members)


_EXEMPT = [ANC, SEEDS, """
exempt AS MATERIALIZED (
  SELECT repo_id, node FROM seeds
  UNION
  SELECT a.repo_id, min_by(a.ancestor, a.depth) FROM anc a
  JOIN seeds s ON s.repo_id = a.repo_id AND s.node = a.node
  JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor GROUP BY a.repo_id, a.node, n.kind)"""]
_SCORED = [policy("scoring", ("imports", "calls", "references", "inherits")), spec("spec", "file", "scoring")]
_FILE = [SEEDS, policy("trav", ("imports",)), trace("trav"), IMPACT]
_LOW = f"""low AS (SELECT s.repo_id, s.node FROM spec s WHERE population > 1 AND specificity < {_MIN}
  AND NOT EXISTS (SELECT 1 FROM exempt x WHERE x.repo_id = s.repo_id AND x.node = s.node))"""
_CHANGED = """
chg AS MATERIALIZED (
  SELECT repo_id, node FROM seeds
  UNION
  SELECT a.repo_id, min_by(a.ancestor, a.depth) FROM anc a
  JOIN seeds s ON s.repo_id = a.repo_id AND s.node = a.node
  JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor AND n.kind IN ('package', 'directory')
  GROUP BY a.repo_id, a.node, n.kind)"""
_RANK = ("CASE {0} WHEN 'current' THEN 0 WHEN 'pending' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END")
_STATE = f"""
state AS MATERIALIZED (
  SELECT n.repo_id, n.id AS node, n.kind, r.distance, r.relevance, c.node IS NOT NULL AS changed,
         r.node IS NOT NULL AS impacted,
         r.node IS NOT NULL AND c.node IS NULL AND r.distance > 0 AND r.relevance < {_MIN} AS muted,
         CASE WHEN r.node IS NOT NULL AND {_RANK.format('r.freshness')} > {_RANK.format('n.freshness')}
              THEN r.freshness ELSE n.freshness END AS effective_freshness
  FROM nodes n LEFT JOIN rel r ON r.repo_id = n.repo_id AND r.node = n.id AND r.distance <= {_DEPTH}
  LEFT JOIN chg c ON c.repo_id = n.repo_id AND c.node = n.id)"""
_STATE_PARTS = [ANC, *_FILE, *_SCORED, RELEVANCE, _CHANGED, _STATE]
_VISIBLE = "visible AS MATERIALIZED (SELECT repo_id, id AS node FROM nodes WHERE kind IN ('repository', 'workspace', 'directory'))"
_REPS = """
reps AS MATERIALIZED (
  SELECT a.repo_id, a.node, min_by(a.ancestor, a.depth) AS rep FROM anc a
  JOIN visible v ON v.repo_id = a.repo_id AND v.node = a.ancestor GROUP BY a.repo_id, a.node)"""
_MODULES = """
flat AS MATERIALIZED (
  SELECT n.repo_id, n.id, n.kind, coalesce(o.owner, n.parent) AS parent FROM nodes n
  LEFT JOIN owners o ON o.repo_id = n.repo_id AND o.node = n.id),
mods AS MATERIALIZED (SELECT repo_id, owner, min(node) AS node FROM owners GROUP BY repo_id, owner)"""

QUERIES = {f.__name__: f for f in (
    hide_by_pattern, text_filter, architecture_nodes, filesystem_nodes, relevance_filter, hidden_count,
    only_affected, stale_filter, representatives, collapsed_edges, file_graph_edges, containment_edges,
    boundary_links, changed_nodes, impact_state, view_stats, impact_for_view, dangling_edges,
    seed_overlap, seed_overlap_many, affected_between, affected_by_removal, containment_problems, path_problems, impact_differences, integrity_report, graph_counts,
    impact_description, file_owners, package_dependencies, common_directories)}

SQL = {
    "hide_by_pattern": ask("""
SELECT n.repo_id, n.id FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM anc a JOIN bad b ON b.repo_id = a.repo_id AND b.id = a.ancestor
  WHERE a.repo_id = n.repo_id AND a.node = n.id)""", ANC, """
bad AS MATERIALIZED (SELECT repo_id, id FROM nodes WHERE regexp_matches(name, '/n1[0-4](/|$)', 'i')
  OR regexp_matches(path, '/n1[0-4](/|$)', 'i') OR regexp_matches(name, 'ring$', 'i')
  OR regexp_matches(path, 'ring$', 'i'))"""),
    "text_filter": ask("SELECT repo_id, id FROM nodes WHERE contains(lower(name), 'widget') "
                       "OR contains(lower(path), 'widget')"),
    "architecture_nodes": ask("""
SELECT f.repo_id, f.id, f.kind FROM flat f WHERE f.kind IN ('repository', 'package', 'build_target')
UNION ALL
SELECT f.repo_id, f.id, f.kind FROM flat f
JOIN flat p ON p.repo_id = f.repo_id AND p.id = f.parent AND p.kind IN ('package', 'build_target')
WHERE f.kind = 'file' AND NOT EXISTS (
  SELECT 1 FROM mods m WHERE m.repo_id = f.repo_id AND m.owner = f.parent AND m.node = f.id)""", _MODULES),
    "filesystem_nodes": ask("SELECT repo_id, id FROM nodes WHERE kind IN ('repository','directory','file','package')"),
    "relevance_filter": ask("""
SELECT n.repo_id, n.id FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM low l WHERE l.repo_id = n.repo_id AND l.node = n.id)""", *_EXEMPT, *_SCORED, _LOW),
    "hidden_count": ask("""
SELECT p.repo_id, count(l.node) AS hidden FROM spec p
LEFT JOIN low l ON l.repo_id = p.repo_id AND l.node = p.node GROUP BY p.repo_id""",
                        *_EXEMPT, *_SCORED, _LOW),
    "only_affected": ask(f"""
SELECT n.repo_id, n.id FROM nodes n WHERE EXISTS (
    SELECT 1 FROM exempt x WHERE x.repo_id = n.repo_id AND x.node = n.id)
  OR EXISTS (SELECT 1 FROM rel r WHERE r.repo_id = n.repo_id AND r.node = n.id AND r.distance <= {_DEPTH}
             AND (r.distance = 0 OR r.relevance >= {_MIN}))""",
                         *_EXEMPT, *_FILE[1:], *_SCORED, RELEVANCE),
    "stale_filter": ask("SELECT repo_id, id FROM nodes WHERE freshness <> 'stale'"),
    "representatives": ask("""
SELECT f.repo_id, f.node, f.ancestor AS representative FROM (
  SELECT a.repo_id, a.node, min_by(a.ancestor, a.depth) AS ancestor FROM anc a
  WHERE EXISTS (SELECT 1 FROM visible v WHERE v.repo_id = a.repo_id AND v.node = a.ancestor)
     OR EXISTS (SELECT 1 FROM hid h WHERE h.repo_id = a.repo_id AND h.node = a.ancestor)
  GROUP BY a.repo_id, a.node) f
WHERE EXISTS (SELECT 1 FROM visible v WHERE v.repo_id = f.repo_id AND v.node = f.ancestor)""", ANC, _VISIBLE, """
hid AS MATERIALIZED (
  SELECT DISTINCT a.repo_id, a.node FROM anc a JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor
  WHERE regexp_matches(n.name, '/n1$', 'i') OR regexp_matches(n.path, '/n1$', 'i'))"""),
    "collapsed_edges": ask("""
SELECT i.repo_id, a.rep AS src, b.rep AS dst, count(*) AS weight, min(i.id) AS edge_id
FROM imports i JOIN reps a ON a.repo_id = i.repo_id AND a.node = i.src
JOIN reps b ON b.repo_id = i.repo_id AND b.node = i.dst
WHERE i.valid_to IS NULL AND i.confidence NOT IN ('heuristic', 'unresolved') AND i.freshness <> 'stale'
  AND a.rep <> b.rep AND a.rep <> 'repo:root' AND b.rep <> 'repo:root'
GROUP BY i.repo_id, a.rep, b.rep""", ANC, _VISIBLE, _REPS),
    "file_graph_edges": ask("""
SELECT i.repo_id, i.id FROM imports i
JOIN nodes a ON a.repo_id = i.repo_id AND a.id = i.src AND a.freshness <> 'stale'
JOIN nodes b ON b.repo_id = i.repo_id AND b.id = i.dst AND b.freshness <> 'stale'
WHERE i.valid_to IS NULL AND i.confidence NOT IN ('heuristic', 'unresolved')"""),
    "containment_edges": ask("""
SELECT a.repo_id, 'tree:' || a.node AS id, 'contains' AS kind, min_by(a.ancestor, a.depth) AS src, a.node AS dst
FROM anc a JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor AND n.kind IN ('repository','package','file')
JOIN nodes s ON s.repo_id = a.repo_id AND s.id = a.node AND s.kind IN ('repository','package','file')
WHERE a.depth > 0 GROUP BY a.repo_id, a.node""", ANC),
    "boundary_links": ask("""
SELECT repo_id, far, outgoing, min_by(kind, row(w, id)) AS kind, min_by(id, row(w, id)) AS edge_id FROM (
  SELECT e.repo_id, r.rep AS far, s.node IS NOT NULL AS outgoing, e.kind, e.id,
         CASE e.kind WHEN 'calls' THEN -3 WHEN 'references' THEN -2 WHEN 'imports' THEN -1 ELSE 0 END AS w
  FROM edges e LEFT JOIN inside s ON s.repo_id = e.repo_id AND s.node = e.src
  LEFT JOIN inside d ON d.repo_id = e.repo_id AND d.node = e.dst
  JOIN reps r ON r.repo_id = e.repo_id AND r.node = CASE WHEN s.node IS NOT NULL THEN e.dst ELSE e.src END
  WHERE e.valid_to IS NULL AND (s.node IS NULL) <> (d.node IS NULL)) x
WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.repo_id = x.repo_id AND i.node = x.far)
GROUP BY repo_id, far, outgoing""", ANC, _VISIBLE, _REPS, """
inside AS MATERIALIZED (
  SELECT a.repo_id, a.node FROM anc a JOIN (
    SELECT repo_id, min(id) AS id FROM nodes WHERE kind = 'package' GROUP BY repo_id) f
  ON f.repo_id = a.repo_id AND f.id = a.ancestor)"""),
    "changed_nodes": ask("SELECT repo_id, node FROM chg", ANC, SEEDS, _CHANGED),
    "impact_state": ask("SELECT * REPLACE (round(relevance, 6) AS relevance) FROM state", *_STATE_PARTS),
    "view_stats": ask("""
SELECT s.repo_id, s.nodes, e.edges, s.changed, s.impacted, s.muted, s.stale + e.stale AS stale FROM (
  SELECT repo_id, count(*) AS nodes, count(*) FILTER (changed) AS changed,
         count(*) FILTER (impacted AND distance > 0 AND NOT muted) AS impacted,
         count(*) FILTER (muted) AS muted, count(*) FILTER (effective_freshness <> 'current') AS stale
  FROM state GROUP BY repo_id) s
JOIN (SELECT repo_id, count(*) AS edges, count(*) FILTER (freshness <> 'current') AS stale
      FROM edges GROUP BY repo_id) e ON e.repo_id = s.repo_id""", *_STATE_PARTS),
    "impact_for_view": ask("""
SELECT repo_id, node, min_by(level, pr) AS level, min_by(distance, pr) AS distance FROM (
  SELECT repo_id, node, level, distance, CASE level WHEN 'package' THEN 0 ELSE 1 END AS pr FROM found) t
GROUP BY repo_id, node""", ANC, SEEDS, """
pseeds AS MATERIALIZED (
  SELECT DISTINCT s.repo_id, a.ancestor AS node FROM seeds s
  JOIN anc a ON a.repo_id = s.repo_id AND a.node = s.node
  JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.ancestor AND n.kind = 'package'),
lseeds AS (SELECT 'file' AS level, * FROM seeds UNION ALL SELECT 'package', * FROM pseeds)""",
                           policy("usable", ("imports", "depends_on")), """
ledges AS MATERIALIZED (SELECT CASE WHEN kind = 'imports' THEN 'file' ELSE 'package' END AS level, * FROM usable)""",
                           trace("ledges", "lseeds", keys="level, repo_id")),
    "seed_overlap": ask("""
SELECT repo_id, node, string_agg(grp, ',' ORDER BY grp) AS grps, CAST(count(*) AS INT) AS hits, min(distance) AS distance
FROM found GROUP BY repo_id, node""", """
gseeds AS (SELECT 'a' AS grp, repo_id, min(src) AS node FROM imports GROUP BY repo_id
           UNION ALL SELECT 'b', repo_id, max(dst) FROM imports GROUP BY repo_id)""",
                        policy("usable", ("imports",)), """
gedges AS MATERIALIZED (SELECT g.grp, u.* FROM usable u, (VALUES ('a'), ('b')) g(grp))""",
                        trace("gedges", "gseeds", keys="grp, repo_id")),
    "seed_overlap_many": ask("""
SELECT repo_id, node, string_agg(CAST(grp AS VARCHAR), ',' ORDER BY grp) AS grps, CAST(count(*) AS INT) AS hits, min(hops) AS distance
FROM (SELECT repo_id, grp, node, min(hops) AS hops FROM felt GROUP BY ALL) GROUP BY repo_id, node""",
                             policy("usable", ("imports",)), """
felt AS (
  SELECT repo_id, ord AS grp, src AS node, 0 AS hops FROM imports WHERE ord % 40 = 1
  UNION
  SELECT f.repo_id, f.grp, u.src, f.hops + 1 FROM felt f JOIN usable u ON u.repo_id = f.repo_id AND u.dst = f.node
  WHERE f.hops < 3)"""),
    "affected_between": ask("SELECT DISTINCT repo_id, node, distance, true AS present FROM found",
                            "came AS (SELECT DISTINCT repo_id, src AS node FROM edges WHERE line = 2)", """
mseeds AS MATERIALIZED (
  SELECT c.repo_id, c.node FROM came c JOIN nodes n ON n.repo_id = c.repo_id AND n.id = c.node AND n.kind = 'file')""",
                            policy("usable", ("imports",)), trace("usable", "mseeds", depth=3)),
    "affected_by_removal": ask("""
SELECT f.repo_id, f.node, min(f.distance) AS distance,
       bool_and(NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = f.repo_id AND g.node = f.node)) AS present
FROM found f GROUP BY f.repo_id, f.node""", """
gone AS MATERIALIZED (SELECT repo_id, id AS node FROM nodes WHERE kind = 'file' AND freshness = 'pending'),
marked AS MATERIALIZED (
  SELECT e.*, a.node IS NOT NULL OR b.node IS NOT NULL AS lost FROM edges e
  LEFT JOIN gone a ON a.repo_id = e.repo_id AND a.node = e.src LEFT JOIN gone b ON b.repo_id = e.repo_id AND b.node = e.dst),
pseeds AS MATERIALIZED (
  SELECT DISTINCT 'now' AS phase, m.repo_id, m.src AS node FROM marked m
  JOIN nodes n ON n.repo_id = m.repo_id AND n.id = m.src AND n.kind = 'file' AND n.freshness <> 'pending'
  WHERE m.lost <> (m.line = 2)
  UNION ALL SELECT 'was', repo_id, node FROM gone)""", policy("usable", ("imports",), source="marked"), """
pedges AS MATERIALIZED (
  SELECT 'now' AS phase, * FROM usable WHERE NOT lost UNION ALL SELECT 'was', * FROM usable WHERE line <> 2)""",
                               trace("pedges", "pseeds", depth=3, keys="phase, repo_id")),
    "dangling_edges": ask("""
SELECT DISTINCT e.repo_id, e.id FROM edges e WHERE
  NOT EXISTS (SELECT 1 FROM nodes n WHERE n.repo_id = e.repo_id AND n.id = e.src AND n.freshness <> 'stale')
  OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.repo_id = e.repo_id AND n.id = e.dst AND n.freshness <> 'stale')"""),
    "containment_problems": ask("""
SELECT t.repo_id, t.id AS node, 'missing_parent' AS problem FROM tree t
WHERE t.parent <> '' AND NOT EXISTS (SELECT 1 FROM tree p WHERE p.repo_id = t.repo_id AND p.id = t.parent)
UNION ALL
SELECT DISTINCT repo_id, node, 'cycle' FROM climb WHERE node = pos AND steps > 0""", """
tree AS MATERIALIZED (
  SELECT n.repo_id, n.id, CASE WHEN n.kind = 'workspace' THEN
    (SELECT min(c.id) FROM nodes c WHERE c.repo_id = n.repo_id AND c.kind = 'package' AND c.parent = n.id)
    ELSE n.parent END AS parent FROM nodes n WHERE n.kind <> 'directory' OR n.freshness = 'stale'),
climb AS (
  SELECT repo_id, id AS node, id AS pos, 0 AS steps FROM tree
  UNION ALL
  SELECT c.repo_id, c.node, t.parent, c.steps + 1 FROM climb c
  JOIN tree t ON t.repo_id = c.repo_id AND t.id = c.pos
  WHERE t.parent <> '' AND c.steps < 64 AND (c.steps = 0 OR c.node <> c.pos))"""),
    "path_problems": ask("""
SELECT repo_id, node, 0 AS path_no, 'unknown_edge' AS problem FROM (
  SELECT repo_id, node, unnest(path) AS eid FROM impact) h
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = h.repo_id AND e.id = h.eid AND e.line <> 2)
GROUP BY repo_id, node""", *_FILE),
    "impact_differences": ask("""
SELECT 'file' AS level, coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.node, b.node) AS node,
       CASE WHEN b.node IS NULL THEN 'only_authored' WHEN a.node IS NULL THEN 'only_computed' ELSE 'distance' END AS problem
FROM impact a FULL JOIN (SELECT repo_id, node, min(d) AS distance FROM shallow GROUP BY repo_id, node) b
  ON a.repo_id = b.repo_id AND a.node = b.node
WHERE a.node IS NULL OR b.node IS NULL OR a.distance <> b.distance""", *_FILE,
                              policy("loose", ("imports",), True), """
shallow AS (
  SELECT repo_id, node, 0 AS d FROM seeds
  UNION
  SELECT s.repo_id, l.src, s.d + 1 FROM shallow s JOIN loose l ON l.repo_id = s.repo_id AND l.dst = s.node
  WHERE s.d < 3)"""),
    "graph_counts": ask("""
SELECT repo_id, 'node' AS what, kind AS name, count(*) AS count FROM nodes GROUP BY repo_id, kind
UNION ALL SELECT repo_id, 'edge', kind, count(*) FROM edges GROUP BY repo_id, kind
UNION ALL SELECT repo_id, 'freshness', freshness, count(*) FROM edges GROUP BY repo_id, freshness"""),
    "impact_description": ask("""
SELECT r.repo_id, r.node, r.distance, round(r.relevance, 6) AS relevance,
       round(coalesce(s.specificity, 1.0), 6) AS specificity,
       r.distance > 0 AND r.relevance < 0.35 AS via_hub, r.distance > 0 AND r.relevance >= 0.35 AS informative
FROM rel r LEFT JOIN spec s ON s.repo_id = r.repo_id AND s.node = r.node""", *_FILE, *_SCORED, RELEVANCE),
    "file_owners": ask("""
SELECT n.repo_id, n.path AS rel, o.owner FROM nodes n
JOIN owners o ON o.repo_id = n.repo_id AND o.node = n.id WHERE n.kind = 'file'"""),
    "package_dependencies": ask("""
SELECT i.repo_id, a.owner AS src, b.owner AS dst,
       CASE WHEN min(CASE WHEN i.confidence = 'heuristic' THEN 1 ELSE 0 END) = 1 THEN 'heuristic' ELSE 'exact' END AS confidence,
       min(i.valid_from) AS valid_from, count(*) AS imports,
       min_by(i.line, row(i.ord, i.id)) AS line, min_by(i.src, row(i.ord, i.id)) AS artifact
FROM imports i JOIN owners a ON a.repo_id = i.repo_id AND a.node = i.src
JOIN owners b ON b.repo_id = i.repo_id AND b.node = i.dst
WHERE a.owner <> b.owner GROUP BY i.repo_id, a.owner, b.owner"""),
    "common_directories": ask("""
SELECT repo_id, unit, CASE WHEN count(DISTINCT dir) = 1 THEN min(dir)
  WHEN count(DISTINCT nat) = 1 THEN min(nat) ELSE 'src' END AS home FROM (
  SELECT i.repo_id, i.src AS unit, 'src/' || split_part(n.path, '/', 2) AS nat,
         'src/' || split_part(n.path, '/', 2) || '/' || split_part(n.path, '/', 3) AS dir
  FROM imports i JOIN nodes n ON n.repo_id = i.repo_id AND n.id = i.dst) t GROUP BY repo_id, unit"""),
}


def _finding(name: str, sql: str, columns: str) -> str:
    return f"""(WITH found AS MATERIALIZED (SELECT concat_ws(' ', {columns}) AS t FROM ({sql}) q)
SELECT '{name}' AS "check", count(*) = 0 AS ok, count(*) AS problems,
       coalesce((SELECT string_agg(t, ';' ORDER BY t) FROM (SELECT DISTINCT t FROM found ORDER BY t LIMIT 5) f), '') AS samples
FROM found)"""


SQL["integrity_report"] = "\nUNION ALL\n".join([
    _finding("endpoints", SQL["dangling_edges"], "repo_id, id"),
    _finding("containment", SQL["containment_problems"], "repo_id, node, problem"),
    _finding("paths", SQL["path_problems"], "repo_id, node, path_no, problem"),
    _finding("impact", SQL["impact_differences"], "level, repo_id, node, problem"),
    _finding("warnings", history.SQL["endpoint_warnings"], "repo_id, id, seq, missing")])
