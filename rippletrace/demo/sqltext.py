"""Pieces of SQL shared by the reference questions."""

from __future__ import annotations

from .. import fleet

SEEDS = """
seeds AS MATERIALIZED (
  SELECT repo_id, min(src) AS node FROM imports GROUP BY repo_id
  UNION SELECT repo_id, max(dst) FROM imports GROUP BY repo_id)"""

ANC = """
anc AS (
  SELECT repo_id, id AS node, id AS ancestor, 0 AS depth, parent AS up FROM nodes
  UNION ALL
  SELECT a.repo_id, a.node, n.id, a.depth + 1, n.parent
  FROM anc a JOIN nodes n ON n.repo_id = a.repo_id AND n.id = a.up)"""


def policy(name: str, kinds: tuple[str, ...], heuristic: bool = False, source: str = "edges") -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    sure = "" if heuristic else "AND confidence NOT IN ('heuristic', 'unresolved')"
    return (f"{name} AS MATERIALIZED (SELECT * FROM {source} WHERE valid_to IS NULL "
            f"AND kind IN ({listed}) AND freshness <> 'invalid' {sure})")


def trace(edges: str, seeds: str = "seeds", depth: int = 8, keys: str = "repo_id") -> str:
    """Unrolled reverse search with the smallest (seed, trail) per node and level."""
    key_list = [k.strip() for k in keys.split(",")]
    on_edge = " AND ".join(f"e.{k} = p.{k}" for k in key_list)
    parts = [f"hop0 AS MATERIALIZED (SELECT {keys}, node, 0 AS distance, node AS seed, "
             f"CAST([] AS VARCHAR[]) AS trail, false AS stale, CAST(NULL AS BIGINT) AS newest "
             f"FROM {seeds})", "seen0 AS (SELECT * FROM hop0)"]
    for d in range(1, depth + 1):
        same = " AND ".join(f"v.{k} = c.{k}" for k in key_list)
        ek = ", ".join(f"e.{k}" for k in key_list)
        parts.append(f"""hop{d} AS MATERIALIZED (
  SELECT {keys}, node, {d} AS distance, best.seed AS seed, best.trail AS trail, best.stale AS stale,
         best.newest AS newest FROM (
    SELECT {ek}, e.src AS node, min({{'seed': p.seed, 'trail': list_append(p.trail, e.id),
           'stale': p.stale OR e.freshness = 'stale',
           'newest': greatest(p.newest, e.valid_from)}}) AS best
    FROM hop{d - 1} p JOIN {edges} e ON {on_edge} AND e.dst = p.node GROUP BY {ek}, e.src) c
  WHERE NOT EXISTS (SELECT 1 FROM seen{d - 1} v WHERE {same} AND v.node = c.node))""")
        parts.append(f"seen{d} AS MATERIALIZED (SELECT * FROM seen{d - 1} UNION ALL SELECT * FROM hop{d})")
    parts.append(f"found AS MATERIALIZED (SELECT {keys}, node, distance, stale, newest, "
                 f"list_reverse(trail) AS path FROM seen{depth})")
    return ",\n".join(parts)


IMPACT = """
impact AS MATERIALIZED (
  SELECT f.repo_id, f.node, f.distance, f.distance = 1 AS direct, f.distance = 0 AS changed,
         CASE WHEN f.stale THEN 'stale' ELSE coalesce(n.freshness, 'current') END AS freshness,
         f.path
  FROM found f LEFT JOIN nodes n ON n.repo_id = f.repo_id AND n.id = f.node)"""


def spec(name: str, kind: str, edges: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT m.repo_id, m.id AS node, coalesce(d.dependents, 0) AS dependents, p.population,
         CASE WHEN p.population <= 1 THEN 1.0 ELSE
           greatest(0.0, least(1.0, ln(p.population / greatest(coalesce(d.dependents, 0), 1))
                                    / ln(p.population))) END AS specificity,
         coalesce(d.dependents, 0) / p.population AS dependent_fraction
  FROM (SELECT * FROM nodes WHERE kind = '{kind}') m
  JOIN (SELECT repo_id, count(*) AS population FROM nodes WHERE kind = '{kind}' GROUP BY repo_id) p
    ON p.repo_id = m.repo_id
  LEFT JOIN (SELECT e.repo_id, e.dst, count(DISTINCT e.src) AS dependents
             FROM {edges} e JOIN nodes s ON s.repo_id = e.repo_id AND s.id = e.src AND s.kind = '{kind}'
             GROUP BY e.repo_id, e.dst) d ON d.repo_id = m.repo_id AND d.dst = m.id)"""


RELEVANCE = """
rel AS MATERIALIZED (
  SELECT i.*, coalesce(r.relevance, 1.0) AS relevance FROM impact i LEFT JOIN (
    SELECT h.repo_id, h.node, min(coalesce(s.specificity, 1.0)) AS relevance
    FROM (SELECT repo_id, node, unnest(path) AS eid FROM impact WHERE distance > 0) h
    LEFT JOIN edges e ON e.repo_id = h.repo_id AND e.id = h.eid
    LEFT JOIN spec s ON s.repo_id = h.repo_id AND s.node = e.dst
    GROUP BY h.repo_id, h.node) r ON r.repo_id = i.repo_id AND r.node = i.node)"""


def ask(select: str, *parts: str, grain: str = "half") -> str:
    body = ",\n".join([fleet.ctes(grain), *[p.strip() for p in parts]])
    return f"WITH RECURSIVE {body}\n{select}"
