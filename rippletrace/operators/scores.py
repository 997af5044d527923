"""How much a dependency says: specificity, relevance, hubs, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from ..plans.frontier import asked
from ..schemas import HUB_THRESHOLD, LEVEL_EDGE_KINDS
from .impact import Filters, admitted_ids, traversable

# Share of a repository that must depend on a node, and its prominence.
_GOLDEN = 1.6180339887
_TIERS = [(0.55, _GOLDEN * _GOLDEN), (0.20, _GOLDEN)]


def level_filters(level: str, include_heuristic: bool = False) -> Filters:
    """Scoring policy of a level when no impact result names its own."""
    return Filters(edge_kinds=tuple(LEVEL_EDGE_KINDS[level]), include_heuristic=include_heuristic)


def score(population: Column, dependents: Column) -> Column:
    """1 for a node with one dependent, 0 for one everybody depends on."""
    raw = F.log(population / F.greatest(dependents, F.lit(1))) / F.log(population.cast("double"))
    return F.when(population <= 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def specificity(nodes: DataFrame, edges: DataFrame, level: str,
                filters: Filters | None = None) -> DataFrame:
    """repo_id, node, dependents, population, specificity, dependent_fraction."""
    filters = level_filters(level) if filters is None else filters
    members = admitted_ids(nodes, level)
    population = members.groupBy("repo_id").agg(F.count(F.lit(1)).alias("population"))
    used_by = (traversable(edges, filters).select("repo_id", "src", "dst")
               # rows lie by src here, so that equal ones meet without another shuffle
               .join(members.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").distinct()
               .groupBy("repo_id", F.col("dst").alias("id"))
               .agg(F.count("src").alias("dependents")))
    return (members.join(used_by, ["repo_id", "id"], "left").join(population, "repo_id")
            .withColumn("dependents", F.coalesce("dependents", F.lit(0)))
            .select("repo_id", F.col("id").alias("node"), "dependents", "population",
                    score(F.col("population"), F.col("dependents")).alias("specificity"),
                    (F.col("dependents") / F.col("population")).alias("dependent_fraction")))


def relevance(impact: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """``impact`` with ``relevance``: the best path's least specific hop target."""
    hops = stored(impact.where((F.col("distance") > 0) & ~F.col("changed"))
                  .select("repo_id", "node", F.posexplode("paths").alias("path_no", "path"))
                  .select("repo_id", "node", "path_no", F.explode("path").alias("id")), "hops")
    ends = asked(edges.select("repo_id", "id", F.col("dst")), hops, ["repo_id", "id"])
    met = stored(hops.join(ends, ["repo_id", "id"], "left"), "met")
    known = asked(scores.select("repo_id", F.col("node").alias("dst"), "specificity"), met, ["repo_id", "dst"])
    best = (met.join(known, ["repo_id", "dst"], "left")
            .groupBy("repo_id", "node", "path_no")
            .agg(F.min(F.coalesce("specificity", F.lit(1.0))).alias("weakest"))
            .groupBy("repo_id", "node").agg(F.max("weakest").alias("relevance")))
    return impact.join(best, ["repo_id", "node"], "left").withColumn(
        "relevance", F.coalesce("relevance", F.lit(1.0)))


def hub_alerts(impact: DataFrame, scores: DataFrame, threshold: float = HUB_THRESHOLD) -> DataFrame:
    """Seeds so widely used that their blast radius says little, least specific first."""
    reach = impact.groupBy("repo_id").agg(
        F.count_if(F.col("distance") > 0).alias("reach"))
    seeds = impact.where("distance = 0").select("repo_id", "node")
    return (seeds.join(scores.where(F.col("specificity") <= threshold), ["repo_id", "node"])
            .join(reach, "repo_id")
            .select("repo_id", "node", "dependents", "population", "specificity", "reach",
                    (F.col("reach") / F.col("population")).alias("reach_fraction"))
            .orderBy("repo_id", "specificity", "node"))


def hub_tier(scores: DataFrame) -> DataFrame:
    """Prominence of each node by the share of its repository that depends on it."""
    tier = F.lit(1.0)
    for share, value in reversed(_TIERS):
        tier = F.when(F.col("dependent_fraction") >= share, F.lit(value)).otherwise(tier)
    return scores.select("repo_id", "node", "dependent_fraction",
                         F.when(F.col("population") <= 1, F.lit(1.0)).otherwise(tier).alias("tier"))
