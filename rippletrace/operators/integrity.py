"""Checks that a graph and its impact results hold together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import stored
from ..schemas import HUB_THRESHOLD
from .ancestry import parent_cycles, parent_links

_SAMPLES = 5


def check_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a missing end: repo_id, id."""
    ids = nodes.select("repo_id", F.col("id").alias("end")).distinct()
    ends = edges.select("repo_id", "id", F.explode(F.array("src", "dst")).alias("end"))
    return ends.join(ids, ["repo_id", "end"], "left_anti").select("repo_id", "id").distinct()


def check_containment(nodes: DataFrame) -> DataFrame:
    """Nodes with a missing parent or inside a parent cycle: repo_id, node, problem."""
    ids = nodes.select("repo_id", F.col("id").alias("parent"))
    missing = parent_links(nodes).join(ids, ["repo_id", "parent"], "left_anti").select(
        "repo_id", "node", F.lit("missing_parent").alias("problem"))
    return missing.unionByName(parent_cycles(nodes).withColumn("problem", F.lit("cycle")))


def check_paths(impact: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Impact rows that cannot be explained: repo_id, node, path_no, problem.

    impact needs repo_id, node, distance, paths; seeds are repo_id, node.
    """
    bare = impact.where((F.col("distance") > 0) & (F.size("paths") == 0)).select(
        "repo_id", "node", F.lit(-1).alias("path_no"), F.lit("no_path").alias("problem"))
    paths = impact.select("repo_id", "node", F.posexplode("paths").alias("path_no", "path"))
    steps = paths.select(
        "repo_id", "node", "path_no", F.size("path").alias("length"),
        F.posexplode(F.transform("path", lambda e, i: F.struct(
            e.alias("id"), F.get("path", i - 1).alias("before")))).alias("hop", "step"))
    ends = edges.select("repo_id", "id", "src", "dst")
    hops = (steps.select("repo_id", "node", "path_no", "length", "hop", "step.*")
            .join(ends, ["repo_id", "id"], "left")
            .join(ends.select("repo_id", F.col("id").alias("before"), F.col("dst").alias("at")),
                  ["repo_id", "before"], "left")
            .withColumn("at", F.when(F.col("hop") == 0, F.col("node")).otherwise(F.col("at"))))
    wrong = hops.where("src is null or at is null or src <> at").groupBy(
        "repo_id", "node", "path_no").agg(
        F.min_by(F.when(F.col("src").isNull(), F.lit("unknown_edge"))
                 .otherwise(F.lit("broken_chain")), "hop").alias("problem"))
    last = (hops.where("hop = length - 1").select("repo_id", "node", "path_no",
                                                  F.col("dst").alias("end"))
            .unionByName(paths.where(F.size("path") == 0).select(
                "repo_id", "node", "path_no", F.col("node").alias("end"))))
    loose = (last.join(seeds.select("repo_id", F.col("node").alias("end")), ["repo_id", "end"],
                       "left_anti")
             .join(wrong, ["repo_id", "node", "path_no"], "left_anti")
             .select("repo_id", "node", "path_no", F.lit("broken_chain").alias("problem")))
    return bare.unionByName(wrong).unionByName(loose)


def check_impact(authored: DataFrame, computed: DataFrame) -> DataFrame:
    """Where two impact results differ: keys, problem. Both carry level, repo_id, node, distance."""
    key = ["level", "repo_id", "node"]
    a = authored.select(*key, F.col("distance").alias("authored"))
    c = computed.select(*key, F.col("distance").alias("computed"))
    return (a.join(c, key, "full_outer")
            .where("authored is null or computed is null or authored <> computed")
            .select(*key, F.when(F.col("computed").isNull(), F.lit("only_authored"))
                    .when(F.col("authored").isNull(), F.lit("only_computed"))
                    .otherwise(F.lit("distance")).alias("problem")))


def check_report(**findings: DataFrame) -> DataFrame:
    """One row per check: check, ok, problems, samples (the first few in order).

    Each finding is a DataFrame whose columns identify one problem; empty means sound. It is
    worked out once: all findings are stored as one table that both answers are read from.
    """
    parts = [rows.select(F.lit(name).alias("check"), F.concat_ws(
        " ", *[F.col(c).cast("string") for c in rows.columns]).alias("text")) for name, rows in findings.items()]
    table = stored(reduce(DataFrame.unionByName, parts), "findings")
    spark = table.sparkSession
    checks = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in findings])).alias("check"))
    total = table.groupBy("check").agg(F.count(F.lit(1)).alias("problems"))
    first = Window.partitionBy("check").orderBy("text")
    samples = (table.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= _SAMPLES)
               .groupBy("check").agg(F.array_sort(F.collect_list("text")).alias("samples")))
    none = F.array().cast("array<string>")
    return checks.join(total, "check", "left").join(samples, "check", "left").select(
        "check", F.col("problems").isNull().alias("ok"), F.coalesce("problems", F.lit(0).cast("long")).alias("problems"),
        F.coalesce("samples", none).alias("samples"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node kind, edge kind and edge freshness: repo_id, what, name, count."""
    parts = (nodes.select("repo_id", F.lit("node").alias("what"), F.col("kind").alias("name"))
             .unionByName(edges.select("repo_id", F.explode(F.array(
                 F.struct(F.lit("edge").alias("what"), F.col("kind").alias("name")),
                 F.struct(F.lit("freshness").alias("what"), F.col("freshness").alias("name"))))
                 .alias("x")).select("repo_id", "x.what", "x.name")))
    return parts.groupBy("repo_id", "what", "name").agg(F.count(F.lit(1)).alias("count"))


def describe_impact(impact: DataFrame, scores: DataFrame,
                    threshold: float = HUB_THRESHOLD) -> DataFrame:
    """Per impacted node its relevance, its own specificity and whether only a hub leads there."""
    own = scores.select("repo_id", "node", "specificity")
    far = F.col("distance") > 0
    return impact.join(own, ["repo_id", "node"], "left").select(
        "repo_id", "node", "distance", "relevance",
        F.coalesce("specificity", F.lit(1.0)).alias("specificity"),
        (far & (F.col("relevance") < threshold)).alias("via_hub"),
        (far & (F.col("relevance") >= threshold)).alias("informative"))
