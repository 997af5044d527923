"""Dependency cycles: strongly connected components by trimming, a pivot and colouring.

The largest component of a repository is nearly always one giant. It is taken in one
step: what the strongest node reaches and what reaches it are two sweeps that share their
rounds, and the nodes in both are its component. What is left falls into parts that no cycle
crosses (reached only, reaching only, neither), loses most of its edges to trimming, and is
settled by colouring, where a round writes only the labels that moved.

A repository that has at most ``LOCAL_EDGES`` at any of these points, the first included, is finished in a task of
its own, in time and memory linear in its edges; only larger ones are trimmed and walked in rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Rounds, materialize, stored
from ..plans.frontier import raise_values, sweep

# Edge kinds that hold the tree together rather than express a dependency.
STRUCTURAL_KINDS = ["contains", "owns"]
#: Edges of a repository, at the start or after trimming, up to which one task settles it.
LOCAL_EDGES = 2_000_000
_WAY = ["repo_id", "way"]


def _trim(live: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle while that still removes a good share."""
    rounds = Rounds("trim")
    while size:
        entered = live.select("repo_id", F.col("dst").alias("src"))
        left = live.select("repo_id", F.col("src").alias("dst"))
        kept, count = rounds.write(
            live.join(entered, ["repo_id", "src"], "left_semi")
            .join(left, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"))
        shrunk, live, size = size - count, kept, count
        if shrunk < 0.2 * (size + shrunk):
            break
    return live, size


def _strength(live: DataFrame) -> DataFrame:
    """repo_id, node, weight: in-degree x out-degree."""
    ends = (live.select("repo_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
            .unionByName(live.select("repo_id", F.col("dst").alias("node"), F.lit(0).alias("o"),
                                     F.lit(1).alias("i"))))
    return ends.groupBy("repo_id", "node").agg((F.sum("o") * F.sum("i")).alias("weight"))


def _both_ways(live: DataFrame) -> DataFrame:
    """The edges along (way 1) and against (way 2) their direction."""
    return stored(live.withColumn("way", F.lit(1)).unionByName(
        live.select("repo_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(2).alias("way"))), "ways")


def _giants(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The component of each repository's strongest node (repo_id, root, node), and the edges beyond it."""
    pivots = stored(_strength(live).groupBy("repo_id").agg(F.max(F.struct("weight", "node")).alias("p"))
                    .select("repo_id", F.col("p.node").alias("root")), "pivots")
    seeds = pivots.select("repo_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("way"), F.col("root").alias("node"))
    swept = sweep(_both_ways(live), seeds, _WAY)
    # 1 reached, 2 reaching, 3 both
    sides = stored(swept.groupBy("repo_id", "node").agg(F.sum("way").alias("side")), "sides")
    giant = sides.where("side = 3").join(pivots, "repo_id").select("repo_id", "root", "node")
    none = F.lit(0).cast("long")
    ends = live
    for end in ("src", "dst"):
        ends = ends.join(sides.select("repo_id", F.col("node").alias(end), F.col("side").alias(f"{end}_side")),
                         ["repo_id", end], "left").withColumn(f"{end}_side", F.coalesce(f"{end}_side", none))
    rest = ends.where("src_side = dst_side and src_side < 3").select("repo_id", "src", "dst")
    return giant, rest


def _labels(live: DataFrame) -> DataFrame:
    """repo_id, node, above, below: the strongest node that reaches it, and the strongest it reaches."""
    own = F.struct("weight", "node")
    start = _strength(live).select("repo_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("way"), "node", own.alias("value"))
    settled = raise_values(_both_ways(live), start, _WAY, lambda value: value)
    return settled.groupBy("repo_id", "node").agg(
        F.max(F.when(F.col("way") == 1, F.col("value.node"))).alias("above"),
        F.max(F.when(F.col("way") == 2, F.col("value.node"))).alias("below"))


def numbered(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ends of a repository's edges as numbers of nodes, and the names of these."""
    ends = pa.chunked_array([*part["src"].chunks, *part["dst"].chunks], part.schema.field("src").type).combine_chunks().dictionary_encode()
    code = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return code[:part.num_rows], code[part.num_rows:], ends.dictionary


def components_of(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A node of the component of each of ``n`` nodes, the same for all of its members.

    Nodes without an edge in or out go first, while that removes a good share.
    """
    found, before = np.arange(n), None
    while before is None or len(src) < 0.9 * before:
        before = len(src)
        kept = (np.bincount(dst, minlength=n) > 0)[src] & (np.bincount(src, minlength=n) > 0)[dst]
        src, dst = src[kept], dst[kept]
    core, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    if len(core):
        found[core] = core[_depth_first(code[:len(src)], code[len(src):], len(core))]
    return found


def _depth_first(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """``components_of`` by one depth-first search with an explicit stack."""
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, low, seen = first[:n], [0] * n, [0] * n
    component, open_, clock = [-1] * n, [], 0
    for start in range(n):
        if seen[start]:
            continue
        walk = [start]
        while walk:
            node = walk[-1]
            if not seen[node]:
                clock += 1
                seen[node] = low[node] = clock
                open_.append(node)
            if at[node] < first[node + 1]:
                other = to[at[node]]
                at[node] += 1
                if not seen[other]:
                    walk.append(other)
                elif component[other] < 0:
                    low[node] = min(low[node], seen[other])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[node])
            if low[node] == seen[node]:
                while component[node] < 0:
                    component[open_.pop()] = node
    return np.array(component)


def _settled(live: DataFrame) -> DataFrame:
    """repo_id, root, node for repositories of a bounded number of edges, each in one task."""
    def settle(key: tuple, part: pa.Table) -> pa.Table:
        src, dst, names = numbered(part)
        found = components_of(src, dst, len(names))
        return pa.table({"repo_id": pa.repeat(key[0], len(names)), "root": names.take(pa.array(found)), "node": names})

    kind = dict(live.dtypes)
    return live.groupBy("repo_id").applyInArrow(settle, f"repo_id {kind['repo_id']}, root {kind['src']}, node {kind['src']}")


def _coloured(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components whose strongest members meet in colouring (repo_id, root, node), and the edges beyond them.

    A node whose strongest predecessor and successor are the same node shares a cycle with it; edges
    between different label pairs cannot lie on a cycle and are cut.
    """
    labels = stored(_labels(live), "labels")
    ends = labels.where("above <> below")
    rest = (live.join(ends.select("repo_id", F.col("node").alias("src"), "above", "below"), ["repo_id", "src"])
            .join(ends.select("repo_id", F.col("node").alias("dst"), "above", "below"), ["repo_id", "dst", "above", "below"])
            .select("repo_id", "src", "dst"))
    return labels.where("above = below").select("repo_id", F.col("above").alias("root"), "node"), rest


def cycle_groups(edges: DataFrame) -> DataFrame:
    """repo_id, group, node: groups of nodes that reach each other, larger than one.

    edges: repo_id, src, dst. A group is named by its smallest member.
    """
    found, take, trimmed = [], _giants, False
    live, size = materialize(edges.select("repo_id", "src", "dst").where("src <> dst").distinct(), "edges")
    while size:
        large, many = materialize(live.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL_EDGES)
                                  .select("repo_id"), "large")
        found.append(stored(_settled(live.join(large, "repo_id", "left_anti") if many else live), "settled"))
        if not many:
            break
        rest = live.join(large, "repo_id", "left_semi")
        if not trimmed:
            live, size = _trim(*materialize(rest, "large-edges"))
            trimmed = True
            continue
        members, rest = take(rest)
        found.append(members)
        live, size = materialize(rest, "rest")
        take, trimmed = _coloured, False
    if not found:
        return edges.select("repo_id", F.col("src").alias("group"), F.col("dst").alias("node")).limit(0)
    members = reduce(DataFrame.unionByName, found)
    names = (members.groupBy("repo_id", "root")
             .agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return members.join(names, ["repo_id", "root"]).select("repo_id", "group", "node")


def cycle_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Non-structural edges with both ends in one group: repo_id, group, id, src, dst."""
    end = groups.select("repo_id", F.col("node"), F.col("group"))
    return (edges.where(~F.col("kind").isin(STRUCTURAL_KINDS))
            .join(end.withColumnRenamed("node", "src"), ["repo_id", "src"])
            .join(end.select("repo_id", F.col("node").alias("dst"), F.col("group").alias("dst_group")),
                  ["repo_id", "dst"])
            .where(F.col("group") == F.col("dst_group"))
            .select("repo_id", "group", "id", "src", "dst"))
