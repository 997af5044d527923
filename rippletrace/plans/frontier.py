"""Level-synchronous traversal: one job per hop, all repositories at once.

A hop joins the newest nodes with the edge table, keeps one visit per node, combined
before the shuffle, and leaves out what an earlier hop has reached. Only the new layer is
written, and counting it during the write tells when to stop; earlier layers are read by
their keys alone and merged now and then, so plans stay small. The frontier is broadcast
only when its size is below the session threshold; a hot join key is split by the
adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import materialize, stored

#: Layers after which the keys reached so far are merged into one table.
_MERGE_AFTER = 8
#: Hops that a job takes at most, and rows of a frontier up to which it takes them all.
_MOST_HOPS = 8
_FEW = 20_000


def listed(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a small stored table whose ``keys`` a large one holds, which is filtered by them and not shuffled."""
    return rows.join(asked(among.select(*keys), rows, keys), keys, "left_semi")


def asked(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``table`` that a stored, usually small, table asks for: few are broadcast, many are joined."""
    return table.join(rows.select(*keys), keys, "left_semi")


class _Layers:
    """What each hop reached, and the keys of all of it."""

    def __init__(self, first: DataFrame, keys: list[str]):
        self.keys = keys
        self.layers: list[DataFrame] = []
        self.known: list[DataFrame] = []
        self.found = 0
        self._add(first)

    def _add(self, rows: DataFrame) -> None:
        layer, self.found = materialize(rows, "layer")
        self.newest = layer
        self.layers.append(layer)
        self.known.append(layer.select(*self.keys))
        if len(self.known) > _MERGE_AFTER:
            self.known = [stored(reduce(DataFrame.unionByName, self.known), "reached")]

    def advance(self, visits: DataFrame, among: DataFrame | None = None) -> None:
        """Keep the visits (one per key) that no earlier layer holds and, if given, ``among`` (keys) does."""
        reached = reduce(DataFrame.unionByName, self.known)
        fresh = visits.join(reached, self.keys, "left_anti").select(*self.newest.columns)
        self._add(fresh if among is None else listed(stored(fresh, "fresh"), among, self.keys))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.layers)


def trace_back(edges: DataFrame, seeds: DataFrame, max_depth: int, among: DataFrame | None = None) -> DataFrame:
    """Reverse breadth-first search keeping one deterministic shortest path per node.

    edges: repo_id, id, src, dst, stale BOOLEAN, valid_from LONG.
    seeds: repo_id, node.
    among: repo_id, node, the only nodes that a hop may reach; all of them if not given.
    Result: repo_id, node, distance, seed, path (edge ids, node first), stale, newest.

    Among equally short paths the smallest (seed, edge ids read from the seed) wins,
    which is the path a queue over sorted seeds and sorted in-edges meets first.
    """
    edges = stored(edges.select(
        "repo_id", "id", "src", F.col("dst").alias("node"), F.col("stale").alias("hop_stale"),
        "valid_from"), "edges")
    visit = ["distance", "seed", "trail", "stale", "newest"]
    reach = _Layers(seeds.select("repo_id", "node").distinct().select(
        "repo_id", "node", F.lit(0).alias("distance"), F.col("node").alias("seed"),
        F.array().cast("array<string>").alias("trail"), F.lit(False).alias("stale"),
        F.lit(None).cast("long").alias("newest")), ["repo_id", "node"])
    depth = 0
    while reach.found and depth < max_depth:
        depth += 1
        step = reach.newest.join(edges, ["repo_id", "node"]).select(
            "repo_id", F.col("src").alias("node"), F.lit(depth).alias("distance"), "seed",
            F.concat("trail", F.array("id")).alias("trail"),
            (F.col("stale") | F.col("hop_stale")).alias("stale"),
            F.greatest("newest", "valid_from").alias("newest"))
        reach.advance(step.groupBy("repo_id", "node").agg(F.min(F.struct(*visit)).alias("visit"))
                      .select("repo_id", "node", "visit.*"), among)
    state = reach.all()
    return state.select("repo_id", "node", "distance", "seed", F.reverse("trail").alias("path"),
                        "stale", "newest")


def reach_set(edges: DataFrame, seeds: DataFrame, keys: list[str],
              labels: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes reached along ``edges`` (keys, src, dst) from ``seeds`` (keys, labels, node).

    ``labels`` tell apart searches that walk the same edges; ``keys`` partition the edges
    too. All searches share the rounds. Result: keys, labels, node, hops.
    """
    who = [*keys, *(labels or [])]
    edges = edges.select(*keys, F.col("src").alias("node"), "dst")
    reach = _Layers(seeds.select(*who, "node").distinct().withColumn("hops", F.lit(0)), [*who, "node"])
    depth = 0
    while reach.found and (max_depth is None or depth < max_depth):
        depth += 1
        step = reach.newest.drop("hops").join(edges, [*keys, "node"])
        reach.advance(step.select(*who, F.col("dst").alias("node"), F.lit(depth).alias("hops")).distinct())
    return reach.all()


class _Pace:
    """Hops per job: one while a large frontier grows, more as it shrinks, the most once it is small."""

    def __init__(self):
        self.hops, self.before = 1, 0

    def next(self, found: int) -> int:
        shrinks = found < self.before
        self.hops = _MOST_HOPS if found <= _FEW else min(_MOST_HOPS, 2 * self.hops) if shrinks else 1
        self.before = found
        return self.hops


def hop(step: DataFrame, edges: DataFrame, keys: list[str], carried: dict[str, Column]) -> DataFrame:
    """The rows of ``step`` (keys, node, ...) and what they become across ``edges`` (keys, node, dst).

    ``carried`` says what the other columns are on the far side. Staying and going rows come out
    of one join, so a chain of hops is a chain of joins, however many it has.
    """
    stay = F.struct("node", *[F.col(c) for c in carried])
    go = F.struct(F.col("dst").alias("node"), *[value.alias(c) for c, value in carried.items()])
    both = F.when(F.col("dst").isNull(), F.array(stay)).otherwise(F.array(stay, go))
    met = step.join(edges, [*keys, "node"], "left")
    return met.select(*keys, F.explode(both).alias("row")).select(*keys, "row.*")


def sweep(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node: what ``edges`` (keys, src, dst) reach from ``seeds`` (keys, node), these included.

    Like ``reach_set`` without hop counts, so a job may take several hops before it looks what
    is new; long thin tails then cost a fraction of a job for each hop.
    """
    edges = edges.select(*keys, F.col("src").alias("node"), "dst")
    reach, pace = _Layers(seeds.select(*keys, "node").distinct(), [*keys, "node"]), _Pace()
    while reach.found:
        step = reach.newest
        for _ in range(pace.next(reach.found)):
            step = hop(step, edges, keys, {}).distinct()
        reach.advance(step)
    return reach.all()


def raise_values(edges: DataFrame, start: DataFrame, keys: list[str], passed: Callable[[Column], Column]) -> DataFrame:
    """keys, node, value: the largest value that reaches each node over ``edges`` (keys, src, dst).

    start: keys, node, value, one row per node; ``passed`` makes the value that an edge hands on.
    A round writes only the values that rose. What is known of a node is the largest of all
    layers, merged into one table now and then. ``passed`` must not grow along a cycle.
    """
    at = [*keys, "node"]
    most = F.max("value").alias("value")
    edges = edges.select(*keys, F.col("src").alias("node"), "dst")
    newest, found = materialize(start.select(*at, "value"), "values")
    layers, pace = [newest], _Pace()
    while found:
        step = newest
        for _ in range(pace.next(found)):
            step = hop(step, edges, keys, {"value": passed(F.col("value"))}).groupBy(*at).agg(most)
        known = layers[0] if len(layers) == 1 else reduce(DataFrame.unionByName, layers).groupBy(*at).agg(most)
        rose = step.join(known.withColumnRenamed("value", "old"), at, "left").where(
            F.col("old").isNull() | (F.col("value") > F.col("old")))
        newest, found = materialize(rose.select(*at, "value"), "values")
        if found:
            layers.append(newest)
        if len(layers) > _MERGE_AFTER:
            layers = [stored(reduce(DataFrame.unionByName, layers).groupBy(*at).agg(most), "known")]
    return layers[0] if len(layers) == 1 else reduce(DataFrame.unionByName, layers).groupBy(*at).agg(most)


def spread_bits(edges: DataFrame, start: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """keys, node, word, bits, hops: the bits that each node first gets after so many hops.

    start: keys, node, word, bits. Many searches over one edge table (keys, src, dst) at once: a
    search is a bit of a word, so 64 of them share a row, and a hop hands on only bits that the
    far node lacks. Rows of one node and word hold different bits.
    """
    cell = [*keys, "node", "word"]
    edges = edges.select(*keys, F.col("src").alias("node"), "dst")
    all_bits = F.bit_or("bits").alias("bits")
    newest, found = materialize(start.groupBy(*cell).agg(all_bits).withColumn("hops", F.lit(0)), "bits")
    layers, known, depth = [newest], [newest.drop("hops")], 0
    while found and (max_depth is None or depth < max_depth):
        depth += 1
        step = newest.join(edges, [*keys, "node"]).select(*keys, F.col("dst").alias("node"), "word", "bits").groupBy(*cell).agg(all_bits)
        had = reduce(DataFrame.unionByName, known).groupBy(*cell).agg(F.bit_or("bits").alias("had"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        newest, found = materialize(step.join(had, cell, "left").select(*cell, fresh.alias("bits"), F.lit(depth).alias("hops"))
                                    .where("bits <> 0"), "bits")
        layers.append(newest)
        known.append(newest.drop("hops"))
        if len(known) > _MERGE_AFTER:
            known = [stored(reduce(DataFrame.unionByName, known).groupBy(*cell).agg(all_bits), "known")]
    return reduce(DataFrame.unionByName, layers)
