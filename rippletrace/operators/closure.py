"""Transitive reach over the graph of dependency cycles.

Nodes on a cycle reach the same, so each component is one super node and the rest is a
graph without cycles. It is walked once in topological order: a node's wave is the longest
path that leads to it, a band is a few waves, and a band starts when all earlier ones have
handed on what they hold. Every edge carries a set once (or, inside a band, once per path length).

Exact sets are bit cells: a row holds 64 super nodes, so a pair costs a bit instead of a
row, and ``bit_or`` combines before the shuffle. Sketches hold a bounded number of bytes per node and are
merged the same way, for graphs whose exact closure would be too large.

Nodes that no path of edges joins, whatever its direction, have nothing to do with each other. A repository of at most
``cycles.LOCAL_EDGES`` edges is taken apart in a task of its own, which closes the parts of up to ``PART_EDGES`` edges
by the same steps and hands the larger ones back, to be walked by all tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import sequence_number
from ..plans.durable import materialize, stored, stored_by
from ..plans.frontier import hop, raise_values
from . import cycles
from .impact import Filters, admitted_ids, traversable
from .scores import level_filters

#: Waves of a band; the paths inside a band are walked in one job.
BAND = 6
#: Registers of a sketch, as a power of two: a standard error of about 0.8 %.
SKETCH_BITS = 14
#: Edges of a part of the graph up to which one task closes it; its work grows with the square of the part.
PART_EDGES = 50_000
#: Columns of a task's bit table that are worked out at once, and those that small parts share.
_COLUMNS = 4096
_SHARED = 512


def _merged(rows: DataFrame, cell: list[str], merge: Column) -> DataFrame:
    return rows.groupBy(*cell).agg(merge.alias("held"))


def _waves(dag: DataFrame, own: DataFrame, cell: list[str], merge: Column) -> DataFrame:
    """What reaches each node of a graph without cycles, itself included.

    dag: repo_id, src, dst. own: ``cell`` (repo_id, node and what else names a part of a set) and
    held, the node's own part. ``merge`` joins parts. Result: as ``own``.
    """
    at = ["repo_id", "node"]
    level = raise_values(dag, own.select(*at, F.lit(0).alias("value")), ["repo_id"], lambda value: value + 1)
    band = stored(level.select(*at, F.expr(f"value div {BAND}").cast("int").alias("band")), "bands")
    wired = stored(dag.join(band.select("repo_id", F.col("node").alias("src"), F.col("band").alias("src_band")), ["repo_id", "src"])
                   .join(band.select("repo_id", F.col("node").alias("dst"), F.col("band").alias("dst_band")), ["repo_id", "dst"])
                   .select("repo_id", F.col("src").alias("node"), "dst", "src_band", "dst_band"), "wired")
    placed = stored_by(own.join(band, at), "own", "band")
    last = band.agg(F.max("band")).first()[0]
    layers, handed = [], []
    for k in range(0 if last is None else last + 1):
        part = F.lit(k)
        parts = [placed] + handed
        step = _merged(reduce(DataFrame.unionByName, [p.where(F.col("band") == part).select(*cell, "held") for p in parts]), cell, merge)
        inner = wired.where((F.col("src_band") == part) & (F.col("dst_band") == part)).select(*at, "dst")
        for _ in range(BAND - 1):
            step = _merged(hop(step, inner, ["repo_id"], {c: F.col(c) for c in [*cell[2:], "held"]}), cell, merge)
        done = stored(step, "band")
        layers.append(done)
        if k < last:
            outer = wired.where((F.col("src_band") == part) & (F.col("dst_band") > part)).select(*at, "dst", F.col("dst_band").alias("band"))
            moved = done.join(outer, at).drop("node").withColumnRenamed("dst", "node")
            handed.append(stored_by(_merged(moved, [*cell, "band"], merge), "handed", "band"))
    return reduce(DataFrame.unionByName, layers) if layers else own


def _topological(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The nodes of a graph without cycles, sources first."""
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    waits = np.bincount(dst, minlength=n).tolist()
    out = [v for v in range(n) if not waits[v]]
    for v in out:  # grows while it is read
        for w in to[first[v]:first[v + 1]]:
            waits[w] -= 1
            if not waits[w]:
                out.append(w)
    return np.array(out)


def parts_of(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that edges, taken both ways, join with each of ``n`` nodes."""
    part = np.arange(n)
    while True:
        a, b = part[src], part[dst]
        apart = a != b
        if not apart.any():
            return part
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]


def reached_by(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """How many other nodes reach each of ``n`` nodes: components, then bit rows in topological order.

    A part of the graph has a bit table of its own, or shares one with others as small. Its
    columns are taken ``_COLUMNS`` at a time, so it never holds n x n bits.
    """
    root, component = np.unique(cycles.components_of(src, dst, n), return_inverse=True)
    a, b = component[src], component[dst]
    c = len(root)
    dag = np.unique(a[a != b] * c + b[a != b])
    a, b = dag // c, dag % c
    rank = np.empty(c, np.int64)
    rank[_topological(a, b, c)] = np.arange(c)
    part = parts_of(a, b, c)
    by_part = np.lexsort((rank, part))
    ends = np.append(np.flatnonzero(np.diff(part[by_part])) + 1, c)
    place = np.empty(c, np.int64)
    place[by_part] = np.arange(c)
    size = np.bincount(place[component], minlength=c)
    a, b = place[a], place[b]
    order = np.argsort(b, kind="stable")
    before, first = a[order], np.searchsorted(b[order], np.arange(c + 1)).tolist()
    total = np.zeros(c, np.int64)
    begin = 0
    while begin < c:
        # whole parts, as many as share a table, or one
        end = int(ends[max(np.searchsorted(ends, begin + _SHARED, "right") - 1, np.searchsorted(ends, begin, "right"))])
        for low in range(begin, end, _COLUMNS):
            high = min(end, low + _COLUMNS)
            words = -(-(high - low) // 64)
            bits = np.zeros((end - low, words), np.uint64)
            own = np.arange(high - low)
            bits[own, own >> 6] = np.uint64(1) << (own & 63).astype(np.uint64)
            for v in range(low, end):
                if first[v] == first[v + 1]:
                    continue
                into = before[first[v]:first[v + 1]]
                into = into[into >= low] - low
                if len(into):
                    bits[v - low] |= np.bitwise_or.reduce(bits[into], axis=0)
            weight = np.zeros(64 * words, np.int64)
            weight[:high - low] = size[low:high]
            for at in range(0, end - low, 1024):
                some = np.unpackbits(bits[at:at + 1024].view(np.uint8), axis=1, bitorder="little")
                total[low + at:low + at + len(some)] += some @ weight
        begin = end
    return (total - 1)[place[component]]


def _local(pairs: DataFrame) -> DataFrame:
    """repo_id, node, dependents of repositories of a bounded number of edges, each in one task.

    An edge of a part that is too large for that has a row with ``dst`` instead.
    """
    bound = PART_EDGES

    def close(key: tuple, rows: pa.Table) -> pa.Table:
        src, dst, names = cycles.numbered(rows)
        part = parts_of(src, dst, len(names))
        large = (np.bincount(part[src], minlength=len(names)) > bound)[part]
        left = np.flatnonzero(large[src])
        kept = ~large[src]
        some, code = np.unique(np.concatenate([src[kept], dst[kept]]), return_inverse=True)
        half = np.count_nonzero(kept)
        counts = reached_by(code[:half], code[half:], len(some)) if half else np.zeros(0, np.int64)
        felt = counts > 0
        mine = names.take(pa.array(some[felt]))
        none, far = pa.nulls(len(mine), names.type), names.take(pa.array(dst[left]))
        return pa.table({
            "repo_id": pa.repeat(key[0], len(mine) + len(far)),
            "node": pa.concat_arrays([mine, names.take(pa.array(src[left]))]), "dst": pa.concat_arrays([none, far]),
            "dependents": pa.concat_arrays([pa.array(counts[felt], pa.int64()), pa.nulls(len(far), pa.int64())])})

    kind = dict(pairs.dtypes)
    return pairs.groupBy("repo_id").applyInArrow(
        close, f"repo_id {kind['repo_id']}, node {kind['src']}, dst {kind['src']}, dependents long")


def transitive_counts(edges: DataFrame, approx: bool = False) -> DataFrame:
    """repo_id, node, dependents: distinct transitive dependents, the node itself left out.

    edges: repo_id, src, dst. Nodes nobody depends on have no row. With ``approx`` the numbers of
    large repositories are estimated from sketches of ``SKETCH_BITS`` (standard error about 0.8 %).
    """
    pairs = stored(edges.select("repo_id", "src", "dst").where("src <> dst").distinct(), "pairs")
    large, many = materialize(pairs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
                              .where(F.col("n") > cycles.LOCAL_EDGES).select("repo_id"), "large")
    closed = _local(pairs.join(large, "repo_id", "left_anti") if many else pairs).withColumn("walk", F.col("dst").isNotNull())
    closed, left = materialize(closed, "closed", F.count_if("walk"))
    counts = closed.where("not walk").select("repo_id", "node", "dependents")
    if not many and not left:
        return counts
    rest = closed.where("walk").select("repo_id", F.col("node").alias("src"), "dst")
    if many:
        rest = rest.unionByName(pairs.join(large, "repo_id", "left_semi"))
    return counts.unionByName(_distributed(stored(rest, "pairs"), approx))


def _distributed(pairs: DataFrame, approx: bool) -> DataFrame:
    """As ``transitive_counts``, over all tasks."""
    ids = (pairs.select("repo_id", F.col("src").alias("node"))
           .union(pairs.select("repo_id", F.col("dst").alias("node"))).distinct())
    members = stored(ids.join(cycles.cycle_groups(pairs), ["repo_id", "node"], "left").select(
        "repo_id", "node", F.coalesce("group", "node").alias("root")), "members")
    of = {end: members.select("repo_id", F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("src", "dst")}
    dag = stored(pairs.join(of["src"], ["repo_id", "src"]).join(of["dst"], ["repo_id", "dst"])
                 .where("src_root <> dst_root")
                 .select("repo_id", F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).distinct(), "dag")
    counted = _sketched(members, dag) if approx else _exact(members, dag)
    return members.join(counted.withColumnRenamed("node", "root"), ["repo_id", "root"]).select(
        "repo_id", "node", (F.col("reached") - 1).alias("dependents")).where("dependents > 0")


def _exact(members: DataFrame, dag: DataFrame) -> DataFrame:
    """repo_id, node, reached: the members of all super nodes that reach each one, its own included."""
    sizes = members.groupBy("repo_id", F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    # super nodes of several members come first, so that few words hold one
    index = stored(sequence_number(sizes.withColumn("single", F.col("size") == 1), ["repo_id"], ["single", "node"], "idx").select(
        "repo_id", "node", "size", F.expr("idx div 64").alias("word"),
        F.expr("shiftleft(1L, cast(idx % 64 as int))").alias("held")), "index")
    cell = ["repo_id", "node", "word"]
    sets = _waves(dag, index.select(*cell, "held"), cell, F.bit_or("held"))
    more = index.where("size > 1").select("repo_id", "word", F.col("held").alias("bit"), (F.col("size") - 1).alias("extra"))
    several = (sets.join(more, ["repo_id", "word"]).where(F.col("held").bitwiseAND(F.col("bit")) != 0)
               .select("repo_id", "node", F.col("extra").alias("n")))
    ones = sets.select("repo_id", "node", F.bit_count("held").cast("long").alias("n"))
    return ones.unionByName(several).groupBy("repo_id", "node").agg(F.sum("n").alias("reached"))


def _sketched(members: DataFrame, dag: DataFrame) -> DataFrame:
    """As ``_exact``, estimated."""
    own = members.groupBy("repo_id", F.col("root").alias("node")).agg(F.hll_sketch_agg("node", F.lit(SKETCH_BITS)).alias("held"))
    cell = ["repo_id", "node"]
    sets = _waves(dag, stored(own, "sketches"), cell, F.hll_union_agg("held"))
    return sets.select("repo_id", "node", F.hll_sketch_estimate("held").alias("reached"))


def reach(nodes: DataFrame, edges: DataFrame, level: str,
          filters: Filters | None = None, approx: bool = False) -> DataFrame:
    """repo_id, node, dependents, fraction, widest for every node of the level; estimates with ``approx``."""
    filters = level_filters(level) if filters is None else filters
    members = admitted_ids(nodes, level)
    usable = (traversable(edges, filters).select("repo_id", "src", "dst")
              .join(members.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
              .join(members.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi"))
    counts = stored(transitive_counts(usable, approx), "reach")
    totals = members.groupBy("repo_id").agg(F.count(F.lit(1)).alias("population")).join(
        counts.groupBy("repo_id").agg(F.max("dependents").alias("widest")), "repo_id", "left")
    return (members.withColumnRenamed("id", "node").join(counts, ["repo_id", "node"], "left")
            .join(totals, "repo_id")
            .select("repo_id", "node", F.coalesce("dependents", F.lit(0)).alias("dependents"),
                    (F.coalesce("dependents", F.lit(0)) / F.col("population")).alias("fraction"),
                    F.coalesce("widest", F.lit(0)).alias("widest"), "population"))


def reach_rings(reached: DataFrame, max_rings: int = 7) -> DataFrame:
    """Ring of each node from its reach: the widest node in the middle, empty rings closed."""
    widest = F.greatest(F.col("widest"), F.lit(1))
    rings = F.greatest(F.lit(2), F.least(
        F.lit(max_rings), widest + 1, F.round(F.sqrt("population")).cast("long")))
    last = rings - 1
    spread = 1 - F.sqrt(F.col("dependents") / widest)
    index = F.greatest(F.lit(0), F.least(last, F.round(spread * last).cast("long")))
    return _compact(reached.select("repo_id", "node", index.alias("index")))


def focus_rings(distances: DataFrame, unreached: int, max_rings: int = 7) -> DataFrame:
    """Ring of each node from its hops to the focus; what is not reached goes outermost.

    distances: repo_id, node, hops.
    """
    far = distances.groupBy("repo_id").agg(
        F.max(F.when(F.col("hops") < unreached, F.col("hops"))).alias("furthest"))
    rings = F.greatest(F.lit(2), F.least(F.lit(max_rings), F.coalesce("furthest", F.lit(0)) + 1))
    index = F.least(F.col("hops"), rings - 1)
    return _compact(distances.join(far, "repo_id").select("repo_id", "node", index.alias("index")))


def _compact(placed: DataFrame) -> DataFrame:
    """Close the gaps between used rings; a repository has at most a handful of them."""
    used = placed.select("repo_id", "index").distinct()
    below = (used.alias("a").join(used.alias("b"), "repo_id")
             .where("b.index < a.index or b.index = a.index")
             .groupBy("repo_id", F.col("a.index").alias("index"))
             .agg((F.count(F.lit(1)) - 1).alias("ring")))
    return placed.join(below, ["repo_id", "index"]).select("repo_id", "node", "ring")
