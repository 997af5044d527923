"""Connected components of a link table, with the smallest member as the name of each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import Rounds, materialize

#: Links up to which one task unites them (3 MB); more take rounds over all tasks.
LOCAL_LINKS = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; the smaller root of two becomes the root of both."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := above.setdefault(at, at)) != at:
            at = up
        while above[x] != at:
            above[x], x = at, above[x]
        return at

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link touches.

    Links are turned into stars round by round: each node hands its larger neighbours to
    its smallest one, then each node points to the smallest below it. Rounds grow with the
    logarithm of a chain's length; the table never grows. Rounds are written to the
    checkpoint folder. Up to ``LOCAL_LINKS`` links are united in one task, with the same result.
    Self links and null ends are ignored; no links give no rows.
    """
    start = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")))
    start, n = materialize(start, "ties")
    if n <= LOCAL_LINKS:
        return materialize(start.repartition(1).mapInArrow(_united, "node long, component long"), "united")[0]
    rounds = Rounds("links")
    state, shape = _round(rounds, start.distinct())
    while shape[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours of a node point to the least of its neighbourhood
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = least.select("u", F.col("m").alias("v")).unionByName(pulled).distinct()
        state, new = _round(rounds, small)
        if new == shape:
            break
        shape = new
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _round(rounds: Rounds, links: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.bit_xor(F.xxhash64("v", "u")).alias("y"))
    table, _ = rounds.write(links)
    seen = table.agg(mark.alias("m")).first()["m"]
    return table, (seen["n"], seen["x"], seen["y"])
