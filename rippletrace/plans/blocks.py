"""Running values over keys of any size.

A window partitioned by a key puts the whole key into one task. Here rows are
range-partitioned by (key, order) instead, so a hot key spans many blocks; a window
runs inside each block and the totals of earlier blocks of the same key are added.
The totals table has at most one row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import stored

_WINDOW = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}


def _blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ranged = df.repartitionByRange(*keys, *order)
    return stored(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def running(df: DataFrame, keys: list[str], order: list[str],
            specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (which must be unique per key).

    ``specs`` maps an output name to (``count`` | ``sum`` | ``max`` | ``min`` | ``last``, column);
    ``last`` keeps the latest non-null value. ``exclusive`` leaves the current row out.
    """
    prepared = df
    for name, (_, column) in specs.items():
        prepared = prepared.withColumn(f"_in_{name}", column)
    blocks = _blocks(prepared, keys, order)

    end = -1 if exclusive else 0
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    totals, carried, local = [], [], []
    for name, (kind, _) in specs.items():
        source = F.col(f"_in_{name}")
        if kind == "last":
            totals.append(F.max_by(
                source, F.when(source.isNotNull(), F.struct(*order))).alias(f"_t_{name}"))
            carried.append(F.last(f"_t_{name}", True).over(before).alias(f"_c_{name}"))
            local.append(F.last(source, True).over(inside).alias(f"_w_{name}"))
        else:
            outer = F.sum if kind == "count" else _WINDOW[kind]
            totals.append(_WINDOW[kind](source).alias(f"_t_{name}"))
            carried.append(outer(f"_t_{name}").over(before).alias(f"_c_{name}"))
            local.append(_WINDOW[kind](source).over(inside).alias(f"_w_{name}"))

    # null is a key like any other
    carry = blocks.groupBy(*keys, "_block").agg(*totals).select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"), *carried)
    same = F.col("_block") == F.col("_of_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = blocks.select("*", *local).join(carry, same, "left")

    outputs = []
    for name, (kind, _) in specs.items():
        own, prior = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if kind in ("count", "sum"):
            value = F.coalesce(own, F.lit(0)) + F.coalesce(prior, F.lit(0))
        elif kind == "max":
            value = F.greatest(own, prior)
        elif kind == "min":
            value = F.least(own, prior)
        else:
            value = F.coalesce(own, prior)
        outputs.append(value.alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *outputs)


def sequence_number(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, exclusive=True)
