"""Mixing sources to target weights by capped water-filling.

All sources together are poured out by weight. A source that would be read more than
``max_epochs`` times stops there, and its excess goes to the others by weight, until no
source is above its limit. A source's target is then so many whole repetitions of each
document plus a fractional one: its documents in the order of a seeded hash, up to a
boundary document of which the leading words are taken.

The decision about a source is one row (repetitions and boundary), so applying the mix to
the documents needs no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.blocks import running, sequence_number
from rippletrace.plans.durable import materialize, stored

from .common import annotate, free, words

MAX_EPOCHS = 3
#: Rows of a table of sources up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def cyclic_weight(position: Column) -> Column:
    """1, 2, 3, repeating, by the source's place in code point order (null last)."""
    return (position % 3 + 1).cast("long")


def draw(id_col: str, seed: str = SEED) -> Column:
    """Place of a document in its source's order: a seeded hash of the id as text."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size): the number of words of each whole text, 0 for a null one."""
    picked = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("body"))
    return annotate(picked, "body", "size long", lambda: lambda texts: [[len(words(t)) for t in texts]], keep_text=False)


def small(sources: DataFrame, label: str) -> DataFrame:
    """A stored table of one row per source, broadcast if it is counted to be within the bound."""
    table, n = materialize(sources, label)
    return F.broadcast(table) if n <= BROADCAST_SOURCES else table


def level(sources: DataFrame) -> tuple[int, int]:
    """The water level as a fraction: words per unit of weight at which the limits hold.

    ``sources`` has ``size``, ``weight`` and ``limit``. Only sums come to the driver.
    """
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    total, weight = int(total or 0), int(weight or 0)
    num, den = total, weight
    while den:
        full = _above(num, den)
        held, free = sources.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = (total - int(held), int(free))
        if new == (num, den):
            return new
        num, den = new
    return 0, 1


def _above(num: int, den: int) -> Column:
    wide = "decimal(20,0)"
    return (F.col("weight").cast("decimal(10,0)") * F.lit(num).cast(wide)
            > F.col("limit").cast(wide) * F.lit(den).cast("decimal(18,0)"))


def plan(sized: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, max_epochs: int = MAX_EPOCHS,
         seed: str = SEED) -> DataFrame:
    """One row per source: source_size, weight, target, whole, and the boundary of the fractional part.

    ``sized`` (a stored table) has id, source, size. A source without words has target 0.
    Null is a source, the last one. Ids that are equal share their place in the order.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    ordered = sequence_number(per_source.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "position")
    sources = stored(ordered.select(
        "source", "size", weight(F.col("position")).alias("weight"), (max_epochs * F.col("size")).alias("limit")), "sources")
    num, den = level(sources)
    full = _above(num, den)
    share = (F.col("weight") * F.lit(num)).cast("double") / F.lit(den).cast("double")
    target = F.when(full, F.col("limit").cast("double")).otherwise(share)
    goal = F.floor(F.col("target") + 0.5)
    poured = (sources.withColumn("target", target)
              .withColumn("whole", F.when(F.col("size") > 0, F.least(
                  F.floor(F.col("target") / F.col("size")), F.lit(max_epochs).cast("long"))).otherwise(0))
              .withColumn("extra", goal - F.col("whole") * F.col("size"))
              .select("source", F.col("size").alias("source_size"), "weight", "target", "whole", "extra"))
    order = sized.select("source", "size", "id", draw("id", seed).alias("draw"))
    summed = running(order.where(F.col("size") > 0), ["source"], ["draw", "id", "size"],
                     {"before": ("sum", F.col("size"))}, exclusive=True)
    wanted = small(poured.where(F.col("extra") > 0).select(F.col("source").alias("of"), "extra"), "wanted")
    edge = (summed.join(wanted, F.col("source").eqNullSafe(F.col("of")))
            .where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("size")))
            .groupBy("of").agg(F.min(F.struct("draw", "id", (F.col("extra") - F.col("before")).alias("part"))).alias("edge")))
    return poured.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "weight", "target", "whole",
        F.col("edge.draw").alias("edge_draw"), F.col("edge.id").alias("edge_id"), F.col("edge.part").alias("edge_part"))


def _place(id_col: str, seed: str, at: str = "") -> tuple[Column, Column]:
    """Whether a document lies before its source's boundary, and whether it is the boundary."""
    own, edge, edge_id = draw(id_col, seed), F.col(f"{at}edge_draw"), F.col(f"{at}edge_id")
    same = (own == edge) & F.col(id_col).eqNullSafe(edge_id)
    ahead = (own < edge) | ((own == edge) & ~same & (
        F.col(id_col).isNull() | F.coalesce(F.col(id_col) < edge_id, F.lit(False))))
    return F.coalesce(ahead, F.lit(False)), F.coalesce(same, F.lit(False))


def taken(sized: DataFrame, sources: DataFrame, seed: str = SEED) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes."""
    own = small(sources.withColumnRenamed("source", "of"), "plan")
    ahead, same = _place("id", seed)
    part = F.when(ahead, F.col("size")).when(same, F.least("size", "edge_part")).otherwise(0)
    return (sized.join(own, F.col("source").eqNullSafe(F.col("of")))
            .select("id", "source", "size", "source_size", "target",
                    (F.col("whole") * F.col("size") + part).cast("long").alias("taken")))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weight: Callable[[Column], Column] = cyclic_weight, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``df`` as the mix takes them: left out, once, or repeated; all its columns.

    A source's boundary document also gives a row with its leading words, joined by single
    spaces. A document without words is repeated with its source and costs nothing. Null
    texts and sources are kept as such. Repeated rows count each for itself; those that share
    the boundary's id are cut alike. Reruns agree. No input gives no rows.
    """
    sized = stored(sizes(df, id_col, source_col, text_col), "sizes")
    note, copy = free(df, "_mix", "_copy")
    sources = plan(sized, weight, max_epochs, seed).select(
        F.struct("source", "whole", "edge_draw", "edge_id", "edge_part").alias(note))
    joined = df.join(small(sources, "mix"), F.col(source_col).eqNullSafe(F.col(f"{note}.source")))
    ahead, same = _place(id_col, seed, f"{note}.")
    lead = F.array_join(F.slice(F.regexp_extract_all(
        F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(f"{note}.edge_part").cast("int")), " ")
    copies = F.array_repeat(F.col(text_col), F.col(f"{note}.whole").cast("int") + ahead.cast("int"))
    rows = F.when(same, F.concat(copies, F.array(lead))).otherwise(copies)
    return (joined.withColumn(copy, F.explode(rows))
            .select(*[F.col(copy).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]))
