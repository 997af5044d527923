"""SpotSigs fingerprints, with DataFrame functions only.

A signature is a chain of content words that follows a common word: common words stand
where prose is, so chains come from the running text. A fingerprint is the set of a
text's signatures, each as a 32-bit hash; texts are alike as their sets are (Jaccard).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.plans.durable import stored

THRESHOLD = 0.8
#: Rows that one range of ids holds, about; and the most ranges, which bounds their table.
RANGE_ROWS = 500
MAX_RANGES = 40_000

# Common words of the corpus' languages, which anchor the chains.
ANCHORS = (
    "the of and to in that is was for on are with as by at be this have from or an it not he she they which said "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "la de que el en y a los del se las por un para con no una su al lo como más pero sus le ya o "
    "les et à une du est dans qui pour pas sur au ce il sont avec plus par"
).split()

_MARK = "\x01"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The distinct signatures of a text, sorted.

    Each common word (the last of a run of them) gives one chain of the two content words
    after it, fewer at the end of the text. A text without such a chain has one signature, of itself
    as a whole; so does an empty or null one.
    """
    body = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))
    ordered = sorted(set(ANCHORS), key=lambda w: (-len(w), w))
    marked = F.regexp_replace(plain, F.lit(rf"(?<![^ ])(?:{'|'.join(ordered)})(?![^ ])"), F.lit(_MARK + "$0"))
    # content words, each with the common words before it
    tokens = F.regexp_extract_all(marked, F.lit(rf"(?:{_MARK}[^ ]+ )*+[^ {_MARK}][^ ]*+"), F.lit(0))

    def chains(words: Column) -> Column:
        def chain(word: Column, at: Column) -> Column:
            follows = F.substring_index(F.get(words, at + 1), " ", -1)
            tail = F.substring_index(word, _MARK, -1)
            return F.when(F.startswith(word, F.lit(_MARK)), F.hash(tail, follows))
        return F.array_compact(F.transform(words, chain))

    found = _let(tokens, chains)
    whole = F.array(F.hash(body))
    return _let(found, lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(whole))


def digest(sigs: Column) -> Column:
    """A short name of a fingerprint: equal sets have equal ones."""
    return F.md5(F.array_join(sigs.cast("array<string>"), ","))


def written(sigs: Column) -> Column:
    """A fingerprint as text: the signatures in order, so that likeness can be told from two of them."""
    return F.array_join(sigs.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    return _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def _constants(values: list, kind: str) -> Column:
    """An array of constants, spelled as one text: Spark folds it, and a plan holds it as one node however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _ranges(ids: DataFrame) -> list[int]:
    """Boundaries that cut the ids into ranges of about ``RANGE_ROWS`` rows, at most ``MAX_RANGES``."""
    n = ids.count()
    parts = min(MAX_RANGES, n // RANGE_ROWS)
    if parts < 2:
        return []
    marks = _constants([k / parts for k in range(1, parts)], "double")
    found = ids.agg(F.percentile_approx("id", marks, F.lit(20 * parts))).first()[0]
    return sorted(set(found or []))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many boundaries are not above the value, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    heads, every = _constants(bounds[::width], "bigint"), _constants(bounds, "bigint")

    def within(top: Column) -> Column:
        group = F.slice(every, F.greatest((top - 1) * width + 1, F.lit(1)), F.lit(width))
        return F.when(value.isNull() | (top == 0), 0).otherwise(
            (top - 1) * width + F.size(F.filter(group, lambda h: h <= value)))
    return _let(F.size(F.filter(heads, lambda h: h <= value)), within)


def with_next(df: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Add ``next_<column>`` of the following row by descending id (after the last: the first).

    Rows are cut into ranges of ids; the first row of each range is also sent, as a guest, to
    the range above it. One shuffle, no task holds more than a range. Null ids come last;
    equal ids are ordered by their columns' hash, so identical rows may follow each other.
    """
    rows = df.withColumn("id", F.col(id_col).cast("long")) if id_col != "id" else df
    bounds = _ranges(rows.select("id"))
    placed = rows.withColumn("_range", _range_of(F.col("id"), bounds))
    heads = [r for r in placed.groupBy("_range").agg(F.max("id").alias("head")).orderBy("_range").collect()]
    if not heads:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    # at most MAX_RANGES rows: the range that sends, its first id, the range that gets it
    sent = [(low["_range"], low["head"], high["_range"], 0) for low, high in zip(heads, heads[1:], strict=False)]
    sent.append((heads[-1]["_range"], heads[-1]["head"], heads[0]["_range"], 1))
    guests = df.sparkSession.createDataFrame(sent, "_from int, _head long, _to int, _last int")
    visiting = (placed.join(F.broadcast(guests), (F.col("_range") == F.col("_from")) & F.col("id").eqNullSafe(F.col("_head")))
                .withColumn("_range", F.col("_to")).withColumn("_guest", F.lit(True)).drop("_from", "_head", "_to"))
    own = placed.withColumns({"_last": F.lit(0), "_guest": F.lit(False)})
    order = Window.partitionBy("_range").orderBy("_last", F.col("id").desc_nulls_last(), F.xxhash64(*columns))
    led = own.unionByName(visiting).select(
        "*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_guest")).drop("_range", "_last", "_guest")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next text.

    The edited text ends in the first half of the next text by descending id instead of its
    own second half. Fingerprints are written out (``written``), and both likenesses are those of
    the sets that they hold. Null texts count as empty; a lone row is its own next one; no rows
    give no rows. Other columns are not handed on.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    signed = base.withColumn("sigs", signatures(F.col("body")))
    n = F.length("body")
    half = F.floor(n / 2).cast("int")
    joined = with_next(signed, ["body", "sigs"])
    edited = joined.select(
        "id", n.cast("long").alias("n_chars"), "sigs", "next_sigs",
        F.concat(F.substring(F.col("body"), F.lit(1), (n - half).cast("int")),
                 F.substring(F.col("next_body"), F.lit(1), half)).alias("edited"))
    both = edited.select("id", "n_chars", "sigs", F.sha2("edited", 256).alias("edited_sha256"),
                         likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
                         _let(signatures(F.col("edited")), lambda s: F.struct(
                             written(s).alias("fingerprint"), likeness(F.col("sigs"), s).alias("near"))).alias("e"))
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("sigs")).alias("fingerprint"),
                       F.col("e.fingerprint").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), "near_next")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each id with its class of equal fingerprints, and pairs of alike classes.

    Classes are named by their smallest id and compared once, however many copies they have.
    Sets are partitioned by length so that only a partition and the one above can be alike;
    there they meet on a rare signature (as many of the rarest as an alike set cannot miss),
    lengths are checked, and the exact Jaccard decides. Null ids take no part.
    """
    signed = stored(df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), signatures(F.col(text_col)).alias("sigs")).withColumn(
            "fingerprint", digest(F.col("sigs"))), "signed")
    classes = stored(signed.groupBy("fingerprint").agg(F.min("id").alias("class"), F.first("sigs").alias("sigs")), "classes")
    members = signed.join(classes.select("fingerprint", "class"), "fingerprint").select(F.col("id").alias(id_col), "class")
    spots = classes.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ordered = (spots.join(rarity, "sig").groupBy("class", "n")
               .agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by_rarity")))
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int")
    keys = stored(ordered.select("class", "n", part.alias("part"), F.explode(F.slice("by_rarity", 1, prefix)).alias("k"))
                  .select("class", "n", "part", F.col("k.sig").alias("sig")), "prefixes")
    left = keys.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(
        F.array("part", F.col("part") + 1)).alias("part"))
    right = keys.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", "part")
    close = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = (left.join(right, ["sig", "part"]).where(close & (F.col("na") >= threshold * F.col("nb")))
           .select("a", "b").distinct())
    sets = classes.select("class", "sigs")
    judged = (met.join(sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), "a")
              .join(sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb")), "b")
              .withColumn("near", likeness(F.col("sa"), F.col("sb"))))
    pairs = judged.where(F.col("near") >= threshold).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near")
    return members, pairs
