"""One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

Two ways name the sets of shingles that may have a partner, and none is left out by a count:

- SimHash fingerprints of the shingles that BK-trees find within ``simhash.RADIUS`` bits. Their
  links join most near copies at once; there are fewer of them than fingerprints.
- MinHash: ``BANDS`` keys, each of ``ROWS`` minima, for what lies beyond the radius. A pair at 0.8
  shares none of them once in about 14,000, a closer one less often.

The sets so named are then joined exactly by their rarest shingles. In any fixed order of the
shingles two sets alike by 0.8 share one of the first fifth (and one) of each, so only those are
shuffled, each with the size of its set and its place. Rare ones come first, by a table of
counts of fixed size, so what many documents share (a licence, a common passage) is seldom among
them. Members of a shingle meet in rounds of growing distance; a pair is passed over if sizes
or places show that it can't reach 0.8, if both are in one component, or if it was compared before.
Every link is decided by the exact Jaccard similarity of the two sets. Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import Rounds, materialize, stored

from . import simhash
from .common import annotate, free, give_back
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
SEED = 42
#: Pairs of a round, or sets to fetch, up to which they are broadcast (3 MB).
BROADCAST_PAIRS = 100_000
#: Counters of the table of shingle counts: 2 MB, whatever the corpus.
COUNTERS = 1 << 18
#: Members of a shingle beyond which they are split into chunks that meet in pairs.
CROWD = 50_000
_CHUNK = 2048
_EMIT = 100_000
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole for fewer words, none for no words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    n = max(len(tokens) - size + 1, 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def band_keys(found: np.ndarray) -> list[int]:
    """One key per band, as signed numbers; none for an empty set."""
    if not len(found):
        return []
    low = found.astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), _CHUNK):
        np.minimum(least, (_MULTIPLIERS[:, None] * low[None, at:at + _CHUNK]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.fromiter((xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)), np.uint64, BANDS)
    return keys.view(np.int64).tolist()


def _sketch():
    def work(texts: list[str]):
        found = [shingles(t) for t in texts]
        nodes = np.fromiter((xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found), np.uint64, len(found))
        fps = np.fromiter(map(simhash.majority, found), np.uint64, len(found))
        return [nodes.view(np.int64), [band_keys(f) for f in found], fps.view(np.int64)]
    return work


def _sets():
    return lambda texts: [[shingles(t).view(np.int64) for t in texts]]


def _counted(sets: DataFrame):
    """How many sets hold the shingles of each counter, put together by the executors; broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = batch.column("sh").flatten().to_numpy() & (COUNTERS - 1)
            total += np.bincount(found, minlength=COUNTERS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])
        give_back()

    slots = sets.select("sh").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    slots = None
    give_back()
    return sets.sparkSession.sparkContext.broadcast(counts)


def rarest(found: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles of a set of which every set alike by ``threshold`` has one among its own such."""
    order = np.lexsort((found, counts[found & (COUNTERS - 1)]))
    return found[order[:len(found) - int(np.ceil(threshold * len(found) - 1e-9)) + 1]]


def _prefixes(counts, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("sh")
            size = np.diff(sets.offsets.to_numpy())
            flat = sets.values.to_numpy()
            first = [rarest(flat[o:o + n], counts.value, threshold) if n else flat[:0]
                     for o, n in zip(sets.offsets.to_numpy()[:-1].tolist(), size.tolist(), strict=True)]
            many = np.fromiter(map(len, first), np.int64, len(first))
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*first, flat[:0]])), pa.array(np.repeat(batch.column("node").to_numpy(), many)),
                pa.array(np.repeat(size, many).astype(np.int32)), pa.array(place.astype(np.int32))],
                ["key", "node", "size", "place"])
        batch = sets = flat = first = None
        give_back()
    return run


def _across(key: np.ndarray, node: np.ndarray, part: np.ndarray, size: np.ndarray, place: np.ndarray,
            first: int, last: int, threshold: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a key, ``first`` to ``last`` positions apart, whose components (``part``) differ.

    ``key`` is sorted. Only members outside their key's largest component look for partners.
    Pairs go if what their sets can still share from these places on is too little for ``threshold``:
    at the first shingle that two sets share this is all that they share.
    """
    n = len(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, n))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((part, bucket))
    runs = np.flatnonzero(np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (part[order][1:] != part[order][:-1])]))
    lengths = np.diff(np.append(runs, n))
    of = bucket[order][runs]
    # the last run of each key by length is its largest component
    ranked = np.lexsort((lengths, of))
    largest = ranked[np.append(np.flatnonzero(np.diff(of[ranked])), len(ranked) - 1)]
    minor = part != part[order][runs[largest]][bucket]
    here = np.flatnonzero(minor)
    begin, end = starts[bucket[here]], (starts + sizes)[bucket[here]]
    ahead = size - place
    for apart in range(first, last + 1):
        up, down = here + apart < end, here - apart >= begin
        some = up | down
        if not some.any():
            return
        if not some.all():
            here, begin, end, up, down = here[some], begin[some], end[some], up[some], down[some]
        a, b = here[up], here[up] + apart
        c, d = here[down] - apart, here[down]
        a, b = np.concatenate([a, c[~minor[c]]]), np.concatenate([b, d[~minor[c]]])
        able = part[a] != part[b]
        able &= np.minimum(ahead[a], ahead[b]) * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-6
        yield node[a[able]], node[b[able]]


_COLUMNS = ("key", "node", "part", "size", "place")


def _propose(first: int, last: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for a, b in _across(*columns, first, last, threshold):
                held.append((np.minimum(a, b), np.maximum(a, b)))
                size += len(a)
                if size >= _EMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])
                    held, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])

        # what is held is the start of the last key seen, in pieces; chunks of a key are keys of their own
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy() * 31 + batch.column("chunk").to_numpy()
            new = [key] + [batch.column(c).to_numpy() for c in _COLUMNS[1:]]
            begins = np.flatnonzero(new[0][1:] != new[0][:-1]) + 1
            if held and held[-1][0][-1] != new[0][0]:
                begins = np.append(0, begins)
            if len(begins):
                cut = begins[-1]
                yield from pairs([np.concatenate(x) for x in zip(*held, [n[:cut] for n in new], strict=True)])
                held, new = [], [n[cut:] for n in new]
            held.append(new)
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])
        held = []
        give_back()
    return run


def _chunked(rows: DataFrame, most: int) -> DataFrame:
    """Add ``chunk``: 0, or for members of a crowded key each pair of chunks that they belong to.

    ``n`` is the number of members of a row's key, ``most`` the largest one.
    """
    if most <= CROWD:
        return rows.withColumn("chunk", F.lit(0))
    chunks = F.ceil(F.col("n") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks)
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: (F.least(k, own) * chunks + F.greatest(k, own)).cast("int"))
    return rows.withColumn("chunk", F.explode(pairs))


def _alike(pairs: DataFrame, n: int, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    one, two = (sets.select(F.col("node").alias(c), F.col("sh").alias(f"s{c}")) for c in "ab")
    # few pairs go to the sets, so that only theirs are shuffled
    both = (one.join(F.broadcast(pairs), "a").join(two.join(F.broadcast(pairs), "b"), ["a", "b"])
            if n <= BROADCAST_PAIRS else pairs.join(one, "a").join(two, "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def links(sets: DataFrame, first_pairs: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, component) over links of at least ``threshold`` between the sets; None without any.

    ``sets`` has (node, sh), the distinct shingles of each node. ``first_pairs`` (a, b) are compared
    before all others, so that what they join need not meet again. Sets without shingles join nothing.
    """
    named = compared = None

    def compare(pairs: DataFrame, n: int) -> int:
        nonlocal named, compared
        near, new = materialize(_alike(pairs, n, sets, threshold), "near")
        compared = pairs if compared is None else compared.unionByName(pairs)
        if new:
            tied = near if named is None else near.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
            named = components(tied)
        return new

    if first_pairs is not None:
        pairs, n = materialize(first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
        if n:
            compare(pairs, n)
    rows = stored(sets.mapInArrow(_prefixes(_counted(sets), threshold), "key long, node long, size int, place int"), "prefixes")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rounds = Rounds("open")
    left, most = rounds.write(rows.join(shared, "key", "left_semi"))
    new, first, last = 1, 1, 1
    while most:
        parted = left.drop("n")
        if new:
            part = F.col("node") if named is None else F.coalesce("component", "node")
            parted = parted.drop("part") if named is None else parted.drop("part").join(named, "node", "left")
            parted = parted.withColumn("part", part).drop("component")
        # keys of one component, and those whose members have all met, are done
        open_ = parted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
        open_ = open_.where((F.col("low") < F.col("high")) & (F.col("n") > first)).select("key", "n")
        left, most = rounds.write(parted.join(open_, "key").select(*_COLUMNS, "n"), F.max("n"))
        if not most:
            break
        dealt = _chunked(left, most).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "size", "node")
        met = dealt.mapInArrow(_propose(first, last, threshold), "a long, b long").distinct()
        if compared is not None:
            met = met.join(compared, ["a", "b"], "left_anti")
        met, m = materialize(met, "met")
        new = compare(met, m) if m else 0
        first, last = last + 1, 4 * last + 1
    return named


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, all columns handed on.

    Words are lower-cased in ASCII. Texts with equal sets of shingles are copies; so are all without
    words and null ones. A group's row has a null id only if all of its rows do. Of several rows with
    the smallest id the one with the smallest hash of its text stays, once. No input gives no rows.
    """
    mark, of = free(df, "_mark", "_of")
    text_hash = F.xxhash64(F.col(text_col))
    source = df.select(F.col(id_col).alias("id"), text_hash.alias("mark"), F.col(text_col).alias("body"))
    each = stored(annotate(source, "body", "node long, keys array<long>, fp long", _sketch, keep_text=False), "sketches")
    lead = F.struct(F.col("id").isNull().alias("nameless"), "id", "mark")
    nodes = stored(each.groupBy("node").agg(F.min(lead).alias("lead"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "nodes")
    worded = nodes.where(F.size("keys") > 0)
    trees = stored(simhash.links(worded.groupBy("fp").agg(F.min("node").alias("rep")), chain=True), "trees")
    buckets = worded.select(F.explode("keys").alias("key"), "node")
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    some = (buckets.join(crowded, "key", "left_semi").select("node")
            .unionByName(trees.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    need, n = materialize(some.join(nodes, "node").select(
        "node", F.col("lead.id").alias("of"), F.col("lead.mark").alias("of_mark")), "need")
    # the texts themselves travel only if many are asked for
    asked = F.broadcast(need) if n <= BROADCAST_PAIRS else need
    texts = (source.join(asked, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of")))
             .select("node", "body"))
    sets = stored(annotate(texts, "body", "sh array<long>", _sets, keep_text=False).dropDuplicates(["node"]), "sets")
    named = links(sets, trees, threshold)
    grouped = nodes.select("node", "lead") if named is None else nodes.join(named, "node", "left").select(
        F.coalesce("component", "node").alias("node"), "lead")
    stays = grouped.groupBy("node").agg(F.min("lead").alias("lead")).select(
        F.struct(F.col("lead.id").alias("id"), F.col("lead.mark").alias("mark")).alias(of))
    marked = df.withColumn(mark, text_hash)
    same = (F.col(mark) == F.col(f"{of}.mark")) & F.col(id_col).eqNullSafe(F.col(f"{of}.id"))
    return marked.join(stays, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
