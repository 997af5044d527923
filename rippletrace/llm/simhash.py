"""SimHash near-duplicates through BK-trees.

A fingerprint of 64 bits is cut into ``blocks`` parts. Two fingerprints within the radius
agree on at least ``blocks - radius`` whole parts, so every choice of that many parts
names a shard, and a fingerprint visits only the shards of its own parts: no link is lost.
Each shard is one BK-tree (children keyed by their integer Hamming distance to the parent)
that all members search at once, along the edges within the radius.

A tree lives in the task of its shard instead of being broadcast, because the trees
together grow with the corpus. A subtree that already belongs to the searcher's component
is not entered, so a shard of many near copies costs little more than its size; a very
large shard is split into chunks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import materialize, stored

from .common import annotate, free
from .graph import components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of a shard beyond which it is split into chunks that meet in pairs.
CHUNK = 40_000
#: Members expected in a shard; finer parts are chosen when there would be more.
SHARD = 256
_BUFFER = 30_000
_QUERIES = 4096


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, repeats included; 0 for no words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    n = max(len(tokens) - size + 1, 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at:at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number; a null text counts as empty (0)."""
    def setup():
        def work(texts: list[str]):
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            return [found.view(np.int64)]
        return work

    return annotate(df, text_col, f"{out_col} long", setup, keep_text)


class Forest:
    """BK-trees over the members of several shards, grown and searched level by level."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """``shard`` is sorted; the values inside a shard differ."""
        n = len(value)
        self.value = value
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        self.levels: list[np.ndarray] = []
        # a node is named by the member that it holds
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):
            key = at * (BITS + 1) + np.bitwise_count(value[item] ^ value[at])
            order = np.argsort(key, kind="stable")
            item, key = item[order], key[order]
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            node = item[lead]
            self.parent[node], self.edge[node] = np.divmod(key[lead], BITS + 1)
            self.levels.append(node)
            at = node[np.cumsum(lead) - 1][~lead]
            item = item[~lead]
        inner = np.flatnonzero(self.parent >= 0)
        keys = self.parent[inner] * (BITS + 1) + self.edge[inner]
        order = np.argsort(keys, kind="stable")
        self.child, self.child_key = inner[order], keys[order]

    def link(self, radius: int) -> np.ndarray:
        """For each member the first member of its component inside its shard."""
        label = np.arange(len(self.value))
        low, high = self._span(label)
        for start in range(0, len(label), _QUERIES):
            query = np.arange(start, min(start + _QUERIES, len(label)))
            node = self.root[query]
            while len(query):
                open_ = (low[node] != high[node]) | (low[node] != label[query])
                query, node = query[open_], node[open_]
                distance = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
                near = distance <= radius
                if self._unite(label, query[near], node[near]):
                    low, high = self._span(label)
                base = node * (BITS + 1)
                begin = np.searchsorted(self.child_key, base + np.maximum(distance - radius, 1))
                end = np.searchsorted(self.child_key, base + np.minimum(distance + radius, BITS), side="right")
                count = end - begin
                query = np.repeat(query, count)
                ends = np.cumsum(count)
                node = self.child[np.arange(len(query)) + np.repeat(begin - ends + count, count)]
        return label

    def _span(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label in each subtree."""
        low, high = label.copy(), label.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return low, high

    @staticmethod
    def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                return changed
            changed = True
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            least = np.minimum(la, lb)
            np.minimum.at(label, la, least)
            np.minimum.at(label, lb, least)
            while (label[label] != label).any():
                label[:] = label[label]


def _parts(n: int, radius: int) -> int:
    """Blocks of a fingerprint so that a shard of ``n`` evenly spread ones has about ``SHARD``."""
    for blocks in range(radius + 1, radius + 5):
        if n <= SHARD << (BITS * (blocks - radius) // blocks):
            return blocks
    return radius + 5


def _shards(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(shard, fp, rep): every fingerprint once for each choice of ``blocks - radius`` parts."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    keyed = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
                      for k, m in enumerate(masks)])
    rows = nodes.select("fp", "rep", F.explode(keyed).alias("s"))
    return rows.select(F.col("s.choice").alias("choice"), F.col("s.part").alias("part"), "fp", "rep")


def _in_chunks(rows: DataFrame) -> DataFrame:
    """Add ``chunk``: 0, or for members of an oversized shard each pair of chunks they belong to."""
    crowded = (rows.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
               .select("choice", "part", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    crowded, many = materialize(crowded, "crowded")
    if not many:
        return rows.withColumn("chunk", F.lit(0))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda k: (F.least(k, own) * F.col("chunks") + F.greatest(k, own)).cast("int"))
    joined = rows.join(crowded, ["choice", "part"], "left")
    return joined.withColumn("chunk", F.explode(F.coalesce(pairs, F.array(F.lit(0))))).drop("chunks")


def _link_shards(radius: int, chain: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked() -> Iterator[pa.RecordBatch]:
            shard, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            label = Forest(shard, fp).link(radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            other = label[moved]
            if chain:
                order = np.argsort(label, kind="stable")
                before = np.zeros(len(label), np.int64)
                before[order[1:]] = order[:-1]
                other = before[moved]
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[other])], ["a", "b"])

        size, serial, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "part", "chunk")])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = last is None or (keys[:, 0] != last).any()
            last = keys[:, -1]
            shard = serial + np.cumsum(new)
            serial = int(shard[-1])
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rep = batch.column("rep").to_numpy()
            # the buffer is linked where a shard begins once it is full
            begins = np.flatnonzero(new)
            at = 0
            while at < len(fp):
                if size >= _BUFFER and new[at]:
                    yield from linked()
                    size = 0
                wanted = begins[begins >= max(at + 1, at + _BUFFER - size)]
                cut = int(wanted[0]) if len(wanted) else len(fp)
                held.append((shard[at:cut], fp[at:cut], rep[at:cut]))
                size += cut - at
                at = cut
        if held:
            yield from linked()
    return run


def links(nodes: DataFrame, radius: int = RADIUS, n: int | None = None, chain: bool = False) -> DataFrame:
    """(a, b): reps of distinct fingerprints tied together inside a shard, a forest per shard.

    ``nodes`` has distinct ``fp`` and their ``rep``; null reps take no part. Members of a component
    are tied to its first one, or each to the one before it (``chain``), so that none is in all pairs.
    """
    known = nodes.where(F.col("rep").isNotNull())
    rows = _in_chunks(_shards(known, _parts(known.count() if n is None else n, radius), radius))
    dealt = rows.repartition("choice", "part", "chunk").sortWithinPartitions("choice", "part", "chunk", "fp")
    return dealt.mapInArrow(_link_shards(radius, chain), "a long, b long").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component) for every row: component is the smallest id reachable over links.

    Equal fingerprints are one node (copies combine before the shuffle), so a group of any
    number of copies is one tree member. Null and empty texts have fingerprint 0 and link
    like any other. A row with a null id links like any other and takes its group's component,
    but lends no name; a group of null ids alone has component null. Repeated
    rows stay. Other columns of ``df`` are not handed on. No input gives no rows.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    each = stored(fingerprints(source, "body", "fp", keep_text=False), "fingerprints")
    nodes, n = materialize(each.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    # a fingerprint stands for itself, so that one without an id still links the others
    named = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius, n))
    whole = (nodes.join(named.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", F.coalesce("component", "fp").alias("part"), "least"))
    least = whole.groupBy("part").agg(F.min("least").alias("component"))
    moved = whole.select("fp", "part").join(least, "part").select("fp", "component")
    return each.join(moved, "fp").select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` whose id names their group: one document of each group stays.

    Of rows with the same id one stays. Rows with a null id cannot be named and all stay.
    All columns of ``df`` are handed on.
    """
    whole = groups(df, id_col, text_col, radius)
    stays, = free(df, "_stays")
    ids = whole.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(stays))
    kept = df.join(ids, F.col(id_col) == F.col(stays), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(df.where(F.col(id_col).isNull()))
