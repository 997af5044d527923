"""Removal of passages that an earlier document already has: seed and extend.

Seeds are winnowed anchors: of every ``length`` words, the run of ``GRAM`` words with the
smallest hash. Two documents that share ``length`` words share the anchor of each such
window, so joining on anchors loses no match. An anchor is extended both ways to the
widest span of windows around it and compared with that of the first document that has it:
an equal span is a match to its ends. Where spans differ, the exact ends lie inside, and
the windows of these spans alone are compared with each other. What neighbouring windows
remove joins into maximal repeats.

Nothing is paired: a passage that a third of all documents share costs a row per
occurrence, aggregated before it is shuffled. Documents with the same words throughout are
settled by their hash first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import stored

from .common import annotate, blocks, words

LENGTH = 50
GRAM = 10
#: Distinct words that a task remembers.
MEMO = 400_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPREAD = np.uint64(0x7FB5D329728EA185)
_SIDES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_EMPTY = hashlib.sha256(b"").digest()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Spans:
    """Hashes of word runs of one text at a time, by prefix sums modulo 2^64."""

    def __init__(self, length: int):
        self.length = length
        self.memo = _Hashes()
        self.powers = [np.ones(1, np.uint64) for _ in range(4)]

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            size = max(4096, 2 * n)
            for k, base in enumerate(_BASES):
                for j, b in ((k, base), (k + 2, pow(base, -1, 1 << 64))):
                    steps = np.full(size, np.uint64(b))
                    steps[0] = 1
                    self.powers[j] = np.multiply.accumulate(steps)

    def read(self, tokens: list[bytes]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.n = n = len(tokens)
        self._grow(n)
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[k][:n])]) for k in (0, 1)]

    def run(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return (self.sums[which][end] - self.sums[which][start]) * self.powers[which + 2][start]

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * _SPREAD
        return x ^ (x >> np.uint64(27))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``length`` words the place of its anchor; and the hash of the run at every place."""
        grams = np.arange(max(self.n - GRAM + 1, 0))
        hashes = self.mixed(self.run(grams, grams + GRAM))
        if self.n < self.length:
            return np.zeros(0, np.int64), hashes
        wide = np.lib.stride_tricks.sliding_window_view(hashes, self.length - GRAM + 1)
        return wide.argmin(axis=1) + np.arange(len(wide)), hashes

    def extended(self, places: np.ndarray) -> np.ndarray:
        """Hash of all windows around an anchor at once: as far as they reach, or the text does."""
        reach = self.length - GRAM
        left = np.minimum(places, reach)
        right = np.minimum(self.n - places - GRAM, reach)
        whole = self.run(places - left, places + GRAM + right)
        return self.mixed(whole + left.astype(np.uint64) * _SIDES[0] + right.astype(np.uint64) * _SIDES[1])

    def windows(self, which: int) -> np.ndarray:
        at = np.arange(max(self.n - self.length + 1, 0))
        return self.mixed(self.run(at, at + self.length, which))


def _seeds(length: int):
    def setup():
        spans = Spans(length)

        def work(texts: list[str]):
            out: list[list] = [[], [], [], [], []]
            for text in texts:
                tokens = words(text)
                joined = b" ".join(tokens)
                spans.read(tokens)
                own, hashes = spans.anchors()
                places = np.unique(own)
                row = (len(tokens), xxhash.xxh128_digest(joined), hashlib.sha256(joined).digest(),
                       hashes[places].view(np.int64), spans.extended(places).view(np.int64))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return work
    return setup


def _flags(spans: Spans, notes: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its anchor's span is an earlier document's; it has to be compared itself."""
    own, hashes = spans.anchors()
    if not len(own) or not notes:
        return np.zeros(len(own), bool), np.zeros(len(own), bool)
    notes = sorted(notes, key=lambda x: x["anchor"])
    known = np.array([x["anchor"] for x in notes], np.int64)
    first = np.array([x["first_span"] or 0 for x in notes], np.int64)
    later = np.array([x["first_span"] is not None for x in notes])
    mixed = np.array([x["mixed"] for x in notes])
    places, back = np.unique(own, return_inverse=True)
    anchor = hashes[places].view(np.int64)
    at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
    there = known[at] == anchor
    settled = there & later[at] & (spans.extended(places).view(np.int64) == first[at])
    return settled[back], (there & mixed[at] & ~settled)[back]


def _texts(length: int, finish):
    """A pass over (id, body, seqs, notes, ...): ``finish`` gets spans, tokens, flags and the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(length)
        for batch in batches:
            rest = batch.drop_columns(["body"])
            for start, end, texts in blocks(batch.column("body")):
                rows = rest.slice(start, end - start).to_pylist()
                for text, row in zip(texts, rows, strict=True):
                    tokens = words(text)
                    if xxhash.xxh128_digest(b" ".join(tokens)) not in row["seqs"]:
                        continue
                    spans.read(tokens)
                    yield finish(spans, tokens, *_flags(spans, row["notes"]), row)
    return run


def _window_rows(spans, tokens, settled, asked, row) -> pa.RecordBatch:
    at = np.flatnonzero(asked)
    first, second = (spans.windows(k)[at].view(np.int64) for k in (0, 1))
    _, once = np.unique(first, return_index=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(first[once]), pa.array(second[once]), pa.array(np.full(len(once), row["id"], np.int64))], ["w1", "w2", "id"])


def _result_row(spans, tokens, settled, asked, row) -> pa.RecordBatch:
    gone = settled
    if row["later"]:
        gone = gone | (asked & np.isin(spans.windows(0).view(np.int64), np.array(row["later"], np.int64)))
    edge = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(gone)
    edge[at] += 1
    np.add.at(edge, at + spans.length, -1)
    covered = np.cumsum(edge[:-1]) > 0
    kept = b" ".join(t for t, c in zip(tokens, covered.tolist(), strict=True) if not c)
    return pa.RecordBatch.from_arrays(
        [pa.array([row["id"]]), pa.array([len(tokens)], pa.int64()), pa.array([int(covered.sum())], pa.int64()),
         pa.array([kept.decode("utf-8", "surrogatepass")])], ["id", "n_words", "n_removed", "kept"])


def _tables(df: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Every row without its text, and the texts that share an anchor with another document."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    seeds = annotate(source, "body", "n_words long, seq binary, whole binary, anchors array<long>, around array<long>",
                     _seeds(length), keep_text=False)
    rows = stored(seeds, "seeds")
    # stored, so that the joins with it can split the sequence that a third of all rows may share
    lead = stored(rows.where(F.col("id").isNotNull()).groupBy("seq").agg(F.min("id").alias("lead")), "leads")
    each = stored(rows.drop("anchors", "around").join(lead, "seq", "left"), "rows")
    first_rows = (rows.select("seq", "id", F.arrays_zip("anchors", "around").alias("z")).where(F.size("z") > 0)
                  .join(lead.withColumnRenamed("lead", "id"), ["seq", "id"], "left_semi"))
    occurs = first_rows.select("id", F.explode("z").alias("z")).select(
        F.col("z.anchors").alias("anchor"), "id", F.col("z.around").alias("span"))
    shared = (occurs.groupBy("anchor").agg(
        F.min(F.struct("id", "span")).alias("first"), F.max("id").alias("last"),
        (F.min("span") != F.max("span")).alias("mixed"))
        .where(F.col("last") > F.col("first.id")).select("anchor", "first", "mixed"))
    noted = occurs.select("anchor", "id").join(stored(shared, "shared"), "anchor")
    note = F.struct("anchor", F.when(F.col("id") > F.col("first.id"), F.col("first.span")).alias("first_span"), "mixed")
    notes = noted.select("id", note.alias("note")).groupBy("id").agg(F.collect_set("note").alias("notes"))
    seqs = each.where(F.col("id") == F.col("lead")).groupBy("id").agg(F.collect_set("seq").alias("seqs"))
    asked = notes.join(seqs, "id")
    texts = source.join(asked, "id")
    return each, stored(texts, "texts")


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of the texts that share an anchor."""
    rows = texts.mapInArrow(_texts(length, _window_rows), "w1 long, w2 long, id long")
    windows = stored(rows, "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    later = (windows.join(first, ["w1", "w2"]).where(F.col("id") > F.col("first"))
             .groupBy("id").agg(F.collect_set("w1").alias("later")))
    return texts.join(later, "id", "left").mapInArrow(
        _texts(length, _result_row), "id long, n_words long, n_removed long, kept string")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: words covered by a run of ``length``
    words that also starts in a document with a smaller id.

    All is judged on the input. Copies of a whole text lose everything when they are long
    enough. Null and empty texts have no words. Rows with a null id neither lose words nor
    take any from others; rows with the same id are one document, so they do not repeat each
    other. Other columns are not handed on; no input gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    each, texts = _tables(df, id_col, text_col, length)
    found = _removed(texts, length).select(
        F.col("id").alias(id_col), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    copy = F.coalesce(F.col("id") > F.col("lead"), F.lit(False))
    through = copy & (F.col("n_words") >= length)
    pending = texts.select("id").distinct()
    plain = (each.where(copy).unionByName(each.where(~copy).join(pending, "id", "left_anti"))
             .select(F.col("id").alias(id_col), "n_words",
                     F.when(through, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
                     F.lower(F.hex(F.when(through, F.lit(_EMPTY)).otherwise(F.col("whole")))).alias("kept_sha256")))
    return plain.unionByName(found)
