"""A supervised classifier on subword embeddings.

A text is the average of learned vectors: one per word, per pair of neighbouring words and
per character n-gram of a word, found by hashing into a fixed number of buckets. A softmax
over two classes reads the average. Vectors and output are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. A trained model is one
number per bucket (the output applied to its vector), so it has a fixed size whatever the
corpus, and scoring is a sum over a text's features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.plans.durable import stored

from .common import annotate, give_back, words

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (3, 4, 5)
#: Labelled rows to train on: the bound of what reaches the driver, chosen by a hash of the id.
SAMPLE_ROWS = 3000
#: Bytes of their bucket counts that reach the driver; beyond this the sample ends earlier.
SAMPLE_BYTES = 128 << 20
#: Passes over the sample: more where it is small.
EPOCHS, UPDATES = (6, 30), 20_000
#: Distinct words that a task remembers between blocks.
MEMO = 150_000

#: Buckets travel as 16-bit numbers around zero.
_HALF = BUCKETS // 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: The pair of a word with itself is one feature for all words.
_TWIN = 1
#: A pair of words weighs as much as the n-grams of a word do together, about.
_PAIR_WEIGHT = 6


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * _MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _PAIR) >> np.uint64(48)).astype(np.int64) % (BUCKETS - 2) + 2


class Features:
    """Buckets of words, each worked out once while it is remembered."""

    class _Codes(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = code = len(self)
            return code

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.code = self._Codes()
        self.hash = np.zeros(0, np.uint64)
        self.flat = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word codes of all texts in one array, and the number of words of each text."""
        if len(self.code) > MEMO:
            self.forget()
        code = self.code.__getitem__
        per_text = [list(map(code, words(t))) for t in texts]
        self._learn()
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        codes = np.fromiter((c for p in per_text for c in p), np.int64, int(counts.sum()))
        return codes, counts

    def _learn(self) -> None:
        known = len(self.size)
        fresh = list(self.code)[known:]
        if not fresh:
            return
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in fresh), np.uint64, len(fresh))
        text = np.frombuffer(b"".join(b"<" + w + b">" for w in fresh), np.uint8).astype(np.uint64) + np.uint64(1)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 2
        owner = np.repeat(np.arange(len(fresh)), lengths)
        buckets, owners = [_bucket(hashes)], [np.arange(len(fresh))]
        for n in GRAMS:
            if len(text) < n:
                continue
            gram = np.full(len(text) - n + 1, n, np.uint64)
            for k in range(n):
                gram = gram * _MIX + text[k:len(text) - n + 1 + k]
            inside = owner[:len(gram)] == owner[n - 1:]
            buckets.append(_bucket(gram[inside]))
            owners.append(owner[:len(gram)][inside])
        of = np.concatenate(owners)
        order = np.argsort(of, kind="stable")
        self.flat = np.concatenate([self.flat, np.concatenate(buckets)[order].astype(np.int32)])
        self.size = np.concatenate([self.size, np.bincount(of, minlength=len(fresh))])
        self.hash = np.concatenate([self.hash, hashes])

    def pairs(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word with the one before it; False where that is another text's."""
        h = self.hash[codes]
        bucket = np.where(h[1:] == h[:-1], _TWIN, _bucket(h[:-1] * _PAIR + h[1:]))
        same = np.ones(len(bucket), bool)
        starts = np.cumsum(counts)[:-1]
        same[starts[(starts > 0) & (starts < len(codes))] - 1] = False
        return bucket, same


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, features: Features, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without words has that of the training labels."""
        codes, counts = features.read(texts)
        edges = np.concatenate([[0], np.cumsum(counts)])
        word_edges = np.concatenate([[0], np.cumsum(features.size)])
        per_word = np.diff(np.concatenate([[0.0], np.cumsum(self.weight[features.flat].astype(np.float64))])[word_edges])
        value, number = per_word[codes], features.size[codes].astype(np.float64)
        if len(codes) > 1:
            bucket, same = features.pairs(codes, counts)
            value[1:] += np.where(same, _PAIR_WEIGHT * self.weight[bucket], 0)
            number[1:] += _PAIR_WEIGHT * same
        total = np.diff(np.concatenate([[0.0], np.cumsum(value)])[edges])
        n = np.diff(np.concatenate([[0.0], np.cumsum(number)])[edges])
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -50, 50)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7, rate: float = 0.3) -> Model:
    """Fit vectors and output to (buckets, counts, label) rows; the same rows give the same model.

    Without rows, or with one class only, the model is the constant share of label 1.
    """
    share = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    prior = float(np.log(share / (1 - share)))
    if len({r[2] for r in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = draw.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    seen_v = np.full(BUCKETS, 1e-6, np.float32)
    seen_o = np.full((DIMENSIONS, 2), 1e-3, np.float32)
    epochs = min(max(EPOCHS[0], UPDATES // len(rows)), EPOCHS[1])
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for r in draw.permutation(len(rows)):
            buckets, counts, label = rows[r]
            if not len(buckets):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[buckets]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            slope = np.outer(mean, p)
            seen_o += slope * slope
            seen_v[buckets] += part * part * float(back @ back)
            step = pace * part / np.sqrt(seen_v[buckets])
            output -= pace * 0.3 * slope / np.sqrt(seen_o)
            bias -= 0.02 * p
            vectors[buckets] -= np.outer(step, back)
    tell = output[:, 1] - output[:, 0]
    return Model(vectors @ tell, float(bias[1] - bias[0]))


def _counted(df: DataFrame, text_col: str) -> DataFrame:
    """Add each text's distinct ``buckets`` with their ``counts``, at most ``BUCKETS`` of them."""
    def setup():
        features = Features()

        def work(texts: list[str]):
            out_b, out_c = [], []
            codes, counts = features.read(texts)
            starts = np.concatenate([[0], np.cumsum(features.size)])
            ends = np.cumsum(counts)
            pairs, same = features.pairs(codes, counts) if len(codes) > 1 else (np.zeros(0, np.int64),) * 2
            for end, n in zip(ends, counts, strict=True):
                number, times = np.unique(codes[end - n:end], return_counts=True)
                own = [features.flat[starts[c]:starts[c + 1]] for c in number]
                weight = np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64),
                                     np.repeat(times, features.size[number]), BUCKETS)
                inner = pairs[end - n:max(end - n, end - 1)]
                weight += _PAIR_WEIGHT * np.bincount(inner, minlength=BUCKETS)
                there = np.flatnonzero(weight)
                out_b.append((there - _HALF).astype(np.int16))
                out_c.append(weight[there].astype(np.float32))
            return out_b, out_c
        return work

    return annotate(df, text_col, "buckets array<smallint>, counts array<float>", setup, keep_text=False)


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, label_col: str = "quality",
        id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents for which ``trusted`` (a condition on the id) holds.

    The sample is the ids with the smallest hashes, as many as ``rows`` and ``SAMPLE_BYTES`` allow, so
    it is the same in every run. Ids and labels are bounded by ``rows`` and broadcast; the texts
    become bucket counts on the executors. A null label is none; an id labelled twice has the larger
    label; of several documents with one id the one with the smallest hash of its counts is learned.
    """
    place = F.xxhash64(F.col(id_col).cast("string"))
    bounded = (labels.where(trusted & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
               .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
               .orderBy(place, id_col).limit(rows))
    texts = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(bounded), id_col)
    row = F.struct(F.xxhash64("buckets", "counts").alias("order"), "_label", "buckets", "counts")
    sample = stored(_counted(texts, text_col).groupBy(id_col).agg(F.min(row).alias("row"))
                    .select(F.col(id_col).alias("id"), place.alias("place"), "row.*"), "sample")
    sizes = sample.select("id", "place", F.size("buckets").alias("n")).orderBy("place", "id").collect()
    total, enough = 0, 0
    for r in sizes:
        total += 6 * r.n
        enough += total <= SAMPLE_BYTES
    some = sample if enough == len(sizes) else sample.where(F.col("id").isin([r.id for r in sizes[:enough]]))
    got = some.toArrow().sort_by("id")
    learned = [(b.values.to_numpy().astype(np.int32) + _HALF, c.values.to_numpy(), label) for b, c, label in
               zip(got["buckets"], got["counts"], got["_label"].to_pylist(), strict=True)]
    model = train(learned)
    got = learned = None
    give_back()
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1, from the whole text alone. No shuffle.

    A null or empty text has the probability that the model's bias gives. Rows stay as they are,
    repeated ones and null ids too; no rows give no rows. A column with the name of the score is
    replaced, others are handed on.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def setup():
        features, own = Features(), Model(*shared.value)
        return lambda texts: [own.scores(features, texts)]

    return annotate(df, text_col, f"{score_col} double", setup)
