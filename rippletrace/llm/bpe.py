"""Byte-level BPE by merge replay.

A block of documents is split into pieces; the distinct words of its new pieces are the
corpus of the replay. An inverted index leads from a token pair (named by the rank of its
merge) to the positions where it stands, and the merges are applied in rank order, each
touching only the neighbours of what it joined. A word is merged once, however often it
occurs. Words are independent, so blocks give the same ids as one corpus would.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import blocks, give_back

#: Pieces whose ids a task remembers between blocks.
MEMO = 350_000
#: A rank file is sent to every executor; beyond this size it isn't a vocabulary.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        raw = lines.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    pairs = (line.split() for line in raw.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks with all pairs of tokens whose bytes together are a token; made once, then broadcast."""

    def __init__(self, ranks: dict[bytes, int], single: np.ndarray, keys: np.ndarray, merged: np.ndarray):
        self.ranks, self.single, self.keys, self.merged = ranks, single, keys, merged

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        keys, merged = np.array([*keys, 1 << 62], np.int64), np.array([*merged, -1], np.int64)
        order = np.argsort(keys)
        return cls(ranks, np.array(single, np.int64), keys[order], merged[order])

    def parts(self) -> tuple:
        return self.ranks, self.single, self.keys, self.merged

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens, -1 if there is none or a token is negative."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], -1)


class Replay:
    """Merges of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def encode(self, corpus: list[bytes]) -> list[list[int]]:
        """Ids of each word of a corpus of distinct words."""
        ranks = self.vocabulary.ranks
        out: list = [None] * len(corpus)
        rest = []
        for k, word in enumerate(corpus):
            rank = ranks.get(word)
            if rank is not None:
                out[k] = [rank]
            elif word:
                rest.append(k)
            else:
                out[k] = []
        if rest:
            # every word stands before a separator, -1
            sizes = np.fromiter((len(corpus[k]) for k in rest), np.int64, len(rest))
            ends = np.cumsum(sizes + 1)
            token = np.full(int(ends[-1]), -1, np.int64)
            inside = np.ones(len(token), bool)
            inside[ends - 1] = False
            token[inside] = self.vocabulary.single[np.frombuffer(b"".join(corpus[k] for k in rest), np.uint8)]
            self._merge(token)
            left = token >= 0
            flat = token[left].tolist()
            at = 0
            for k, n in zip(rest, np.add.reduceat(left, ends - sizes - 1).tolist(), strict=True):
                out[k] = flat[at:at + n]
                at += n
        return out

    def _merge(self, token: np.ndarray) -> None:
        """Replay all merges in place, lowest rank first; joined positions become -2.

        A merge is applied to all its words at once, and within a word from left to right.
        When it makes an earlier or the same merge possible, the word's other spots wait.
        """
        n = len(token)
        pairs = self.vocabulary.pairs
        word = np.cumsum(token == -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        at_hand = np.full(n, -1, np.int64)  # rank of the merge that each position offers
        at_hand[:-1] = pairs(token[:-1], token[1:])
        offers = np.flatnonzero(at_hand >= 0)
        offers = offers[np.argsort(at_hand[offers], kind="stable")]
        ranks, first = np.unique(at_hand[offers], return_index=True)
        # the inverted index: positions seen at the start, and those that merges add
        given = dict(zip(ranks.tolist(), np.split(offers, first[1:]) if len(offers) else [], strict=True))
        index: dict[int, list[int]] = {rank: [] for rank in given}
        queue = list(index)
        heapq.heapify(queue)

        def offer(rank: np.ndarray, spot: np.ndarray) -> None:
            for r, p in zip(rank.tolist(), spot.tolist(), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(queue, r)

        while queue:
            rank = heapq.heappop(queue)
            spots = np.concatenate([given.pop(rank, offers[:0]), np.array(index.pop(rank), np.int64)])
            spots.sort()
            while len(spots := spots[at_hand[spots] == rank]):
                of = word[spots]
                leads = np.ones(len(spots), bool)
                leads[1:] = of[1:] != of[:-1]
                i, rest = spots[leads], spots[~leads]
                j, h = after[i], before[i]
                k = after[j]  # at worst the word's separator
                same = np.full(len(i), rank)
                right = pairs(same, token[k])
                left = pairs(np.where(h >= 0, token[h], -1), same)
                token[i], token[j] = rank, -2
                after[i], before[k] = k, i
                at_hand[i], at_hand[j] = right, -1
                inner = (h >= 0) & (token[h] >= 0)
                at_hand[h[inner]] = left[inner]
                offer(right[right >= 0], i[right >= 0])
                offer(left[left >= 0], h[left >= 0])
                if len(rest):
                    early = ((right >= 0) & (right <= rank)) | ((left >= 0) & (left <= rank))
                    if early.any():
                        waits = np.isin(word[rest], word[i[early]])
                        offer(np.full(int(waits.sum()), rank), rest[waits])
                        rest = rest[~waits]
                spots = rest


class _Pieces(dict):
    """Number of each piece, in order of first sight; those with uneven ends (white space)."""

    def __init__(self):
        self.uneven: set[int] = set()

    def __missing__(self, piece: str) -> int:
        core = piece[1:] if piece[:1] == " " else piece
        self[piece] = code = len(self)
        if not core or core[0].isspace() or core[-1].isspace():
            self.uneven.add(code)
        return code


class Encoder:
    """Ids of texts, block by block; pieces between two single spaces are looked up whole."""

    _careful = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.replay = Replay(vocabulary)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.code = _Pieces()
        self.known: dict[str, list[int]] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = self.size = np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        """The text cut before every single space between two other characters.

        No match of the pattern crosses such a place, so pieces are encoded on their own.
        """
        out, at = [], 0
        for m in self._careful.finditer(text):
            out.append(text[at:m.start()])
            at = m.start()
        out.append(text[at:])
        return out

    def _learn(self) -> None:
        """Encode the pieces that have no ids yet."""
        known = len(self.start)
        fresh = list(islice(self.code, known, None))
        found = [self.pattern.findall(p) for p in fresh]
        ids = self.known
        corpus = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in ids]
        ids.update(zip(corpus, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in corpus]), strict=True))
        per_piece = [ids[w[0]] if len(w) == 1 else [*chain.from_iterable(map(ids.__getitem__, w))] for w in found]
        size = np.fromiter(map(len, per_piece), np.int64, len(per_piece))
        flat = np.fromiter(chain.from_iterable(per_piece), np.int32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has."""
        if len(self.code) > MEMO:
            self.forget()
        per_text = []
        for text in texts:
            if not text:
                per_text.append([])
                continue
            plain = "\0" not in text
            pieces = text.replace(" ", "\0 ").split("\0") if plain else self._pieces(text)
            codes = list(map(self.code.__getitem__, pieces))
            if plain and not self.code.uneven.isdisjoint(codes):
                codes = list(map(self.code.__getitem__, self._pieces(text)))
            per_text.append(codes)
        self._learn()
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        codes = np.fromiter(chain.from_iterable(per_text), np.int64, int(counts.sum()))
        size = self.size[codes]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[codes] - ends + size, size)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[where], np.diff(edges)


def _extended(df: DataFrame, new: dict) -> tuple[list[str], StructType]:
    kept = [f for f in df.schema if f.name.lower() not in {n.lower() for n in new}]
    return [f.name for f in kept], StructType(kept + [StructField(name, kind) for name, kind in new.items()])


def _bytes(token: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(token.__getitem__, ids))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
           ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add ``ids``: each match of ``pattern`` in the whole text encoded by ``ranks``.

    With ``decoded_col`` the ids are decoded again in the same pass, into a column of bytes. Texts
    are cut before single spaces between other characters first; that is proved for the usual
    pattern, in which a space begins a match, and must hold for any other one.

    No shuffle; the vocabulary (checked to be below 64 MB) is broadcast. A null or empty
    text has no ids. Rows stay as they are, repeated ones and null ids too; no rows give no rows. A
    column named ``ids`` is replaced, others are handed on.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.of(ranks).parts())
    new = {ids_col: ArrayType(IntegerType())} | ({decoded_col: BinaryType()} if decoded_col else {})
    names, schema = _extended(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(*shared.value), pattern)
        token = {rank: token for token, rank in shared.value[0].items()}
        for batch in batches:
            for start, end, texts in blocks(batch.column(text_col)):
                gc.disable()  # many small lists without cycles
                try:
                    ids, counts = coder.encode(texts)
                finally:
                    gc.enable()
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                added = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if decoded_col:
                    edges = offsets.tolist()
                    added.append(pa.array([_bytes(token, ids[a:b].tolist()) for a, b in pairwise(edges)], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(start, end - start) for n in names] + added, [*names, *new])
        coder = token = batch = texts = ids = added = None
        give_back()

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes of the ids, which may end inside a character if the ids do.

    Null ids decode to nothing; an id outside the vocabulary is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names, schema = _extended(df, {out_col: BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            decoded = []
            for k in range(batch.num_rows):
                ids = batch.column(ids_col)[k]
                values = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                decoded.append(_bytes(token, values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(decoded, pa.binary())], [*names, out_col])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
