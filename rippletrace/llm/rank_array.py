"""BPE of a byte-level tokenizer file by a contiguous rank array.

A short word holds the boundaries of its parts and, for every inner boundary, the rank of
the merge that would remove it. The smallest rank is looked for by a scan, its boundary is
deleted, and the ranks of the two neighbouring boundaries are refreshed, until no boundary
has a rank. Longer words keep the same two arrays and find the smallest rank with a heap,
because a scan for each merge would be quadratic.

A word is merged once in a task, however often it occurs; the short words that a block brings
are merged side by side, each by its own arrays. The pieces of a block between single spaces
are numbered by a dictionary and looked up as one array.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from tokenizers.pre_tokenizers import ByteLevel

from .common import blocks, give_back

#: How byte-level tokenizers part a text into words (a fixed value of the format).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which the smallest rank of a word is found by a scan; below 256, so that a boundary fits a byte.
SHORT = 128
#: Words of like length that are merged side by side, and fewest for which that pays.
BATCH, FEW = 4096, 16
#: Pieces, and characters in them, whose ids a task remembers between blocks.
MEMO = 300_000
MEMO_CHARS = 16_000_000
#: A tokenizer file is sent to every executor; beyond this size it isn't a vocabulary.
MAX_FILE_BYTES = 64 << 20
_NEVER = 1 << 60


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: a byte's own character, or the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids of tokens, ranks of merges and the strings that are one token wherever they stand."""

    def __init__(self, ids: dict[bytes, int], ranks: dict[tuple[bytes, int], int], added: dict[str, int]):
        self.ids, self.ranks, self.added = ids, ranks, added

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A tokenizer file with a byte-level BPE model and no step before the words are split."""
        with open(path, "rb") as file:
            raw = file.read(MAX_FILE_BYTES + 1)
        if len(raw) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
        spec = json.loads(raw)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
                 and before.get("use_regex", True) and not before.get("add_prefix_space", True))
        if not plain or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        byte = _byte_of_char()

        def raw_bytes(token: str) -> bytes:
            return bytes(byte[c] for c in token)

        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {raw_bytes(t): k for t, k in model["vocab"].items() if t not in added}
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(raw_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            ranks.setdefault((left + right, len(left)), rank)
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        return cls(ids, ranks, added)

    def tokens(self) -> pa.Array:
        """The bytes of each id, by id; ids that nothing has are empty."""
        found = {k: t for t, k in self.ids.items()} | {k: t.encode() for t, k in self.added.items()}
        return pa.array([found.get(k, b"") for k in range(max(found) + 1)], pa.large_binary())


def merge_short(word: bytes, ranks: dict[tuple[bytes, int], int]) -> list[int]:
    """Part boundaries of a word, first and last included, after all merges."""
    bounds = list(range(len(word) + 1))
    # at[k] is the rank of the merge that deletes bounds[k + 1]
    at = [ranks.get((word[k:k + 2], 1), _NEVER) for k in range(len(word) - 1)]
    while at:
        least = min(at)
        if least == _NEVER:
            break
        k = at.index(least)
        del at[k], bounds[k + 1]
        if k:
            a, b, c = bounds[k - 1:k + 2]
            at[k - 1] = ranks.get((word[a:c], b - a), _NEVER)
        if k < len(at):
            a, b, c = bounds[k:k + 3]
            at[k] = ranks.get((word[a:c], b - a), _NEVER)
    return bounds


class RankTable:
    """The merges by number: parts are numbered, and a pair of parts is looked up in a sorted array."""

    def __init__(self, ids: dict[bytes, int], ranks: dict[tuple[bytes, int], int]):
        parts: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        pairs = [(parts.setdefault(whole[:cut], len(parts)), parts.setdefault(whole[cut:], len(parts)),
                  parts.setdefault(whole, len(parts)), rank) for (whole, cut), rank in ranks.items()]
        left, right, whole, rank = np.array(pairs, np.int64).reshape(-1, 4).T
        self.parts = len(parts)
        pair = left * self.parts + right
        order = np.argsort(pair)
        # a last pair that nobody asks for, so that every search ends inside
        self.pair = np.append(pair[order], np.iinfo(np.int64).max)
        self.rank = np.append(rank[order], _NEVER >> 8)
        self.whole = np.append(whole[order], 0)
        #: the id of a part, -1 where it has none
        self.ids = np.array([ids.get(p, -1) for p in parts], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair's merge, ``_NEVER >> 8`` where it has none, and what it becomes."""
        pair = left * self.parts + right
        at = np.searchsorted(self.pair, pair)
        return np.where(self.pair[at] == pair, self.rank[at], _NEVER >> 8), self.whole[at]


def merge_batch(words: list[bytes], table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_short`` for many words of ``SHORT`` bytes at most: the ids of all, and how many each has.

    A word is a column. Row b holds its boundary before byte b, as the rank of the merge that would
    remove it times 256 plus b, so that a column's smallest number is the first of its smallest ranks.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n, longest = len(words), int(sizes.max())
    part = np.zeros((n, longest + 1), np.int64)
    inside = np.arange(longest + 1) < sizes[:, None]
    part[inside] = np.frombuffer(b"".join(words), np.uint8)
    part = np.ascontiguousarray(part.T)
    stays = np.ascontiguousarray(inside.T)
    rows = np.arange(longest + 1)[:, None]
    before = np.repeat(rows - 1, n, axis=1)
    after = np.repeat(rows + 1, n, axis=1)
    at = np.full((longest + 1, n), _NEVER, np.int64)
    becomes = np.zeros((longest + 1, n), np.int64)
    b, c = np.nonzero(stays[1:])
    b += 1
    rank, becomes[b, c] = table.find(part[b - 1, c], part[b, c])
    at[b, c] = (rank << 8) + b

    def refresh(b: np.ndarray, c: np.ndarray) -> None:
        rank, becomes[b, c] = table.find(part[before[b, c], c], part[b, c])
        at[b, c] = (rank << 8) + b

    columns = np.arange(n)
    while len(columns):
        least = (at if len(columns) == n else at[:, columns]).min(axis=0)
        live = (least >> 8) < (_NEVER >> 8)
        columns, b = columns[live], least[live] & 255
        left, right = before[b, columns], after[b, columns]
        part[left, columns] = becomes[b, columns]
        at[b, columns] = _NEVER
        stays[b, columns] = False
        after[left, columns], before[right, columns] = right, left
        inner = left > 0
        refresh(left[inner], columns[inner])
        inner = right < sizes[columns]
        refresh(right[inner], columns[inner])
    ids = table.ids[part.T[stays.T]]
    if (ids < 0).any():
        raise ValueError("a merge makes a token that the vocabulary lacks")
    return ids.astype(np.uint32), stays.sum(axis=0)


def merge_long(word: bytes, ranks: dict[tuple[bytes, int], int]) -> list[int]:
    """As ``merge_short``: the smallest rank comes from a heap, deleted boundaries are linked over."""
    n = len(word)
    before, after = list(range(-1, n)), list(range(1, n + 2))
    at = [_NEVER] * (n + 1)
    heap = []
    for b in range(1, n):
        at[b] = ranks.get((word[b - 1:b + 1], 1), _NEVER)
        if at[b] != _NEVER:
            heap.append((at[b], b))
    heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        rank, b = heappop(heap)
        if gone[b] or at[b] != rank:
            continue
        gone[b] = 1
        left, right = before[b], after[b]
        after[left], before[right] = right, left
        for near in (left, right):
            if 0 < near < n:
                a, c = before[near], after[near]
                at[near] = ranks.get((word[a:c], near - a), _NEVER)
                if at[near] != _NEVER:
                    heappush(heap, (at[near], near))
    bounds, b = [0], 0
    while b < n:
        b = after[b]
        bounds.append(b)
    return bounds


class _Runs:
    """Numbered runs of ids in one array."""

    def __init__(self):
        self.flat = np.zeros(0, np.uint32)
        self.start = self.size = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def add_lists(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.add(np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum())), sizes)

    def take(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered runs, one after the other, and how many ids ``counts`` runs have each time."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + size, size)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[where], np.diff(bounds)


class Encoder:
    """Ids of texts, block by block; the memory of pieces is dropped when it has grown to its bound."""

    _word = regex.compile(WORD)
    _blank_end = regex.compile(r"\s\Z")

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        strings = sorted(vocabulary.added, key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self._library = ByteLevel(add_prefix_space=False)
        self._table = RankTable(vocabulary.ids, vocabulary.ranks)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        # words by text, strings that are one token by id
        self.words: dict[str | int, int] = {}
        self.word_ids = _Runs()
        self.open: set[int] = set()
        self.held = 0
        self.piece_ids = _Runs()

    def _split(self, piece: str) -> list[str]:
        """Words of a piece.

        Tokenizers part texts by an older table of characters than ``regex``; the two differ only
        in characters that this Python does not know yet, and pieces with one are parted there.
        """
        if piece.isascii() or all(unicodedata.category(c) != "Cn" for c in piece):
            return self._word.findall(piece)
        return [piece[a:b] for _, (a, b) in self._library.pre_tokenize_str(piece)]

    def _merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.vocabulary.ids
        whole = ids.get(raw) if len(raw) < 2 else None
        if whole is not None:
            return [whole]
        merge = merge_short if len(raw) <= SHORT else merge_long
        return [ids[raw[a:b]] for a, b in pairwise(merge(raw, self.vocabulary.ranks))]

    def _mixed(self, piece: str) -> list[str | int]:
        """Words of a piece, and the ids of the strings in it that are one token."""
        out = []
        # odd places hold the strings that are one token
        for k, part in enumerate(self._added.split(piece)):
            if k % 2:
                out.append(self.vocabulary.added[part])
            else:
                out += self._split(part)
        return out

    def _learn_words(self, fresh: list[str | int]) -> None:
        """Number the words and merge them, short ones beside others of like length."""
        short, few = [], []
        for word in fresh:
            raw = word.encode("utf-8", "surrogatepass") if isinstance(word, str) else b""
            (short if 2 <= len(raw) <= SHORT else few).append((len(raw), raw, word))
        if len(short) < FEW:
            few, short = few + short, []
        short.sort(key=lambda w: w[0])
        for start in range(0, len(short), BATCH):
            batch = short[start:start + BATCH]
            self._name([word for _, _, word in batch])
            self.word_ids.add(*merge_batch([raw for _, raw, _ in batch], self._table))
        if few:
            self._name([word for _, _, word in few])
            self.word_ids.add_lists([self._merge(word) if isinstance(word, str) else [word] for _, _, word in few])

    def _name(self, words: list[str | int]) -> None:
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    def _learn(self, fresh: list[str]) -> None:
        # a string that is one token shows in the pieces put together, too
        mixed = self._added and self._added.search("\0".join(fresh))
        found = [(self._mixed if mixed else self._split)(p) for p in fresh]
        unknown = [w for w in dict.fromkeys(w for f in found for w in f) if w not in self.words]
        if unknown:
            self._learn_words(unknown)
        self.held += sum(map(len, fresh))
        self.open.update(len(self.codes) + k for k, p in enumerate(fresh) if self._blank_end.search(p))
        self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh)), strict=True))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter((self.words[w] for f in found for w in f), np.int64, int(counts.sum()))
        self.piece_ids.add(*self.word_ids.take(numbers, counts))

    def _closed(self, pieces: list[str]) -> list[str]:
        """Pieces joined with the next one wherever they end in white space."""
        out = pieces[:1]
        for piece in pieces[1:]:
            if self._blank_end.search(out[-1]):
                out[-1] += piece
            else:
                out.append(piece)
        return out

    def _numbered(self, pieces: list[str]) -> list[int]:
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.codes]
        if fresh:
            self._learn(fresh)
        return [self.codes[p] for p in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has.

        No word of ``WORD`` crosses the place before a space that follows anything but white
        space, so texts are cut there first. A string that is one token may hold such a place,
        or begin with a space, so a text that has one is a piece of its own.
        """
        if len(self.codes) > MEMO or self.held > MEMO_CHARS:
            self._forget()
        whole = [k for k, t in enumerate(texts) if "\0" in t or (self._added and self._added.search(t))]
        plain = pa.array(texts, pa.large_string())
        if whole:
            held = list(texts)
            for k in whole:
                held[k] = ""
            plain = pa.array(held, pa.large_string())
        listed = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        edges = listed.offsets.to_numpy().astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        table = np.array(self._numbered(coded.dictionary.to_pylist()), np.int64)
        codes = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        counts = np.diff(edges)
        parts = None
        ends_open = np.isin(codes, np.fromiter(self.open, np.int64, len(self.open))) if self.open else np.zeros(len(codes), bool)
        ends_open[edges[1:][counts > 0] - 1] = False
        joined = np.unique(np.searchsorted(edges, np.flatnonzero(ends_open), side="right") - 1).tolist()
        if joined or whole:
            parts = np.split(codes, edges[1:-1])
            for k in joined:
                parts[k] = np.array(self._numbered(self._closed(texts[k].replace(" ", "\0 ").split("\0"))), np.int64)
            for k in whole:
                parts[k] = np.array(self._numbered([texts[k]]), np.int64)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            codes = np.concatenate(parts)
        return self.piece_ids.take(codes, counts)


def _texts(raw: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The bytes of each token in a row, cut into texts; what isn't UTF-8 is replaced."""
    raw_ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2] or pa.py_buffer(b"")
    cut = raw_ends[offsets]
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(cut), data])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        held = data.to_pybytes()
        out = pa.array([held[a:b].decode("utf-8", "replace") for a, b in pairwise(cut.tolist())], pa.large_string())
    return out.cast(pa.string())


def _added_columns(df: DataFrame, new: dict) -> tuple[list[str], StructType]:
    kept = [f for f in df.schema if f.name.lower() not in {n.lower() for n in new}]
    return [f.name for f in kept], StructType(kept + [StructField(name, kind) for name, kind in new.items()])


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str | None = "ids",
           packed_col: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """Add the ids of each whole text: ``ids`` as an array, ``packed`` as little-endian 32-bit numbers.

    With ``decoded_col`` the ids are decoded again in the same pass. The strings that the file
    adds to its vocabulary are one token wherever they stand in a text, the longest first.

    No shuffle; the vocabulary (from a file checked to be below 64 MB) is broadcast. A null or
    empty text has no ids and decodes to an empty text. Rows stay as they are, repeated ones and
    null ids too; no rows give no rows. A column with the name of a new one is replaced, others
    are handed on.
    """
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.ids, vocabulary.ranks, vocabulary.added))
    kinds = {ids_col: ArrayType(IntegerType()), packed_col: BinaryType(), decoded_col: StringType()}
    new = {name: kind for name, kind in kinds.items() if name}
    names, schema = _added_columns(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value)
        coder, tokens = Encoder(own), own.tokens()
        for batch in batches:
            for start, end, texts in blocks(batch.column(text_col)):
                ids, counts = coder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                added = {}
                if ids_col:
                    added[ids_col] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                if packed_col:
                    data = pa.py_buffer(ids.astype("<u4").tobytes())
                    added[packed_col] = pa.Array.from_buffers(
                        pa.binary(), len(texts), [None, pa.py_buffer((offsets * 4).astype(np.int32)), data])
                if decoded_col:
                    added[decoded_col] = _texts(tokens.take(pa.array(ids)), offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(start, end - start) for n in names] + [added[n] for n in new], [*names, *new])
        coder = own = tokens = batch = texts = added = None
        give_back()

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; what isn't UTF-8 (ids that end inside a character) is replaced.

    Null ids decode to an empty text, an id that the vocabulary does not have to nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.ids, vocabulary.ranks, vocabulary.added))
    names, schema = _added_columns(df, {out_col: StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(*shared.value).tokens()
        for batch in batches:
            listed = batch.column(ids_col)
            counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(listed)
            known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))), False)
            raw = pc.fill_null(tokens.take(pc.if_else(known, ids, None)), b"")
            text = _texts(raw, np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [text], [*names, out_col])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
