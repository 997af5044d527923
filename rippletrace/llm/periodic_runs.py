"""Runs of repeated words by an online sparse diagonal DP.

A run is a longest stretch of words with smallest period q that is at least ``MIN_LENGTH``
and two periods long. Words q apart are then equal on at least half of ``MIN_LENGTH`` places
in a row, so only places whose last ``MIN_LENGTH / 2`` words occurred before can lie on its
diagonal. From left to right, each earlier occurrence of a place adds one to the match length
of its lag; a lag that no occurrence adds to has ended, and emits its run at once if the match
is long enough. The table of active lags holds only what the current place repeats.

A text that repeats the same few words over and over has a square of such pairs. Where they
are more than ``PAIRS`` a word, runs are read off the same diagonals from anchors instead:
words at multiples of q and q further are extended both ways by tables of equal stretches of
1, 2, 4 ... words, about n log n steps for any text, with the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import annotate, words

MIN_LENGTH = 12
#: Earlier occurrences a word, on average over a text, up to which they are followed one by one.
PAIRS = 48
#: Anchor pairs extended at once.
_ANCHORS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BY_DOCUMENT = np.uint64(0xC2B2AE3D27D4EB4F)

Run = tuple[int, int, int]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _smallest(found: list[Run]) -> list[Run]:
    """Sorted by start, then period, with the smallest period of each stretch.

    A stretch two periods long that also has a smaller period is as long in that period too,
    so the smaller one was found with the same ends.
    """
    least: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def follow(before: list[int], places: list[int], seed: int, least: int) -> list[Run]:
    """Runs from the sparse diagonals.

    ``before[i]`` is the last place before i whose ``seed`` words are those of i (negative
    without one), ``places`` lists in order the i that have one.
    """
    found: list[Run] = []
    active: dict[int, int] = {}
    last = -2

    def emit(ended: dict[int, int], end: int) -> None:
        for lag, length in ended.items():
            if length >= lag and length + lag >= least:
                found.append((end - length - lag, length + lag, lag))

    for i in places:
        if i != last + 1 and active:
            emit(active, last + seed)
            active = {}
        grown = {}
        j = before[i]
        while j >= 0:
            lag = i - j
            grown[lag] = active.pop(lag, seed - 1) + 1
            j = before[j]
        if active:
            emit(active, i + seed - 1)
        active, last = grown, i
    emit(active, last + seed)
    return _smallest(found)


def _stretches(code: np.ndarray) -> list[np.ndarray]:
    """Table k numbers the stretch of 2^k words at each place; equal numbers, equal words."""
    tables = [np.unique(code, return_inverse=True)[1].astype(np.int32)]
    size = 1
    while 2 * size <= len(code):
        t = tables[-1].astype(np.int64)
        tables.append(np.unique(t[:-size] * (len(code) + 1) + t[size:], return_inverse=True)[1].astype(np.int32))
        size *= 2
    return tables


def _extend(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a and b on, and how many before them, are equal (a < b)."""
    on, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        size, t = 1 << k, tables[k]
        fits = np.flatnonzero(b + on + size <= n)
        same = t[(a + on)[fits]] == t[(b + on)[fits]]
        on[fits[same]] += size
        fits = np.flatnonzero(a - back - size >= 0)
        same = t[(a - back - size)[fits]] == t[(b - back - size)[fits]]
        back[fits[same]] += size
    return on, back


def anchored(code: np.ndarray, least: int) -> list[Run]:
    """Runs from pairs of places at multiples of each period."""
    n = len(code)
    if n < least:
        return []
    tables = _stretches(code)
    found: list[np.ndarray] = []
    # places at multiples of period q that have another q further
    counts = (n - 1) // np.arange(1, n // 2 + 1)
    ends = np.cumsum(counts)
    first = 1
    while first <= len(counts):
        passed = int(ends[first - 2]) if first > 1 else 0
        last = max(first, int(np.searchsorted(ends, passed + _ANCHORS, side="right")))
        period = np.repeat(np.arange(first, last + 1), counts[first - 1:last])
        at = np.arange(len(period)) - np.repeat(ends[first - 1:last] - counts[first - 1:last] - passed, counts[first - 1:last])
        a = at * period
        b = a + period
        first = last + 1
        # one of the two sides is as long as half of what a run needs
        word = tables[0]
        near = (word[a] == word[b]) | ((a > 0) & (word[a - 1] == word[b - 1]))
        a, b, period = a[near], b[near], period[near]
        on, back = _extend(tables, a, b, n)
        match = on + back
        long = (match >= period) & (match + period >= least)
        rows = np.stack([(a - back)[long], (match + period)[long], period[long]], axis=1)
        if len(rows):
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            lead = np.ones(len(rows), bool)
            lead[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            found.append(rows[lead])
    return _smallest([tuple(r) for r in np.concatenate(found).tolist()]) if found else []


def _holds(code: np.ndarray, run: Run) -> bool:
    start, length, period = run
    return bool((code[start:start + length - period] == code[start + period:start + length]).all())


def runs_of(codes: list[np.ndarray], least: int = MIN_LENGTH) -> list[list[Run]]:
    """(start, length, period) of every run of each sequence of word numbers, by start, then period."""
    seed = (least + 1) // 2
    out: list[list[Run]] = [[] for _ in codes]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    starts = np.cumsum(sizes) - sizes
    grams = np.maximum(sizes - seed + 1, 0)
    if not grams.any():
        return out
    flat = np.concatenate(codes).astype(np.uint64)
    key = np.zeros(len(flat) - seed + 1, np.uint64)
    for k in range(seed):
        key = (key + flat[k:k + len(key)]) * _MULTIPLIER
    document = np.repeat(np.arange(len(codes)), grams)
    place = np.arange(len(document)) + np.repeat(starts - np.cumsum(grams) + grams, grams)
    key = key[place] + document.astype(np.uint64) * _BY_DOCUMENT
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    if not again.any():
        return out
    before = np.full(len(flat), -1)
    before[place[order[1:]][again[1:]]] = place[order[:-1]][again[1:]]
    # how many equal keys stand before each one
    index = np.arange(len(order))
    earlier = index - np.maximum.accumulate(np.where(again, 0, index))
    pairs = np.bincount(document[order], weights=earlier, minlength=len(codes))
    for k in np.flatnonzero(pairs).tolist():
        low, n = int(starts[k]), int(sizes[k])
        if pairs[k] <= PAIRS * n:
            own = before[low:low + n] - low
            found = follow(own.tolist(), np.flatnonzero(own >= 0).tolist(), seed, least)
            # keys are hashes; a false match can only lengthen what is found
            if all(_holds(codes[k], r) for r in found):
                out[k] = found
                continue
        out[k] = anchored(codes[k], least)
    return out


def _collapsed(tokens: list[bytes], found: list[Run]) -> str:
    if found:
        drop = np.zeros(len(tokens) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
    return b" ".join(tokens).decode("utf-8", "surrogatepass")


def find(df: DataFrame, text_col: str = "text", least: int = MIN_LENGTH, keep_text: bool = True) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``.

    Words are the runs of ``[^\\x20\\x09-\\x0D]``, numbered from 0. ``collapsed`` joins by one space
    the words that no run holds beyond its first period. Each text is worked on by itself, whole
    and without a shuffle. A null or empty text has no words, no runs and an empty ``collapsed``.
    Rows stay as they are, repeated ones and null ids too; no rows give no rows. A column with the
    name of a new one is replaced, others are handed on.
    """
    if least < 4:
        raise ValueError("a run has at least four words")

    def setup():
        def work(texts: list[str]):
            # numbers mean the same word within a block only
            code = _Codes()
            tokens = [words(t) for t in texts]
            found = runs_of([np.fromiter(map(code.__getitem__, t), np.int64, len(t)) for t in tokens], least)
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            return [list(map(len, tokens)), listed, list(map(_collapsed, tokens, found))]
        return work

    return annotate(df, text_col, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
                    setup, keep_text)
