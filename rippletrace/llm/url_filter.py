"""URL rules as one bit-parallel wildcard automaton.

All glob rules are packed side by side into the bits of a few 64-bit words. A step of the
automaton is a shift, an and with the mask of the character, and an or with the states
whose wildcard swallows it, so every rule advances at once over each canonical URL. Blocks
of URLs step together.

Globs are ASCII over the canonical ``host + path``: ``*`` stands for any run without
``/``, ``**`` for any run at all, everything else for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, free

OTHER = 128


@dataclass(frozen=True)
class Rule:
    """Some globs that stand for one verdict; of those that fit, the lowest tier wins, then the longest name."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    tier: int = 0


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start with the rule's."""
    return Rule(name, verdict, (f"{name}**", f"*.{name}**"))


#: Rules by word for hosts that sell clicks; a hit has to be a whole label or a part of one between dashes.
WORD_LIST = ("casino", "bets", "pills", "spam", "adult", "ads", "porn", "phishing")


def word_rules(terms: Sequence[str] = WORD_LIST) -> list[Rule]:
    """Block hosts with one of the words as a label, or as a part of one set off by a dash."""
    edges = [(a, b) for a in ("", "*.", "*-") for b in ("/**", ".*", ".*/**", "-*", "-*/**", "")]
    return [Rule(f"~{t}", "block", tuple(f"{a}{t}{b}" for a, b in edges), 1) for t in terms]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path up to ``?`` or ``#``; empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    cut = F.coalesce(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(cut, r"^([^/]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.substring(cut, F.length(host) + 1, F.length(cut))


class Automaton:
    """Masks of all globs; bit k of the state is set while a glob has matched up to its k-th place."""

    def __init__(self, globs: Sequence[str]):
        parts = [self._parse(g) for g in globs]
        n = sum(len(p) + 1 for p in parts)
        self.words = max(1, -(-n // 64))
        step = np.zeros((OTHER + 1, n), bool)
        stay = np.zeros((OTHER + 1, n), bool)
        start = np.zeros(n, bool)
        skip = np.zeros(n, bool)
        self.last = []
        at = 0
        for places in parts:
            start[at] = True
            for k, place in enumerate(places):
                if place in ("*", "**"):
                    stay[:, at + k] = True
                    if place == "*":
                        stay[ord("/"), at + k] = False
                    skip[at + k + 1] = True  # a wildcard may be empty
                else:
                    step[ord(place), at + k + 1] = True
            at += len(places) + 1
            self.last.append(at - 1)
        self.step, self.stay = self._pack(step), self._pack(stay)
        self.skip = self._pack(skip[None])[0]
        self.start = self._closed(self._pack(start[None]))[0]

    @staticmethod
    def _parse(glob: str) -> list[str]:
        out: list[str] = []
        at = 0
        while at < len(glob):
            if glob[at] == "*":
                run = len(glob[at:]) - len(glob[at:].lstrip("*"))
                out.append("*" if run == 1 else "**")
                at += run
            elif ord(glob[at]) >= OTHER:
                raise ValueError(f"not ASCII: {glob}")
            else:
                out.append(glob[at])
                at += 1
        return out

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), bool)
        wide[:, :bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    @staticmethod
    def _shift(state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, state: np.ndarray) -> np.ndarray:
        """With the places reached over empty wildcards (never two in a row)."""
        return state | (self._shift(state) & self.skip)

    def run(self, texts: list[str]) -> np.ndarray:
        """For each text and glob whether the glob fits the whole text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, OTHER).astype(np.int64)
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        state = np.repeat(self.start[None], len(texts), axis=0)
        live = len(texts)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -k, side="left"))
            code = codes[starts[:live] + k]
            now = state[:live]
            state[:live] = self._closed((self._shift(now) & self.step[code]) | (now & self.stay[code]))
        last = np.array(self.last)
        fits = np.zeros((len(texts), len(last)), bool)
        fits[order] = (state[:, last >> 6] >> (last & 63).astype(np.uint64)) & np.uint64(1)
        return fits


def judge(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict for each URL; no shuffle.

    Of the rules that fit, the lowest tier wins, then the longest name, then the first given; rule is
    null and verdict ``default`` where none fits. A null URL, or one without ``://``, has
    empty host and path. Urls of any length are read whole. Columns of ``df`` named like
    the new ones are replaced, others are handed on.
    """
    ranked = sorted(rules, key=lambda r: (r.tier, -len(r.name)))
    names = [r.name for r in ranked]
    verdicts = [r.verdict for r in ranked]
    globs = [g for r in ranked for g in r.globs]
    owner = np.repeat(np.arange(len(ranked)), [len(r.globs) for r in ranked])
    host, path = host_and_path(F.col(url_col))
    own_host, own_path, place = free(df, "_host", "_path", "_place")
    split = df.withColumns({own_host: host, own_path: path}).withColumn(place, F.concat(own_host, own_path))

    def setup():
        automaton = Automaton(globs)

        def work(texts: list[str]):
            distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            fits = automaton.run(list(distinct))
            winner = np.where(fits.any(axis=1), owner[fits.argmax(axis=1)], -1)
            picked = [int(winner[distinct[t]]) for t in texts]
            return ([names[k] if k >= 0 else None for k in picked],
                    [verdicts[k] if k >= 0 else default for k in picked])
        return work

    done = annotate(split, place, "rule string, verdict string", setup, keep_text=False)
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return done.select(*[F.col(f"`{c}`") for c in kept], F.col(own_host).alias("host"), F.col(own_path).alias("path"),
                       "rule", "verdict")
