"""Secret scans: keywords found by an automaton, anchored expressions only where one hit,
checksums inside a token verified last.

The general operator returns spans with their kind; kinds of ``BASE`` are plain patterns,
kinds of ``CHECKED`` also have to prove themselves (an embedded CRC-32, a decodable
header, a closing line).
"""

from __future__ import annotations

import base64
import json
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, free

SPANS = "spans array<struct<kind:string,start:long,end:long>>"

# Keywords of the patterns, and kinds in the order in which equal starts are listed.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "jwt", "pem")

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_JWT_HEAD = re.compile(r"eyJ[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
# closing lines may share their dashes
_PEM_END = re.compile(r"(?=-----END ([A-Z ]*PRIVATE KEY)-----)")

_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase


def base62_crc(body: str, width: int = 6) -> str:
    """CRC-32 of ``body`` in base 62, as the tokens with a built-in checksum carry it."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out.rjust(width, "0")


def _sums_up(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _decodes(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


#: Kind of a keyword: its anchored expression and the check of a match.
_ANCHORED: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 18),
    "github": (_GITHUB, _sums_up),
    "npm": (_NPM, _sums_up),
    "jwt": (_JWT, _decodes),
}
_RANK = {kind: k for k, kind in enumerate(BASE + CHECKED)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keys in (("assign", _ASSIGN_WORDS), ("access", ("akia",)), ("github", _GITHUB_WORDS),
                       ("npm", ("npm_",)), ("jwt", ("eyj",)), ("pem", ("-----begin ",))):
        for key in keys:
            found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case with every position kept (some letters grow under str.lower)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _pem_ends(text: str) -> dict[str, list[int]]:
    """Where the closing lines of each label begin."""
    out: dict[str, list[int]] = {}
    for m in _PEM_END.finditer(text):
        out.setdefault(m[1], []).append(m.start())
    return out


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text: leftmost and non-overlapping within a kind, a failing match uses its text up.

    Linear in the text: a run of letters is read once however many keywords it holds, and closing
    lines are listed once.
    """
    out = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in automaton.iter(_lower(text)):
        hits.setdefault(kind, []).append(last - size + 1)
    ends: dict[str, list[int]] | None = None
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start < free:
                continue
            if kind == "pem":
                m = _PEM.match(text, start)
                if m:
                    ends = _pem_ends(text) if ends is None else ends
                    of = ends.get(m[1], [])
                    at = bisect_left(of, m.end())
                    if at < len(of):
                        free = of[at] + len(m[1]) + len("-----END -----")
                        out.append((kind, start, free))
                continue
            pattern, holds = _ANCHORED[kind]
            m = pattern.match(text, start)
            if m:
                free = m.end()
                if holds(m):
                    out.append((kind, start, m.end()))
            elif kind == "jwt" and (head := _JWT_HEAD.match(text, start)):
                # what follows the run is the same for every start inside it
                free = head.end()
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


def _setup():
    automaton = _automaton()
    return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in find(t, automaton)] for t in texts]]


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans``: kind, start and end (code points, end exclusive), by start, then kind.

    One pass over whole texts without a shuffle; a text of any length is one scan, linear in
    it. A null or empty text has an empty array. Rows stay as they are, repeated ones and null ids
    too; no rows give no rows. A column named ``spans`` is replaced.
    """
    return annotate(df, text_col, SPANS, _setup)


def redact(df: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The rows of ``df`` with every span's text replaced by ``mark`` (overlapping spans by one).

    Rows without a secret keep their text as it is, null included.
    """
    def setup():
        automaton = _automaton()

        def cut(text: str) -> str:
            out, at, until = [], 0, -1
            for _, a, b in find(text, automaton):
                if a >= until:
                    out += [text[at:a], mark]
                until = max(until, b)
                at = until
            return "".join(out) + text[at:]
        return lambda texts: [list(map(cut, texts))]

    name, = free(df, "_redacted")
    done = annotate(df, text_col, f"{name} string", setup)
    value = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.col(name))
    return done.withColumn(text_col, value).select(*[f"`{c}`" for c in df.columns])
