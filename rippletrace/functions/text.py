"""Whole-text expressions for source files, kept inside the JVM.

A file is cut into tokens with one regular expression, the tokens that are not
code are blanked (their line breaks stay), and each line is suffixed with a mark
carrying its number. Later expressions can then match over several lines and
still know where a match began, with no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"


def blank_tokens(text: Column, token_pattern: str, is_blank, filler: Column | None = None) -> Column:
    """Blank the tokens of ``text`` for which ``is_blank(token)`` holds.

    ``token_pattern`` must match every character of the text as part of some token.
    """
    tokens = F.regexp_extract_all(text, F.lit(token_pattern), F.lit(0))

    def scrub(token: Column) -> Column:
        gone = F.regexp_replace(token, r"[^\n]+", "")
        if filler is not None:
            gone = F.concat(F.when(token.contains("\n"), F.lit("")).otherwise(filler), gone)
        return F.when(is_blank(token), gone).otherwise(token)

    return F.array_join(F.transform(tokens, scrub), "")


def unix_lines(text: Column) -> Column:
    """Every line break as one line feed. Texts without a carriage return are handed on as they are."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_tokens(text: Column, dropped: str, kept: str, starts: str, spans: str, is_blank, marks: tuple[str, ...] = ()) -> Column:
    """``blank_tokens`` without a filler, in one replacement where the dropped tokens hold no line break.

    ``dropped`` and ``kept`` match the tokens, without numbered groups. ``starts`` is found in every token to drop, at
    most two word characters after its begin, ``spans`` in every text in which one may hold a line break; both may be
    found elsewhere. ``marks``: plain texts, one of which is in every match of ``starts``; they are found faster.
    """
    # a run of kept tokens, up to where one to drop may begin, is replaced at once
    run = f"(?:{kept})(?:(?![A-Za-z0-9_]{{0,2}}(?:{starts}))(?:{kept}))*+"

    def scrub(text: Column) -> Column:
        marked = reduce(or_, [text.contains(m) for m in marks]) if marks else text.rlike(starts)
        return (F.when(~marked, text).when(text.rlike(spans), blank_tokens(text, f"(?:{dropped}|{kept})", is_blank))
                .otherwise(F.regexp_replace(text, f"(?:{dropped})|(?<kept>{run})", "${kept}")))
    return let(text, scrub)


def number_lines(text: Column) -> Column:
    """Suffix every line with ``MARK`` and its 1-based number; a mark in the text itself becomes a space."""
    lines = F.split(unix_lines(F.replace(text, F.lit(MARK), F.lit(" "))), "\n", -1)
    return F.array_join(
        F.transform(lines, lambda line, i: F.concat(line, F.lit(MARK), (i + 1).cast("string"))),
        "\n",
    )


def first_line_number(text: Column) -> Column:
    return F.regexp_extract(text, MARK + r"(\d+)", 1).cast("int")


def drop_marks(text: Column, line_break: str = " ") -> Column:
    """Numbered text as one line."""
    return F.regexp_replace(text, MARK + r"\d+\n?", line_break)


def head_line(text: Column) -> Column:
    """The first physical line of a numbered fragment, trimmed."""
    return strip(F.substring_index(text, MARK, 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_at(lines: Column, number: Column) -> Column:
    """A line of ``lines`` by 1-based number, trimmed."""
    return strip(F.get(lines, number - 1))
