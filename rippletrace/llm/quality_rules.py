"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. A document keeps its measurements and one integer whose
bits say which rules failed; a policy is a mask over those bits, so another version, or
a run without one rule, is a bitwise test on the ledger and never a second reading.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, words

MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
            "n_repeat_words long, n_letters long, n_capitals long")
WINDOW = 5

#: Rule names in bit order. Append only: a ledger on disk stays readable.
RULES: dict[str, Column | None] = dict.fromkeys([
    "few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals"])

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _CAPITALS + bytes(range(ord("a"), ord("z") + 1))

POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "strict": tuple(RULES),
}


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 2 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 30 * n),
        "capitals": (F.col("n_letters") >= 20) & (10 * F.col("n_capitals") > 7 * F.col("n_letters")),
    }


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated_words(tokens: list, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), np.int64, len(tokens))
    size = len(ids)
    keys = codes[:n]
    span = size
    for k in range(1, window):
        if span > (1 << 62) // size:
            keys = _rank(keys)
            span = n
        keys = keys * size + codes[k:k + n]
        span *= size
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, np.unique(twice)))
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    blanks = sum(map(text.count, " \t\n\r\x0b\x0c"))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(tokens), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated_words(tokens), letters, capitals)


def _setup():
    return lambda texts: list(zip(*map(measure, texts), strict=True))


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measurements and ``failed_bits`` (bit k: rule k of ``RULES`` failed).

    One reading of each whole text, no shuffle. A null or empty text has zero words and
    fails ``few_words``; equal texts have equal ledgers; rows are neither lost nor merged.
    Columns of ``df`` with the names of measurements are replaced.
    """
    measured = annotate(df, text_col, MEASURES, _setup, keep_text=False)
    failed = _failures()
    bits = [F.when(F.coalesce(failed[name], F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))
            for k, name in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total.cast("long"))


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, by name or as rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = list(RULES)
    return sum(1 << order.index(name) for name in names)


def passes(policy: str | tuple[str, ...]) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str = "strict") -> DataFrame:
    """One row per rule of a policy: documents failing it, failing it alone, and kept without it.

    The ledger is first counted by its bits (at most 2^rules groups, combined before the
    shuffle), so hot sources or copies weigh nothing. An empty ledger gives rows of zeros.
    """
    whole = mask(policy)
    order = list(RULES)
    counted = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << order.index(name)).alias("bit"))
                      for name in POLICIES[policy]])
    names = book.sparkSession.range(1).select(F.explode(rules).alias("r")).select("r.*")
    got = F.col("failed_bits").bitwiseAND(F.lit(whole))
    per_rule = counted.select("n", got.alias("got"), F.explode(rules).alias("r")).groupBy("r.rule").agg(
        F.sum(F.when(F.col("got").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("got") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("got").bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long"))) == 0,
                     F.col("n")).otherwise(0)).alias("kept_without"))
    zero = {"failed": 0, "failed_alone": 0, "kept_without": 0}
    return names.select("rule").join(per_rule, "rule", "left").na.fill(zero)
