"""Scalar column expressions: paths, names, ranks."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEPENDENCY_KINDS, LEVEL_KINDS

# Freshness from best to worst.
_FRESHNESS_ORDER = ["current", "pending", "stale", "invalid"]
# How specific an edge kind is when several join the same two nodes.
_KIND_WEIGHT = {"calls": 3, "references": 2, "imports": 1}
# an empty part, ``.`` or ``..``
_UNRESOLVED = r"(?:\A|/)\.{0,2}(?:/|\z)"


def normalize_name(name: Column) -> Column:
    """Distribution names compare lower-cased with ``_`` and ``.`` read as ``-``."""
    return F.translate(F.lower(name), "_.", "--")


def requirement_name(requirement: Column) -> Column:
    """The leading name of a requirement such as ``lib[extra]>=1``."""
    return F.regexp_extract(F.trim(requirement), r"^([A-Za-z0-9._-]*)", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_depth(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is not an extension)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def is_under(directory: Column, path: Column) -> Column:
    """``path`` lies strictly below ``directory`` (the root is the empty string)."""
    return F.when(directory == "", path != "").otherwise(
        path.startswith(F.concat(directory, F.lit("/"))))


def join_path(directory: Column, rel: Column) -> Column:
    return F.when(directory == "", rel).otherwise(F.concat(directory, F.lit("/"), rel))


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``; empty when the path climbs above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    escaped = F.array(F.lit("..")).cast("array<string>")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(acc == escaped, acc)
        .when((p == "..") & (F.size(acc) == 0), escaped)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    folded_text = F.when(folded == escaped, F.lit("")).otherwise(F.array_join(folded, "/"))
    # most paths have no part to resolve, and a match is far cheaper than a fold
    return F.when(path.rlike(_UNRESOLVED), folded_text).otherwise(path)


def path_prefixes(path: Column) -> Column:
    """Every directory above ``path``, outermost (``""``) first."""
    return F.transform(
        F.sequence(F.lit(0), F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))),
        lambda n: F.call_function("substring_index", path, F.lit("/"), n))


def short_id(node_id: Column) -> Column:
    """The text after the first colon of an id, for display."""
    return F.regexp_replace(node_id, r"^[^:]*:", "")


def comma_list(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda item: item != "")


def freshness_rank(freshness: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in _FRESHNESS_ORDER]), freshness) - 1


def worse_freshness(left: Column, right: Column) -> Column:
    return F.when(freshness_rank(right) > freshness_rank(left), right).otherwise(left)


def kind_weight(kind: Column) -> Column:
    expr = F.lit(0)
    for name, weight in _KIND_WEIGHT.items():
        expr = F.when(kind == name, F.lit(weight)).otherwise(expr)
    return expr


def is_dependency_kind(kind: Column) -> Column:
    return kind.isin(DEPENDENCY_KINDS)


def level_admits(level: str, kind: Column) -> Column:
    return kind.isin(LEVEL_KINDS[level])


def glob_to_regex(glob: Column) -> Column:
    """A glob whose ``*`` and ``?`` stop at ``/`` as an anchored regular expression."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|])", r"\\$1")
    return F.concat(
        F.lit("^"),
        F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")),
        F.lit("$"),
    )


def valid_patterns(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that compile where they will run, in the JVM; a broken one hides nothing."""
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    kept = []
    for pattern in patterns:
        try:
            compiler.compile(pattern)
        except IllegalArgumentException:
            continue
        if pattern:
            kept.append(pattern)
    return kept
