"""Event lines: decoding, defaults, validation and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..plans.blocks import sequence_number

_CORRUPT = "_corrupt"
_WIDE = T.StructType(S.EVENT_JSON.fields + [T.StructField(_CORRUPT, T.StringType())])


def decode_events(lines: DataFrame) -> DataFrame:
    """Decode the column ``value``; other columns are kept. ``problem`` tells what is wrong.

    Defaults of the format are filled in, those of nodes and edges when a graph event is
    unfolded. A line that is not a JSON object has only its ``problem``. Works on batch and
    streaming frames alike. Store the result before asking it several questions.
    """
    kept = [c for c in lines.columns if c != "value"]
    parsed = lines.withColumn("e", F.from_json(
        "value", _WIDE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
                         "allowComments": "true"}))
    e = lambda name: F.col(f"e.{name}")
    changed = e("type") == "file.changed"
    impact = e("type") == "impact.updated"
    filters = F.struct(F.coalesce(e("filters")["max_depth"], F.lit(S.MAX_DEPTH)).alias("max_depth"),
                       e("filters")["edge_kinds"].alias("edge_kinds"),
                       F.coalesce(e("filters")["include_heuristic"], F.lit(False)).alias("include_heuristic"))
    out = parsed.select(
        *kept, F.coalesce(e("t_ms"), F.lit(0.0)).alias("t_ms"), e("type").alias("type"),
        F.coalesce(e("generation"), F.lit(0).cast("long")).alias("generation"),
        e("session").alias("session"), e("path").alias("path"),
        F.when(changed, F.coalesce(e("node_id"), F.concat(F.lit("file:"), e("path")))).alias("node_id"),
        F.when(changed, F.coalesce(e("change"), F.lit("modified"))).alias("change"),
        F.when(changed, F.coalesce(e("from_path"), F.lit(""))).alias("from_path"),
        F.when(changed, F.coalesce(e("processing"), F.lit("pending"))).alias("processing"),
        *[e(c).alias(c) for c in ("added_nodes", "updated_nodes", "removed_nodes", "added_edges",
                                  "updated_edges", "removed_edges", "note")],
        F.when(impact, F.coalesce(e("level"), F.lit("package"))).alias("level"),
        e("baseline_generation").alias("baseline_generation"), e("seed_nodes").alias("seed_nodes"),
        F.when(impact, filters).alias("filters"), e("impacted_nodes").alias("impacted_nodes"),
        e("adapter").alias("adapter"),
        F.when(e("type") == "adapter.status", F.coalesce(e("state"), F.lit("idle"))).alias("state"),
        e("queue_depth").alias("queue_depth"), e("last_success_generation").alias("last_success_generation"),
        e("message").alias("message"), e("corrections").alias("corrections"), e("snapshot").alias("snapshot"),
        F.when(e(_CORRUPT).isNotNull() | F.col("e").isNull(), F.lit("not a JSON object")).alias("corrupt"))
    return out.withColumn("problem", _problem()).drop("corrupt")


def _problem() -> Column:
    """First reason a decoded event breaks the format, or null."""
    def outside(column: Column, name: str, allowed: list[str]) -> Column:
        return F.when(column.isNotNull() & ~column.isin(allowed),
                      F.concat(F.lit(f"unknown value for {name}: "), column))

    def needs(kind: str, column: str) -> Column:
        return F.when((F.col("type") == kind) & F.col(column).isNull(), F.lit(f"missing {column}"))

    def any_item(column: str, test, label: str) -> Column:
        return F.when(F.exists(F.coalesce(F.col(column), F.array().cast(_array_type(column))), test),
                      F.lit(f"{label} in {column}"))

    def bad(item, field, allowed):
        return item[field].isNotNull() & ~item[field].isin([*allowed, *(["unknown"] if field == "kind" else [])])

    checks = [
        F.col("corrupt"),
        F.when(F.col("type").isNull(), F.lit("missing type")),
        outside(F.col("type"), "type", [*S.EVENT_TYPES, "snapshot"]),
        needs("session.started", "session"), needs("file.changed", "path"),
        needs("adapter.status", "adapter"), needs("impact.updated", "impacted_nodes"),
        outside(F.col("change"), "change", S.FILE_CHANGES),
        outside(F.col("processing"), "processing", S.PROCESSING),
        outside(F.col("level"), "level", S.LEVELS), outside(F.col("state"), "state", S.ADAPTER_STATES),
    ]
    for column in ("added_nodes", "updated_nodes"):
        checks.append(any_item(column, lambda n: n["id"].isNull(), "missing id"))
        checks.append(any_item(column, lambda n: bad(n, "kind", S.NODE_KINDS)
                               | bad(n, "freshness", S.FRESHNESS), "unknown value"))
    for column in ("added_edges", "updated_edges"):
        checks.append(any_item(column, lambda n: n["id"].isNull() | n["from"].isNull()
                               | n["to"].isNull(), "missing end"))
        checks.append(any_item(column, lambda n: bad(n, "kind", S.EDGE_KINDS)
                               | bad(n, "freshness", S.FRESHNESS)
                               | bad(n, "confidence", S.CONFIDENCE), "unknown value"))
    checks.append(any_item("impacted_nodes", lambda n: n["node_id"].isNull(), "missing node_id"))
    checks.append(any_item("impacted_nodes", lambda n: (n["cause"].isNotNull() & ~n["cause"].isin(S.IMPACT_CAUSES))
                           | (n["freshness"].isNotNull() & ~n["freshness"].isin(S.FRESHNESS)),
                           "unknown value"))
    kinds = F.coalesce(F.col("filters")["edge_kinds"], F.array().cast("array<string>"))
    checks.append(F.when(F.exists(kinds, lambda k: ~k.isin(S.EDGE_KINDS)), F.lit("unknown edge kind in filters")))
    return F.coalesce(*checks)


def _array_type(column: str) -> T.DataType:
    return S.EVENT_JSON[column].dataType


def validate_events(events: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good events, quarantined events with their ``problem``). ``strict`` fails on the first."""
    if strict:
        origin = F.concat(F.coalesce(F.col("origin"), F.lit("?")), F.lit(": "), F.col("problem")) \
            if "origin" in events.columns else F.col("problem")
        checked = F.when(F.col("problem").isNull(), F.col("type")).otherwise(F.raise_error(origin))
        return events.withColumn("type", checked).drop("problem"), events.where("false")
    return events.where("problem is null").drop("problem"), events.where("problem is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, line (1-based), value.

    Files are read in splits. The split offset and the row order inside a split give the
    order of the lines, and counting per split gives their numbers, so no file has to be
    read by one task.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    numbered = sequence_number(raw, ["file"], ["block", "row"], "line")
    return numbered.select("file", (F.col("line") + 1).alias("line"),
                           F.regexp_replace("value", r"\r$", "").alias("value"))


def read_events(spark: SparkSession, path: str, repo_id: Column | None = None) -> DataFrame:
    """Decoded events of JSONL files, in stable time order.

    Blank and ``//`` lines are skipped. ``repo_id`` defaults to the file name. ``seq`` is
    dense per repository and follows (t_ms, file, line); ``origin`` is ``file:line``.
    """
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    placed = lines.select((name if repo_id is None else repo_id).alias("repo_id"),
                          F.concat_ws(":", "file", "line").alias("origin"), "file", "line", "value")
    decoded = decode_events(placed)
    return sequence_number(decoded, ["repo_id"], ["t_ms", "file", "line"]).drop("file", "line")
