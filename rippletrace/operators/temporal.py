"""The event log as tables: state at any point, sessions, change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import running, sequence_number
from ..plans.durable import stored
from ..schemas import EDGE, LOG_LIMIT, NODE
from ..sources.snapshot import edge_struct, node_struct

_RANK_BOUND = 1000  # Spark's default bound for ranking before the shuffle

# The order in which one graph event is applied.
_NODE_STEPS = [("added_nodes", 0, "upsert"), ("updated_nodes", 1, "upsert"), ("removed_nodes", 5, "remove")]
_EDGE_STEPS = [("added_edges", 2, "upsert"), ("updated_edges", 3, "upsert"), ("removed_edges", 4, "remove")]


def _edge_item(item: Column) -> Column:
    filled, names = edge_struct(item), {"src": "from", "dst": "to"}
    return F.struct(*[filled[names.get(f.name, f.name)].alias(f.name) for f in EDGE.fields])


def _ops(events: DataFrame, steps, payload, schema) -> DataFrame:
    parts = []
    for column, sub, op in steps:
        exploded = events.where(F.size(column) > 0).select(
            "repo_id", "seq", F.posexplode(column).alias("pos", "item"))
        body = payload(F.col("item")) if op == "upsert" else F.lit(None).cast(schema)
        ident = F.col("item.id") if op == "upsert" else F.col("item")
        parts.append(exploded.select(
            "repo_id", ident.alias("id"),
            F.struct("seq", F.lit(sub).alias("sub"), "pos").alias("at"),
            F.lit(op).alias("op"), body.alias("body")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def node_ops(events: DataFrame) -> DataFrame:
    """repo_id, id, at (seq, sub, pos), op, body for every node operation of the log."""
    return _ops(events, _NODE_STEPS, node_struct, NODE)


def edge_ops(events: DataFrame) -> DataFrame:
    return _ops(events, _EDGE_STEPS, _edge_item, EDGE)


def _baseline_ops(rows: DataFrame, schema) -> DataFrame:
    body = F.struct(*[F.col(f.name) for f in schema.fields])
    start = F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("sub"), F.lit(0).alias("pos"))
    return rows.select("repo_id", "id", start.alias("at"), F.lit("upsert").alias("op"),
                       body.alias("body"))


def events_until(events: DataFrame, t_ms: float) -> DataFrame:
    """The prefix of the log up to a moment."""
    return events.where(F.col("t_ms") <= t_ms)


def first_n(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events of each repository (``seq`` is dense and starts at 0)."""
    return events.where(F.col("seq") < n)


def _effective_removals(ops: DataFrame) -> DataFrame:
    """Latest removal per node that really removed it: repo_id, id, removed_at.

    Only the first removal after an upsert has an effect, so the latest effective one
    opens the last run of removals. Three aggregates find it without ordering the
    operations of a node in one task.
    """
    slim = ops.select("repo_id", "id", "at", "op")
    last = slim.where("op = 'remove'").groupBy("repo_id", "id").agg(F.max("at").alias("last_removal"))
    touched = slim.join(last, ["repo_id", "id"])
    before = (touched.where("op = 'upsert' and at < last_removal").groupBy("repo_id", "id")
              .agg(F.max("at").alias("existed_at")))
    return (slim.where("op = 'remove'").join(before, ["repo_id", "id"]).where("at > existed_at")
            .groupBy("repo_id", "id").agg(F.min("at").alias("removed_at")))


def state_at(nodes: DataFrame, edges: DataFrame, events: DataFrame,
             upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after applying the log to a baseline, up to event ``upto`` inclusive.

    The last operation on an id wins. Removing a node also removes its active edges; an
    edge whose end is missing stays. A snapshot event (K5) restarts the graph: whatever
    came before it is dropped.
    """
    log = events if upto is None else events.where(F.col("seq") <= upto)
    all_nodes = _baseline_ops(nodes, NODE).unionByName(node_ops(log))
    all_edges = _baseline_ops(edges, EDGE).unionByName(edge_ops(log))
    if "snapshot" in events.columns:
        all_nodes, all_edges = _restart(log, all_nodes, all_edges)
    all_nodes, all_edges = stored(all_nodes, "node-ops"), stored(all_edges, "edge-ops")
    kept_nodes = (all_nodes.groupBy("repo_id", "id")
                  .agg(F.max_by(F.struct("op", "body"), "at").alias("last"))
                  .where("last.op = 'upsert'").select("repo_id", "last.body.*"))
    kept_edges = (all_edges.groupBy("repo_id", "id")
                  .agg(F.max_by(F.struct("op", "body", "at"), "at").alias("last"))
                  .where("last.op = 'upsert'").select("repo_id", "last.body.*", "last.at"))
    gone = stored(_effective_removals(all_nodes), "removals")
    for end in ("src", "dst"):
        removal = gone.select("repo_id", F.col("id").alias(end), F.col("removed_at").alias(f"{end}_gone"))
        kept_edges = kept_edges.join(removal, ["repo_id", end], "left")
    cascaded = F.col("valid_to").isNull() & (
        F.coalesce(F.col("src_gone") > F.col("at"), F.lit(False))
        | F.coalesce(F.col("dst_gone") > F.col("at"), F.lit(False)))
    return kept_nodes, kept_edges.where(~cascaded).select("repo_id", *[f.name for f in EDGE.fields])


def _restart(log: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    snaps = log.where(F.col("snapshot").isNotNull())
    epoch = snaps.groupBy("repo_id").agg(
        F.max("seq").alias("epoch"), F.max_by("snapshot", "seq").alias("snapshot"))
    start = F.struct(F.col("epoch").alias("seq"), F.lit(-1).alias("sub"), F.col("pos"))

    def since(ops, column, payload):
        fresh = epoch.select("repo_id", "epoch", F.posexplode(f"snapshot.{column}").alias("pos", "item"))
        fresh = fresh.select("repo_id", F.col("item.id").alias("id"), start.alias("at"),
                             F.lit("upsert").alias("op"), payload(F.col("item")).alias("body"))
        later = (ops.join(epoch.select("repo_id", "epoch"), "repo_id", "left")
                 .where("epoch is null or at.seq > epoch").select(*ops.columns))
        return later.unionByName(fresh)

    return since(nodes, "nodes", node_struct), since(edges, "edges", _edge_item)


def changed_files(events: DataFrame) -> DataFrame:
    """One row per changed file, numbered by first arrival.

    The first change kind stays unless a later event deletes the file; path, processing,
    generation and time follow the last event. Every aggregate is associative, so a
    streaming query can use the same expressions.
    """
    return (events.where("type = 'file.changed'").groupBy("repo_id", "node_id")
            .agg(*changed_file_aggregates()).drop("deleted"))


def changed_file_aggregates() -> list[Column]:
    first, last = (lambda c: F.min_by(c, "seq")), (lambda c: F.max_by(c, "seq"))
    deleted = F.max(F.col("change") == "deleted")
    return [
        F.when(deleted, F.lit("deleted")).otherwise(first("change")).alias("change"),
        first("from_path").alias("from_path"), last("path").alias("path"),
        last("processing").alias("processing"), last("generation").alias("generation"),
        last("t_ms").alias("t_ms"), F.min("seq").alias("first_seq"),
    ]


def adapter_status(events: DataFrame) -> DataFrame:
    """Latest state per adapter with its first arrival."""
    return (events.where("type = 'adapter.status'").groupBy("repo_id", "adapter")
            .agg(*adapter_aggregates()))


def adapter_aggregates() -> list[Column]:
    return [F.max_by(c, "seq").alias(c)
            for c in ("state", "queue_depth", "last_success_generation", "message")] + [
        F.min("seq").alias("first_seq")]


def latest_impact(events: DataFrame) -> DataFrame:
    """Newest impact result per level; it replaces the older one completely."""
    fields = ["generation", "baseline_generation", "seed_nodes", "filters", "impacted_nodes"]
    return (events.where("type = 'impact.updated'").groupBy("repo_id", "level")
            .agg(F.max("seq").alias("seq"), F.max_by(F.struct(*fields), "seq").alias("result"))
            .select("repo_id", "level", "seq", "result.*"))


def impact_rows(results: DataFrame) -> DataFrame:
    """Impacted nodes of stored results: level, repo_id, node, distance, ..., paths."""
    return results.select("level", "repo_id", F.explode("impacted_nodes").alias("n")).select(
        "level", "repo_id", F.col("n.node_id").alias("node"),
        F.coalesce("n.min_distance", F.lit(0)).alias("distance"),
        F.coalesce("n.direct", F.lit(False)).alias("direct"),
        F.coalesce("n.changed", F.lit(False)).alias("changed"),
        F.coalesce("n.freshness", F.lit("current")).alias("freshness"),
        F.coalesce("n.cause", F.lit("implementation")).alias("cause"),
        F.coalesce(F.transform("n.paths", lambda p: p["edges"]),
                   F.array().cast("array<array<string>>")).alias("paths"))


def checkpoints(events: DataFrame) -> DataFrame:
    """Generations at which the provider reconciled."""
    return events.where("type = 'reconcile.checkpoint'").select(
        "repo_id", "seq", "generation", "corrections", "message")


def current_generation(events: DataFrame) -> DataFrame:
    """Running generation of each event: the largest seen so far in its repository."""
    return running(events.select("repo_id", "seq", "type", "generation"), ["repo_id"], ["seq"],
                   {"current_generation": ("max", F.col("generation"))})


def session_summary(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline and current generation per repository, and whether it ever reconciled."""
    seen = events.groupBy("repo_id").agg(
        F.max("generation").alias("seen"),
        F.max(F.col("type") == "reconcile.checkpoint").alias("reconciled"))
    return baseline.join(seen, "repo_id", "left").select(
        "repo_id", "baseline_generation",
        F.greatest("baseline_generation", "seen").alias("current_generation"),
        F.coalesce("reconciled", F.lit(False)).alias("reconciled"))


def summary_line(event_columns: list[str]) -> Column:
    """One line of text for an event."""
    have = set(event_columns)

    def col(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    def total(*names):
        return sum((F.greatest(F.coalesce(F.size(n), F.lit(0)), F.lit(0)) for n in names if n in have),
                   F.lit(0)).cast("string")

    def suffix(mark, name):
        return F.when(col(name) != "", F.concat(F.lit(mark), col(name))).otherwise(F.lit(""))

    session = F.col("session.name") if "session" in have else F.lit("")
    impacted = total("impacted_nodes")
    return (
        F.when(F.col("type") == "session.started", F.concat(F.lit("session "), F.coalesce(session, F.lit(""))))
        .when(F.col("type") == "file.changed",
              F.concat(col("change"), F.lit(" "), col("path"), F.lit(" ("), col("processing"), F.lit(")")))
        .when(F.col("type") == "graph.updated",
              F.concat(F.lit("+"), total("added_nodes", "added_edges"),
                       F.lit(" ~"), total("updated_nodes", "updated_edges"),
                       F.lit(" -"), total("removed_nodes", "removed_edges"), suffix("  ", "note")))
        .when(F.col("type") == "impact.updated",
              F.concat(col("level"), F.lit(" impact: "), impacted, F.lit(" node(s)")))
        .when(F.col("type") == "adapter.status",
              F.concat(col("adapter"), F.lit(": "), col("state"), suffix(" - ", "message")))
        .when(F.col("type") == "reconcile.checkpoint", F.concat(F.lit("reconcile: "), col("message"))))


def event_log(events: DataFrame, limit: int = LOG_LIMIT) -> DataFrame:
    """The newest ``limit`` events of each repository as text.

    A small limit bounds the ranking, so Spark keeps at most ``limit`` rows per repository
    in every partition before anything is shuffled; a large one numbers rows in blocks.
    """
    newest = Window.partitionBy("repo_id").orderBy(F.col("seq").desc())
    lines = events.select("repo_id", "seq", "t_ms", "generation", "type",
                          summary_line(events.columns).alias("summary"))
    if limit > _RANK_BOUND:
        back = lines.withColumn("back", -F.col("seq"))
        return sequence_number(back, ["repo_id"], ["back"], "age").where(F.col("age") < limit).drop("age", "back")
    return lines.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit).drop("age")


def timeline_markers(events: DataFrame) -> DataFrame:
    """Moments worth a tick: first beat of a change, graph notes, reconciliations."""
    label = (F.when((F.col("type") == "file.changed") & (F.col("processing") == "pending"),
                    F.concat_ws(" ", "change", "path"))
             .when((F.col("type") == "graph.updated") & (F.col("note") != ""), F.col("note"))
             .when(F.col("type") == "reconcile.checkpoint", F.lit("reconcile")))
    return events.select("repo_id", "seq", "t_ms", label.alias("label")).where("label is not null")


def endpoint_warnings(nodes: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edge upserts whose end did not exist at that moment: repo_id, id, seq, src, dst, end.

    Node operations and edge ends are merged into one order per node; the running last
    operation tells whether the node was there. Hot nodes span many blocks.
    """
    life = _baseline_ops(nodes, NODE).unionByName(node_ops(events)).select(
        "repo_id", F.col("id").alias("end"), "at", F.lit("").alias("id"), F.col("op"),
        F.lit("").alias("src"), F.lit("").alias("dst"))
    asked = (_baseline_ops(edges, EDGE).unionByName(edge_ops(events)).where("op = 'upsert'")
             .select("repo_id", F.explode(F.array_distinct(F.array("body.src", "body.dst"))).alias("end"),
                     "at", "id", F.lit(None).cast("string").alias("op"), "body.src", "body.dst"))
    seen = running(life.unionByName(asked), ["repo_id", "end"], ["at", "id"],
                   {"state": ("last", F.col("op"))})
    return seen.where("op is null and (state is null or state = 'remove')").select(
        "repo_id", "id", F.col("at.seq").alias("seq"), "src", "dst", "end")
