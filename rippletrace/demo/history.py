"""Event-log questions over a log rendered from the events table, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fleet
from ..operators import diff, temporal
from ..plans.durable import new_path, stored
from .. import schemas as S
from ..schemas import EDGES, NODES
from ..sources import events as reader
from ..sources import snapshot
from ..streaming import live
from .sqltext import ask

# One line of JSON per event. Plain changes, graph updates, adapter reports, impact
# results and checkpoints alternate by event id, so every payload type occurs.
_RENDER = """
CASE kind
  WHEN 0 THEN '{"type":"file.changed","t_ms":' || t || ',"generation":' || gen || ',"path":"src/' || u || '.py","change":"'
       || change || '"' || CASE WHEN seq % 3 = 0 THEN ',"from_path":"old/' || u || '.py"' ELSE '' END
       || ',"processing":"' || processing || '"}'
  WHEN 1 THEN '{"type":"graph.updated","t_ms":' || t || ',"generation":' || gen
       || ',"added_nodes":[{"id":"n:' || u || '","kind":"file","path":"src/' || u || '.py","attrs":{"k":' || k || '}}]'
       || ',"added_edges":[{"id":"e:' || u || '-' || w || '","kind":"imports","from":"n:' || u || '","to":"n:' || w || '","valid_from":' || gen
       || CASE WHEN k % 7 = 0 THEN ',"valid_to":' || (gen + 1) ELSE '' END || '}],"note":"step ' || k || '"}'
  WHEN 2 THEN '{"type":"graph.updated","t_ms":' || t || ',"generation":' || gen
       || CASE WHEN k % 2 = 0 THEN ',"removed_nodes":["n:' || u || '"]' ELSE ',"removed_edges":["e:' || u || '-' || w || '"]' END
       || ',"updated_edges":[{"id":"e:' || w || '-' || u || '","kind":"imports","from":"n:' || w || '","to":"n:' || u || '"}]}'
  WHEN 3 THEN CASE WHEN k % 3 = 0 THEN '{"type":"reconcile.checkpoint","t_ms":' || t || ',"generation":' || gen || ',"corrections":' || k || ',"message":"m' || k || '"}'
       WHEN k % 3 = 1 THEN '{"type":"impact.updated","t_ms":' || t || ',"generation":' || gen || ',"level":"file","seed_nodes":["n:' || u
            || '"],"impacted_nodes":[{"node_id":"n:' || u || '"},{"node_id":"n:' || w || '","min_distance":1}]}'
       ELSE '{"type":"adapter.status","t_ms":' || t || ',"generation":' || gen || ',"adapter":"a' || (k % 10) || '","state":"running","queue_depth":' || k || '}' END
  ELSE CASE WHEN k % 5 = 0 THEN '{"type":"nonsense"}' WHEN k % 5 = 1 THEN 'not json' WHEN k % 5 = 2 THEN '{"type":"file.changed","path":"x","change":"odd"}'
       ELSE '{"type":"file.changed","t_ms":' || t || ',"generation":' || gen || ',"path":"src/' || u || '.py"}' END
  END"""
_ROWS = """
SELECT 'h' || CAST(user_id % 5 AS STRING) AS repo_id, event_id AS seq,
       CAST(event_id % 5 AS INT) AS kind, CAST(user_id AS STRING) AS u,
       CAST((user_id * 7 + 3) % 50 AS STRING) AS w, CAST(100 + event_id - (event_id * 31) % 40 AS STRING) AS gen,
       CAST(event_id AS STRING) || '.5' AS t, @K@ AS k,
       CASE event_type WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted'
                       WHEN 'signup' THEN 'renamed' ELSE 'modified' END AS change,
       CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'structural'
            WHEN event_id % 4 = 2 THEN 'semantic' ELSE 'settled' END AS processing
FROM @events@"""
_K_SPARK = "CAST(get_json_object(props, '$.k') AS INT)"
_K_SQL = "CAST(json_extract_string(props, '$.k') AS INT)"


def _lines(spark, sf):
    rows = spark.sql(_ROWS.replace("@K@", _K_SPARK).replace("@events@", "{events}"),
                     events=fleet.read_tables(spark, sf)["events"])
    return _render(rows)


def _render(rows):
    return rows.select("repo_id", "seq", F.expr(_RENDER).alias("value"))


_stored: dict[tuple[str, str], object] = {}


def _decoded(spark, sf):
    """The decoded log, written once per application and read by every question."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        lines = _lines(spark, sf).withColumn("line", F.col("value"))
        _stored[key] = stored(reader.decode_events(lines), "log")
    return _stored[key]


def _events(spark, sf):
    return reader.validate_events(_decoded(spark, sf))[0]


def _empty(spark):
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def decoded_events(spark, sf):
    return _events(spark, sf).select("repo_id", "seq", "type", "t_ms", "generation", "node_id", "change",
                                     "processing", "from_path")


def quarantined_events(spark, sf):
    _, bad = reader.validate_events(_decoded(spark, sf))
    return bad.select("repo_id", "seq", "problem")


def changed_files(spark, sf):
    return temporal.changed_files(_events(spark, sf))


def changed_files_until(spark, sf):
    return temporal.changed_files(temporal.events_until(_events(spark, sf), 4000.5)).select(
        "repo_id", "node_id", "change")


def adapter_status(spark, sf):
    return temporal.adapter_status(_events(spark, sf)).select(
        "repo_id", "adapter", "state", "queue_depth", "first_seq")


def latest_impact(spark, sf):
    return temporal.latest_impact(_events(spark, sf)).select(
        "repo_id", "level", "seq", "generation", F.array_join("seed_nodes", ",").alias("seeds"))


def checkpoints(spark, sf):
    return temporal.checkpoints(_events(spark, sf))


def current_generation(spark, sf):
    return temporal.current_generation(_events(spark, sf)).select("repo_id", "seq", "current_generation")


def session_summary(spark, sf):
    ev = _events(spark, sf)
    base = ev.groupBy("repo_id").agg(F.min("generation").alias("baseline_generation"))
    return temporal.session_summary(ev, base)


def event_log(spark, sf):
    return temporal.event_log(_events(spark, sf), 512).select("repo_id", "seq", "type", "summary")


def timeline_markers(spark, sf):
    return temporal.timeline_markers(_events(spark, sf))


def graph_nodes_at(spark, sf):
    nodes, _ = temporal.state_at(*_empty(spark), _events(spark, sf))
    return nodes.select("repo_id", "id", "kind", "name", "path", F.col("attrs")["k"].alias("k"))


def graph_edges_at(spark, sf):
    _, edges = temporal.state_at(*_empty(spark), _events(spark, sf))
    return edges.select("repo_id", "id", "src", "dst", "valid_from", "valid_to", "provider")


def graph_edges_midway(spark, sf):
    _, edges = temporal.state_at(*_empty(spark), temporal.first_n(_events(spark, sf), 5000))
    return edges.select("repo_id", "id", "src", "dst", "valid_from", "valid_to")


def graph_delta(spark, sf):
    ev = _events(spark, sf)
    before, _ = temporal.state_at(*_empty(spark), ev, 5000)
    after, _ = temporal.state_at(*_empty(spark), ev)
    return diff.graph_delta(before, after)


def endpoint_warnings(spark, sf):
    return temporal.endpoint_warnings(*_empty(spark), _events(spark, sf)).select(
        "repo_id", "id", "seq", F.col("end").alias("missing"))


def generation_violations(spark, sf):
    return live.generation_violations(_events(spark, sf))


def dead_letters(spark, sf):
    return live.dead_letters(_decoded(spark, sf)).select("repo_id", "seq", "problem", "line")


def change_bursts(spark, sf):
    ev = _events(spark, sf).where("type = 'file.changed'").withColumn("t_ms", F.col("t_ms") * 10)
    return live.coalesce_bursts(ev.select("repo_id", "seq", "t_ms", "path", "change"))


def _stream(spark, sf):
    return (spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
            .option("pathGlobFilter", "events.parquet").parquet(sf))


def _live_events(spark, sf):
    rows = _ROWS.replace("@K@", _K_SPARK)
    fields = rows[rows.index("SELECT") + 6:rows.index("FROM @events@")]
    view = f"live_events_{abs(hash(new_path(spark, 'v')))}"
    _stream(spark, sf).createOrReplaceTempView(view)
    lines = _render(spark.sql(f"SELECT {fields} FROM {view}"))
    return reader.decode_events(lines).where("problem is null").drop("problem")


def _written_log(spark, sf):
    """The rendered log as text files, a folder per repository; written once per application."""
    key = (spark.sparkContext.applicationId, sf, "files")
    if key not in _stored:
        path = new_path(spark, "log-files")
        _lines(spark, sf).select("repo_id", "value").write.partitionBy("repo_id").text(path)
        _stored[key] = path
    return _stored[key]


def events_read_back(spark, sf):
    """The log written as lines and read from its files."""
    found = reader.read_events(spark, _written_log(spark, sf), F.regexp_extract("file", "repo_id=([^/]+)", 1))
    good, _ = reader.validate_events(found)
    return good.select("repo_id", "type", "t_ms", "generation", "node_id", "change", "processing", "from_path")


def changed_files_from_files(spark, sf):
    """The same files as a stream: read as they arrive, decoded, folded into the table of changed files."""
    place = F.regexp_extract(F.col("_metadata.file_path"), "repo_id=([^/]+)", 1)
    seq = (F.get_json_object("value", "$.t_ms").cast("double") - 0.5).cast("long")
    source = live.stream_events(spark, _written_log(spark, sf) + "/*", place, seq).where("problem is null").drop("problem")
    return live.changed_files_stream(source, new_path(spark, "table"), new_path(spark, "progress")).drop("deleted")


def nodes_read_back(spark, sf):
    """The fleet written as one document per repository and read again."""
    n, e = fleet.nodes(spark, sf), fleet.edges(spark, sf)
    named = {name: F.lit(name) for name in ("root", "head", "branch", "session_id", "session_name")}
    meta = n.select("repo_id", F.col("repo_id").alias("name")).distinct().withColumns(named | {
        "generation": F.lit(3).cast("long"), "baseline_generation": F.lit(1).cast("long"), "detached": F.lit(False)})
    path = new_path(spark, "snapshots")
    snapshot.write_snapshot(n.select("repo_id", *[f.name for f in S.NODE.fields]),
                            e.select("repo_id", *[f.name for f in S.EDGE.fields]), meta, path, "fleet.snapshot/1")
    nodes, _, _ = snapshot.read_snapshot(spark, path)
    return nodes.select("repo_id", "id", "kind", "path", "parent", "freshness")


def changed_files_streamed(spark, sf):
    return live.changed_files_stream(_live_events(spark, sf), new_path(spark, "table"),
                                     new_path(spark, "progress")).drop("deleted")


def adapter_status_streamed(spark, sf):
    return live.adapter_status_stream(_live_events(spark, sf), new_path(spark, "table"),
                                      new_path(spark, "progress")).select(
        "repo_id", "adapter", "state", "queue_depth", "first_seq")


def latest_impact_streamed(spark, sf):
    table = live.latest_impact_stream(_live_events(spark, sf), new_path(spark, "table"),
                                      new_path(spark, "progress"))
    return table.select("repo_id", "level", "seq", F.col("result.generation").alias("generation"),
                        F.array_join("result.seed_nodes", ",").alias("seeds"))


def graph_edges_streamed(spark, sf):
    _, edges = live.fold_stream(_live_events(spark, sf), *_empty(spark), new_path(spark, "state"),
                                new_path(spark, "progress"))
    return edges.select("repo_id", "id", "src", "dst", "valid_from", "valid_to", "provider")


def generation_violations_streamed(spark, sf):
    query, found = live.violations(_live_events(spark, sf), new_path(spark, "monitor"), new_path(spark, "progress"))
    query.awaitTermination()
    return found()


def bursts_streamed(spark, sf):
    change = (F.when(F.col("event_type") == "purchase", F.lit("created"))
              .when(F.col("event_type") == "error", F.lit("deleted")).otherwise(F.lit("modified")))
    changes = _stream(spark, sf).select(
        F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("repo_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 7).cast("string").alias("path"), change.alias("change"))
    out = live.burst_stream(changes, "10 minutes", new_path(spark, "bursts"), new_path(spark, "progress"))
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.withColumn("burst_start", F.date_format("burst_start", stamp)).withColumn(
        "burst_end", F.date_format("burst_end", stamp))


_LOG = f"""
rendered AS MATERIALIZED ({_ROWS.replace('@K@', _K_SQL).replace('@events@', 'events')}),
log AS MATERIALIZED (
  SELECT repo_id, seq, kind, u, w, k, CAST(t AS DOUBLE) AS t_ms, CAST(gen AS BIGINT) AS generation,
    CASE WHEN kind IN (0, 4) THEN 'file.changed' WHEN kind IN (1, 2) THEN 'graph.updated'
         WHEN k % 3 = 0 THEN 'reconcile.checkpoint' WHEN k % 3 = 1 THEN 'impact.updated' ELSE 'adapter.status' END AS type,
    CASE WHEN kind = 0 THEN change WHEN kind = 4 THEN 'modified' END AS change,
    CASE WHEN kind = 0 THEN processing WHEN kind = 4 THEN 'pending' END AS processing,
    CASE WHEN kind = 0 AND seq % 3 = 0 THEN 'old/' || u || '.py' WHEN kind IN (0, 4) THEN '' END AS from_path,
    'src/' || u || '.py' AS path
  FROM rendered WHERE kind <> 4 OR k % 5 > 2)"""
_OPS = """
node_op AS MATERIALIZED (
  SELECT repo_id, 'n:' || u AS id, seq, 'up' AS op, path, k FROM log WHERE kind = 1
  UNION ALL SELECT repo_id, 'n:' || u, seq, 'rm', NULL, NULL FROM log WHERE kind = 2 AND k % 2 = 0),
edge_op AS MATERIALIZED (
  SELECT repo_id, 'e:' || u || '-' || w AS id, seq, 2 AS sub, 'up' AS op, 'n:' || u AS src, 'n:' || w AS dst,
         generation AS valid_from, CASE WHEN k % 7 = 0 THEN generation + 1 END AS valid_to FROM log WHERE kind = 1
  UNION ALL SELECT repo_id, 'e:' || w || '-' || u, seq, 3, 'up', 'n:' || w, 'n:' || u, 0, NULL FROM log WHERE kind = 2
  UNION ALL SELECT repo_id, 'e:' || u || '-' || w, seq, 4, 'rm', NULL, NULL, NULL, NULL FROM log WHERE kind = 2 AND k % 2 = 1)"""


def _state(limit: str = "") -> str:
    """Nodes and edges after the log, by window functions."""
    where = f"WHERE seq {limit}" if limit else ""
    return f"""
node_seen AS MATERIALIZED (
  SELECT *, lag(op) OVER (PARTITION BY repo_id, id ORDER BY seq) AS prev,
         row_number() OVER (PARTITION BY repo_id, id ORDER BY seq DESC) AS age FROM node_op {where}),
node_now AS (SELECT repo_id, id, path, k FROM node_seen WHERE age = 1 AND op = 'up'),
removal AS MATERIALIZED (SELECT repo_id, id, max(seq) AS seq FROM node_seen WHERE op = 'rm' AND prev = 'up' GROUP BY repo_id, id),
edge_now AS (
  SELECT e.repo_id, e.id, e.src, e.dst, e.valid_from, e.valid_to FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY seq DESC, sub DESC) AS age FROM edge_op {where}) e
  LEFT JOIN removal a ON a.repo_id = e.repo_id AND a.id = e.src AND a.seq >= e.seq
  LEFT JOIN removal b ON b.repo_id = e.repo_id AND b.id = e.dst AND b.seq >= e.seq
  WHERE e.age = 1 AND e.op = 'up' AND (e.valid_to IS NOT NULL OR (a.id IS NULL AND b.id IS NULL)))"""


def _ask(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (_LOG, *parts)) + "\n" + select


_CHANGED = """
SELECT repo_id, 'file:' || path AS node_id,
       CASE WHEN bool_or(change = 'deleted') THEN 'deleted' ELSE min_by(change, seq) END AS change,
       min_by(from_path, seq) AS from_path, max_by(path, seq) AS path, max_by(processing, seq) AS processing,
       max_by(generation, seq) AS generation, max_by(t_ms, seq) AS t_ms, min(seq) AS first_seq
FROM log WHERE type = 'file.changed' GROUP BY repo_id, path"""
_ADAPTER = """
SELECT repo_id, 'a' || CAST(k % 10 AS STRING) AS adapter, 'running' AS state, max_by(k, seq) AS queue_depth,
       min(seq) AS first_seq FROM log WHERE type = 'adapter.status' GROUP BY repo_id, k % 10"""
_EDGES = ("SELECT repo_id, id, src, dst, valid_from, valid_to, 'unknown' AS provider FROM edge_now")
_BAD = """
bad AS (SELECT repo_id, seq, CASE WHEN k % 5 = 0 THEN 'unknown value for type: nonsense'
  WHEN k % 5 = 1 THEN 'not a JSON object' ELSE 'unknown value for change: odd' END AS problem,
  CASE WHEN k % 5 = 0 THEN '{"type":"nonsense"}' WHEN k % 5 = 1 THEN 'not json'
       ELSE '{"type":"file.changed","path":"x","change":"odd"}' END AS line
  FROM rendered WHERE kind = 4 AND k % 5 <= 2)"""

QUERIES = {f.__name__: f for f in (
    decoded_events, quarantined_events, changed_files, changed_files_until, adapter_status, latest_impact,
    checkpoints, current_generation, session_summary, event_log, timeline_markers, graph_nodes_at,
    graph_edges_at, graph_edges_midway, graph_delta, endpoint_warnings, generation_violations,
    generation_violations_streamed,
    dead_letters, change_bursts, events_read_back, changed_files_from_files, nodes_read_back, changed_files_streamed, adapter_status_streamed, latest_impact_streamed,
    graph_edges_streamed,
    bursts_streamed)}

SQL = {
    "decoded_events": _ask("""
SELECT repo_id, seq, type, t_ms, generation, CASE WHEN type = 'file.changed' THEN 'file:' || path END AS node_id,
       change, processing, from_path FROM log"""),
    "quarantined_events": _ask("SELECT repo_id, seq, problem FROM bad", _BAD),
    "changed_files": _ask(_CHANGED),
    "changed_files_until": _ask(
        "SELECT repo_id, node_id, change FROM (" + _CHANGED.replace(
            "WHERE type = 'file.changed'", "WHERE type = 'file.changed' AND t_ms <= 4000.5") + ") x"),
    "adapter_status": _ask(_ADAPTER),
    "latest_impact": _ask("""
SELECT repo_id, 'file' AS level, max(seq) AS seq, max_by(generation, seq) AS generation,
       max_by('n:' || u, seq) AS seeds FROM log WHERE type = 'impact.updated' GROUP BY repo_id"""),
    "checkpoints": _ask("SELECT repo_id, seq, generation, k AS corrections, 'm' || k AS message FROM log "
                        "WHERE type = 'reconcile.checkpoint'"),
    "current_generation": _ask("SELECT repo_id, seq, max(generation) OVER (PARTITION BY repo_id ORDER BY seq) "
                               "AS current_generation FROM log"),
    "session_summary": _ask("""
SELECT repo_id, min(generation) AS baseline_generation, max(generation) AS current_generation,
       bool_or(type = 'reconcile.checkpoint') AS reconciled FROM log GROUP BY repo_id"""),
    "event_log": _ask("""
SELECT repo_id, seq, type, CASE type
  WHEN 'file.changed' THEN change || ' ' || path || ' (' || processing || ')'
  WHEN 'graph.updated' THEN CASE WHEN kind = 1 THEN '+2 ~0 -0  step ' || k ELSE '+0 ~1 -1' END
  WHEN 'impact.updated' THEN 'file impact: 2 node(s)'
  WHEN 'adapter.status' THEN 'a' || (k % 10) || ': running'
  ELSE 'reconcile: m' || k END AS summary
FROM log QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) <= 512"""),
    "timeline_markers": _ask("""
SELECT repo_id, seq, t_ms, CASE WHEN type = 'file.changed' THEN change || ' ' || path
  WHEN type = 'graph.updated' THEN 'step ' || k ELSE 'reconcile' END AS label FROM log
WHERE (type = 'file.changed' AND processing = 'pending') OR kind = 1 OR type = 'reconcile.checkpoint'"""),
    "graph_nodes_at": _ask("SELECT repo_id, id, 'file' AS kind, id AS name, path, CAST(k AS STRING) AS k FROM node_now",
                           _OPS, _state()),
    "graph_edges_at": _ask(_EDGES, _OPS, _state()),
    "graph_edges_midway": _ask("SELECT repo_id, id, src, dst, valid_from, valid_to FROM edge_now", _OPS, _state("< 5000")),
    "graph_delta": _ask("""
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.id, b.id) AS id,
       CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS change,
       a.id IS NULL OR b.id IS NULL AS topology
FROM mid a FULL JOIN node_now b ON a.repo_id = b.repo_id AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.k <> b.k""", _OPS, """
mid AS (SELECT repo_id, id, path, k FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY seq DESC) AS age FROM node_op WHERE seq <= 5000) m
  WHERE age = 1 AND op = 'up')""", _state()),
    "endpoint_warnings": _ask("""
SELECT x.repo_id, x.id, x.seq, x.missing FROM (
  SELECT repo_id, id, seq, unnest(list_distinct([src, dst])) AS missing FROM edge_op WHERE op = 'up') x
ASOF LEFT JOIN present n ON n.repo_id = x.repo_id AND n.id = x.missing AND n.at <= x.seq
WHERE n.op IS NULL OR n.op = 'rm'""", _OPS, """
present AS (SELECT repo_id, id, op, CASE WHEN op = 'rm' THEN seq + 0.5 ELSE seq END AS at FROM node_op)"""),
    "generation_violations": _ask("""
SELECT repo_id, seq, generation, highest FROM (
  SELECT *, max(generation) OVER (PARTITION BY repo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest
  FROM log) x WHERE generation < highest"""),
    "generation_violations_streamed": _ask("""
SELECT repo_id, seq, generation, highest FROM (
  SELECT *, max(generation) OVER (PARTITION BY repo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest
  FROM log) x WHERE generation < highest"""),
    "dead_letters": _ask("SELECT repo_id, seq, problem, line FROM bad "
                         "QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) <= 200", _BAD),
    "change_bursts": _ask("""
SELECT repo_id, burst, min(t) AS start_ms, max(t) AS end_ms, count(*) AS changes, count(DISTINCT path) AS paths,
       count(DISTINCT CASE WHEN change = 'modified' THEN path END)
       + max(CASE WHEN change <> 'modified' THEN 1 ELSE 0 END) AS generations FROM (
  SELECT *, sum(opens) OVER (PARTITION BY repo_id ORDER BY seq) AS burst FROM (
    SELECT *, t_ms * 10 AS t, CASE WHEN t_ms * 10 - lag(t_ms * 10) OVER (PARTITION BY repo_id ORDER BY seq) < 120
           THEN 0 ELSE 1 END AS opens FROM log WHERE type = 'file.changed') a) b
GROUP BY repo_id, burst"""),
    "events_read_back": _ask("""
SELECT repo_id, type, t_ms, generation, CASE WHEN type = 'file.changed' THEN 'file:' || path END AS node_id,
       change, processing, from_path FROM log"""),
    "changed_files_from_files": _ask(_CHANGED),
    "nodes_read_back": ask("SELECT repo_id, id, kind, path, parent, freshness FROM nodes"),
    "changed_files_streamed": _ask(_CHANGED),
    "adapter_status_streamed": _ask(_ADAPTER),
    "latest_impact_streamed": _ask("""
SELECT repo_id, 'file' AS level, max(seq) AS seq, max_by(generation, seq) AS generation,
       max_by('n:' || u, seq) AS seeds FROM log WHERE type = 'impact.updated' GROUP BY repo_id"""),
    "graph_edges_streamed": _ask(_EDGES, _OPS, _state()),
    "bursts_streamed": """
WITH e AS (SELECT 'h' || CAST(user_id % 5 AS STRING) AS repo_id, ts, event_id, CASE event_type
             WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change FROM events),
o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY repo_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM e),
b AS (SELECT *, sum(opens) OVER (PARTITION BY repo_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT repo_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS burst_start, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS burst_end,
       count(*) AS changes, count(*) FILTER (change = 'modified') AS modified, bool_or(change <> 'modified') AS structural,
       count(DISTINCT CASE WHEN change = 'modified' THEN event_id % 7 END) + bool_or(change <> 'modified')::INT AS generations
FROM b GROUP BY repo_id, burst""",
}
