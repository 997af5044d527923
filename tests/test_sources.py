"""Snapshot and event files, sinks, streams, and a sample of the registered questions."""

import json

import pytest
from conftest import rows

from rippletrace.demo import all_queries, all_sql
from rippletrace.sources import events as reader
from rippletrace.sources import snapshot
from rippletrace.streaming import changed_files_stream, stream_events
from pyspark.sql import functions as F

DOC = """{ // comment
  "schema": "demo.snapshot/1", "repo": {"name": "one"}, "session": {"id": "s", "baseline_generation": 7},
  "nodes": [{"id": "file:a", "kind": "file", "attrs": {"n": 3, "t": "x"}}, {"id": "file:b", "kind": "file", "name": "b"}],
  "edges": [{"id": "e1", "kind": "imports", "from": "file:a", "to": "file:b"}]
}"""


def test_snapshot_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.json").write_text(DOC)
    nodes, edges, meta = snapshot.read_snapshot(spark, str(tmp_path / "in"))
    assert rows(nodes.select("repo_id", "id", "name", "freshness", nodes.attrs["n"].alias("n")).fillna("-")) == [
        ("one", "file:a", "file:a", "current", "3"), ("one", "file:b", "b", "current", "-")]
    assert rows(edges, "id", "src", "dst", "provider", "confidence", "valid_from") == [
        ("e1", "file:a", "file:b", "unknown", "exact", 0)]
    assert rows(meta, "generation") == [(7,)]
    assert snapshot.snapshot_problems(nodes, edges).count() == 0
    snapshot.write_snapshot(nodes, edges, meta, str(tmp_path / "out"), "demo.snapshot/1")
    again, _, _ = snapshot.read_snapshot(spark, str(tmp_path / "out"))
    assert rows(again, "id", "name") == rows(nodes, "id", "name")


def test_other_versions_are_refused(spark, tmp_path):
    (tmp_path / "doc.json").write_text(DOC.replace("snapshot/1", "snapshot/2"))
    nodes, _, _ = snapshot.read_snapshot(spark, str(tmp_path), strict=False)
    assert nodes.count() == 0
    with pytest.raises(Exception, match="unsupported snapshot version"):
        snapshot.read_snapshot(spark, str(tmp_path))[0].collect()


def test_event_files_keep_stable_time_order(spark, tmp_path):
    lines = ["// log", "", '{"t_ms": 20, "type": "file.changed", "path": "b", "change": "created"}',
             '{"t_ms": 10, "type": "file.changed", "path": "a"}', '{"t_ms": 20, "type": "file.changed", "path": "c"}',
             '{"t_ms": 5, "type": "file.changed"}', '{"type": "reconcile.checkpoint", "t_ms": 30}']
    (tmp_path / "one.jsonl").write_text("\n".join(lines))
    got = reader.read_events(spark, str(tmp_path))
    good, bad = reader.validate_events(got)
    assert [(r.seq, r.path, r.node_id, r.origin.rsplit(":", 1)[1]) for r in good.orderBy("seq").collect()] == [
        (1, "a", "file:a", "4"), (2, "b", "file:b", "3"), (3, "c", "file:c", "5"), (4, None, None, "7")]
    assert rows(bad, "seq", "problem") == [(0, "missing path")]
    with pytest.raises(Exception, match="missing path"):
        reader.validate_events(got, strict=True)[0].collect()
    snapshot.write_events(good.drop("origin"), str(tmp_path / "out"))
    assert reader.read_events(spark, str(tmp_path / "out" / "*"), F.lit("r")).count() == 4


def test_stream_keeps_changed_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, (path, change) in enumerate([("a", "created"), ("a", "modified"), ("b", "deleted")]):
        (source / f"{n}.jsonl").write_text(json.dumps(
            {"type": "file.changed", "path": path, "change": change, "t_ms": n}) + "\r\n\nbroken\n")
    stream = stream_events(spark, str(source), F.lit("r"), F.regexp_extract("_metadata.file_path", r"(\d+)\.jsonl", 1)
                           .cast("long"))
    table = changed_files_stream(stream.where("problem is null"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert rows(table, "node_id", "change", "first_seq") == [("file:a", "created", 0), ("file:b", "deleted", 2)]


def test_every_question_has_a_name_and_sql():
    assert set(all_sql()) == set(all_queries())
