"""Long and dirty text, odd graphs and streams that stop: inputs that once failed or went wrong."""

from conftest import rows

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.functions import valid_patterns
from rippletrace.operators import ancestry, diff, integrity, resolve
from rippletrace.schemas import EDGES, NODES
from rippletrace.sources import manifests, scan, snapshot, tree
from rippletrace.streaming import live

LONG = "x" * 200_000


def files(spark, mapping):
    return spark.createDataFrame([("r", k, v) for k, v in mapping.items()], "repo_id string, rel string, content string")


def test_long_literals_in_every_language(spark):
    df = files(spark, {
        "a.cpp": f'const char* s = "{LONG}\\"{LONG}";\n#{" " * 50_000}include "a.h"\nauto r = R"({LONG})";\n',
        "b.ts": f"const s = '{LONG}', t = `{LONG}`;\nconst r = require(\"{LONG}\");\nimport x from './x'\n",
        "c.py": f's = "{LONG}"\nt = """{LONG}"""\nimport mod\n',
        "p/pyproject.toml": f'[project]\nname = "p"\ndependencies = ["{LONG}", "numpy"]\n',
        "q/package.json": f'{{"name": "q", "main": "{LONG}", "dependencies": {{"d": "{LONG}"}}}}',
        "CMakeLists.txt": f'add_library(lib "{LONG}" a.cpp)\n'})
    assert rows(scan.cpp_includes(df), "path") == [("a.h",)]
    assert rows(scan.ts_import_specs(df), "line", "spec") == [(2, LONG), (3, "./x")]
    assert rows(scan.python_import_stmts(scan.parse_python(df)), "module") == [("mod",)]
    assert {r.name for r in manifests.packages(df)[1].collect()} == {LONG, "numpy", "d"}
    assert [r.sources for r in manifests.build_targets(df).collect()] == [[LONG, "a.cpp"]]


def test_calls_of_any_depth_and_first_of_a_line(spark):
    deep = "(" * 10 + "x" + ")" * 10
    text = (f"add_library(a a.cpp $<IF:{deep},1,2> b.cpp)\n"
            'add_executable(b "((((x))))" c.cpp) add_library(c d.cpp)\n'
            "add_library (d STATIC\n  e.cpp # no.cpp\n  f.cpp) add_library(e g.cpp)\n"
            "my_add_library(f h.cpp)\nadd_library(g ALIAS a)\nadd_library(open i.cpp\n")
    got = rows(manifests.build_targets(files(spark, {"s/CMakeLists.txt": text})), "line", "name", "kind", "sources")
    assert got == [(1, "a", "library", ["s/a.cpp", "s/b.cpp"]), (2, "b", "executable", ["s/((((x))))", "s/c.cpp"]),
                   (3, "d", "library", ["s/e.cpp", "s/f.cpp"]), (8, "open", "library", ["s/i.cpp"])]


def test_many_statements_on_a_line_keep_their_order(spark):
    text = "; ".join(f"import a{k}" for k in range(1000)) + "; import m1\nimport m2\n"
    df = files(spark, {"x.py": text, "m1.py": "", "m2.py": ""})
    stmts = scan.python_import_stmts(scan.parse_python(df))
    assert [r.module for r in stmts.orderBy("ord").collect()][-2:] == ["m1", "m2"]
    listing = tree.listing_of(df)
    roots = resolve.python_roots(listing, spark.createDataFrame([], "repo_id string, rel string"))
    assert rows(resolve.resolve_python(stmts, roots, df), "dst", "line") == [("m1.py", 1), ("m2.py", 2)]


def test_names_after_any_blanks(spark):
    gap = " " * 40
    text = f"from m import f\nobj.{gap}f\ndef{gap}f(): pass\nf{gap}(1)\n"
    uses = scan.python_uses(scan.parse_python(files(spark, {"x.py": text})))
    assert rows(uses, "line", "name", "call") == [(4, "f", True)]


def _candidates(spark, n_roots):
    py = {f"pkgs/p{k}/mod.py": "" for k in range(40)} | {f"inc/i{k}.h": "" for k in range(40)}
    df = files(spark, py)
    roots = spark.createDataFrame([("r", f"pkgs/p{k}", k) for k in range(n_roots)] + [("r", "inc", n_roots)],
                                  "repo_id string, root string, n int").select(
        "repo_id", "root", F.struct(F.col("n").alias("group"), F.col("root").alias("rel")).alias("ord"))
    return (resolve._modules(df, roots).count(), resolve._climbed(df, roots).where("ups < 2").count())


def test_candidates_do_not_multiply_by_roots(spark):
    few, many = _candidates(spark, 40), _candidates(spark, 2000)
    assert few == many


def test_includes_that_climb_out_of_their_root(spark):
    df = files(spark, {"lib/inc/a.h": "", "lib/b.h": "", "src/m.cpp": '#include <../b.h>\n#include <x/../a.h>\n#include <../../no.h>\n'})
    got = resolve.resolve_cpp(scan.cpp_includes(df), resolve.cpp_roots(tree.listing_of(df)), df)
    assert rows(got, "dst", "line") == [("lib/b.h", 1), ("lib/inc/a.h", 2)]
    roots = spark.createDataFrame([("r", "lib/inc", (1, "lib/inc"))], "repo_id string, root string, ord struct<group:int,rel:string>")
    got = resolve.resolve_cpp(scan.cpp_includes(df), roots, df)
    assert rows(got, "dst", "line") == [("lib/b.h", 1), ("lib/inc/a.h", 2)]


def test_trees_with_odd_names_and_bytes(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "sub").mkdir(parents=True)
    (root / "p.png").write_bytes(b"\x89PNG\xff\xfe\x00")
    (root / "sub" / "l.py").write_bytes("import x # é".encode("latin-1"))
    (root / "u.py").write_text("import é", encoding="utf-8")
    got = {r.rel: r.content for r in tree.read_tree(spark, str(root), "r").collect()}
    assert set(got) == {"p.png", "sub/l.py", "u.py"}
    assert got["sub/l.py"] == "import x # é" and got["u.py"] == "import é"
    assert rows(tree.list_tree(spark, str(root), "r", "*.py"), "rel") == [("sub/l.py",), ("u.py",)]


def test_parent_cycles_give_each_ancestor_once(spark):
    nodes = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a")], "repo_id string, id string, parent string")
    chain = ancestry.container_chain(nodes)
    assert rows(chain, "node", "ancestor", "depth") == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0)]


def test_maps_compare_without_key_order(spark):
    schema = "repo_id string, id string, attrs map<string,string>"
    was = spark.createDataFrame([("r", "n", {"a": "1", "b": "2"}), ("r", "m", {"a": "1"})], schema)
    now = spark.createDataFrame([("r", "n", {"b": "2", "a": "1"}), ("r", "m", {"a": "2"})], schema)
    assert rows(diff.graph_delta(was, now), "id", "change") == [("m", "updated")]


def test_patterns_are_checked_where_they_run(spark):
    assert valid_patterns(spark, ["(?P<x>foo)", "a[", "", "ok", "(?<y>ok)"]) == ["ok", "(?<y>ok)"]


def test_written_unknown_is_no_kind(spark):
    schema = "id string, kind string, name string, path string, parent string, language string, freshness string, attrs map<string,string>"
    raw = spark.createDataFrame([(("a", "unknown", None, None, None, None, None, None),),
                                 (("b", None, None, None, None, None, "unknown", None),)], f"n struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    nodes = raw.select(F.lit("r").alias("repo_id"), snapshot.node_struct(F.col("n")).alias("n")).select("repo_id", "n.*")
    edges = spark.createDataFrame([], EDGES)
    got = rows(snapshot.snapshot_problems(nodes, edges), "id", "problem")
    assert got == [("a", "unknown kind unknown (written)"), ("b", "unknown freshness unknown")]


def test_report_counts_and_samples_once(spark):
    some = spark.createDataFrame([("r", f"e{k}") for k in range(9)] + [("r", "e1")], "repo_id string, id string")
    got = {r.check: (r.ok, r.problems, r.samples) for r in integrity.check_report(a=some, b=some.where("false")).collect()}
    assert got == {"a": (False, 10, [f"r e{k}" for k in range(5)]), "b": (True, 0, [])}


def _changes(spark, path, parts):
    schema = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("path", T.StringType()), T.StructField("change", T.StringType())])
    for name, part in parts:
        spark.createDataFrame(part, "repo_id string, ts string, path string, change string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{path}/{name}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def test_bursts_one_gap_apart_and_the_last_one(spark, tmp_path):
    day = "2024-01-01 00:"
    source = _changes(spark, str(tmp_path / "in"), [("one", [
        ("r", day + "00:00", "a", "modified"), ("r", day + "10:00", "a", "modified"), ("r", day + "19:59", "a", "modified"),
        ("r", day + "19:59", "b", "created"), ("q", day + "01:00", "c", "modified")])])
    got = live.burst_stream(source, "10 minutes", str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted((r.repo_id, r.burst_start.minute, r.changes, r.modified, r.structural, r.generations) for r in got.collect()) == [
        ("q", 1, 1, 1, False, 1), ("r", 0, 1, 1, False, 1), ("r", 10, 3, 2, True, 2)]


def test_late_changes_are_kept_aside(spark):
    seen = spark.createDataFrame([("r", "2024-01-01 00:00:01", "a"), ("r", "2024-01-01 01:00:00", "late")],
                                 "repo_id string, ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    bursts = spark.createDataFrame([("r", "2024-01-01 00:00:00", "2024-01-01 00:10:00"), ("r", "2024-01-01 02:00:00", "2024-01-01 02:10:00")],
                                   "repo_id string, burst_start string, burst_end string").select(
        "repo_id", F.col("burst_start").cast("timestamp").alias("burst_start"), F.col("burst_end").cast("timestamp").alias("burst_end"))
    assert rows(live.late_changes(seen, bursts), "path") == [("late",)]


def test_a_restarted_fold_returns_what_it_stored(spark, tmp_path):
    from rippletrace.sources.events import decode_events

    line = ('{"type":"graph.updated","generation":1,"t_ms":1,"added_nodes":[{"id":"file:a","kind":"file"}]}')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.txt").write_text(line + "\n")

    def run():
        raw = spark.readStream.text(str(tmp_path / "in")).withColumns(
            {"repo_id": F.lit("r"), "seq": F.lit(1).cast("long"), "line": F.col("value")})
        empty = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
        return live.fold_stream(decode_events(raw), *empty, str(tmp_path / "state"), str(tmp_path / "progress"))[0]

    assert rows(run(), "id") == [("file:a",)]
    assert rows(run(), "id") == [("file:a",)]


def test_a_live_query_goes_on_until_it_is_stopped(spark, tmp_path):
    source = _changes(spark, str(tmp_path / "in"), [("one", [("r", "2024-01-01 00:00:00", "a", "modified")])])
    query, current = live.upserts(source, ["repo_id"], [F.count(F.lit(1)).alias("n")], str(tmp_path / "out"),
                                  str(tmp_path / "progress"), {"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        assert query.isActive and rows(current(), "repo_id", "n") == [("r", 1)]
        spark.createDataFrame([("r", "2024-01-01 00:01:00", "b", "created")], "repo_id string, ts string, path string, change string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "two"))
        query.processAllAvailable()
        assert rows(current(), "repo_id", "n") == [("r", 2)]
    finally:
        query.stop()


def test_a_keyed_log_is_the_table_after_any_batch(spark, tmp_path, monkeypatch):
    import random

    from pyspark.sql.types import StructType

    monkeypatch.setattr(live, "COMPACT_EVERY", 3)
    rng = random.Random(4)
    first = spark.createDataFrame([("r", f"k{k}", 0) for k in range(4)], "repo_id string, id string, n int")
    log = live.KeyedLog(spark, str(tmp_path / "log"), StructType.fromDDL("repo_id string, id string, n int"), ["repo_id", "id"], first)
    want = {f"k{k}": 0 for k in range(4)}
    assert rows(log.at(log.last()), "id", "n") == sorted(want.items())
    for batch in range(8):
        changes = {f"k{rng.randrange(6)}": rng.choice([None, batch + 1]) for _ in range(3)}
        table = spark.createDataFrame([("r", k, v, v is None) for k, v in changes.items()], "repo_id string, id string, n int, gone boolean")
        for _ in range(1 + batch % 2):  # a retried batch overwrites its own
            log.write(table, batch)
        want |= changes
        want = {k: v for k, v in want.items() if v is not None}
        assert log.last() == batch and rows(log.at(batch), "id", "n") == sorted(want.items())
    kept = {p.name for p in (tmp_path / "log").iterdir()}
    assert kept == {"base=2", "base=5", "delta=3", "delta=4", "delta=5", "delta=6", "delta=7"}


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """One new node of one repository beside 20,000 edges: few bytes, whatever the graph holds."""
    from rippletrace.sources.events import decode_events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.txt").write_text('{"type":"graph.updated","generation":1,"t_ms":1,"added_nodes":[{"id":"file:new","kind":"file"}]}\n')
    raw = spark.readStream.text(str(tmp_path / "in")).withColumns(
        {"repo_id": F.lit("r"), "seq": F.lit(1).cast("long"), "line": F.col("value")})
    nodes = spark.range(20_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("file:"), "id").alias("id"), F.lit("file").alias("kind"))
    edges = spark.range(20_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("e"), "id").alias("id"), F.lit("imports").alias("kind"),
                                       F.concat(F.lit("file:"), "id").alias("src"), F.lit("file:0").alias("dst"))
    whole = [df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
             for df, schema in ((nodes, NODES), (edges, EDGES))]
    now_nodes, now_edges = live.fold_stream(decode_events(raw), *whole, str(tmp_path / "state"), str(tmp_path / "progress"))
    assert now_nodes.count() == 20_001 and now_edges.count() == 20_000
    written = sum(p.stat().st_size for p in (tmp_path / "state").rglob("*.parquet"))
    assert written < 60_000


def test_the_monitor_carries_the_highest_generation_between_batches(spark, tmp_path):
    source = tmp_path / "in"
    logs = [[("r", 1, "graph.updated", 5), ("s", 1, "graph.updated", 9)], [("r", 2, "graph.updated", 4), ("s", 2, "snapshot", 1)],
            [("r", 3, "graph.updated", 6), ("s", 3, "graph.updated", 2), ("r", 4, "graph.updated", 5)]]
    schema = "repo_id string, seq long, type string, generation long"
    for k, log in enumerate(logs):
        spark.createDataFrame(log, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        query, found = live.violations(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
    every = spark.createDataFrame([row for log in logs for row in log], schema)
    assert rows(found()) == rows(live.generation_violations(every)) == [("r", 2, 4, 5), ("r", 4, 5, 6)]
