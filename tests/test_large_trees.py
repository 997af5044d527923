"""Resolution and listings against plain Python, over trees made here; what a plan may not do at size."""

import itertools
import random

from pyspark.sql import functions as F

from conftest import rows
from rippletrace import fleet
from rippletrace.demo import corpus
from rippletrace.functions import normalize_path, path_prefixes
from rippletrace.operators import ownership, resolve
from rippletrace.sources import scan, tree

_EXT = resolve.TS_EXTENSIONS


def test_prefixes_and_normal_paths(spark):
    paths = ["", "a", "a/b", "a//b", "/a", "a/", "./a", "a/../b", "../a", "a/.", "..", "a.b/..c/...", "a/./b/../../c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", path_prefixes(F.col("p")).alias("up"), normalize_path(F.col("p")).alias("n")).collect():
        parts, out = r.p.split("/"), []
        assert r.up == ["/".join(parts[:n]) for n in range(len(parts))]
        for part in (x for x in parts if x not in ("", ".")):
            if part == ".." and not out:
                out = None
                break
            out = out[:-1] if part == ".." else out + [part]
        assert r.n == "/".join(out or [])


def test_typescript_tries_by_stem(spark):
    """Every base against every file of a small alphabet, as trying the paths one by one would find it."""
    names = ["a", "a.d", "a.js", "a.ts", "a.d.ts", "a.tsx", "a.mjs", "a.mts", "a.json", "a.js.ts", "index", "index.ts", ".js",
             "a/index.ts", "a/index.js", "a/index.d.ts", "a.js/index.ts", "index/index.tsx", ".js.ts", ".ts"]
    bases = ["a", "a.d", "a.js", "a.mjs", "a.ts", "index", ".js", "a/index", "a.json", "b"]
    rnd = random.Random(5)
    trees = [rnd.sample(names, k) for k in (2, 4, 6, 9, 20) for _ in range(4)]
    files = [(f"r{n}", f) for n, t in enumerate(trees) for f in t] + [(f"r{n}", "from.css") for n in range(len(trees))]
    specs = [(f"r{n}", "from.css", i, "./" + b, i, "s", False) for n in range(len(trees)) for i, b in enumerate(bases)]
    got = resolve.resolve_ts(
        spark.createDataFrame(specs, "repo_id string, rel string, ord bigint, spec string, line int, snippet string, type_only boolean"),
        spark.createDataFrame([], "repo_id string, name string, rel string, entry string"),
        spark.createDataFrame(files, "repo_id string, rel string"))
    want = set()
    for (n, t), b in itertools.product(enumerate(trees), bases):
        swaps = [b[:-len(x)] + y for x, y in resolve.TS_SWAPS if b.endswith(x) and len(b) > len(x)]
        tries = [b, *swaps, *[b + e for e in _EXT], *[b + "/index" + e for e in _EXT]]
        want.update([(f"r{n}", p) for p in tries if p in t][:1])
    assert {(r.repo_id, r.dst) for r in got.collect()} == want


def test_typescript_spells_no_tries_into_rows(spark, tmp_path):
    """A try in each row made a 20-fold shuffle."""
    files = spark.createDataFrame([("r", f"m/f{i}.ts") for i in range(50)], "repo_id string, rel string")
    specs = spark.createDataFrame([("r", f"m/f{i}.ts", 0, f"./f{i + 1}", 1, "s", False) for i in range(49)],
                                  "repo_id string, rel string, ord bigint, spec string, line int, snippet string, type_only boolean")
    none = spark.createDataFrame([], "repo_id string, name string, rel string, entry string")
    got = resolve.resolve_ts(specs, none, files)
    assert got.count() == 49
    assert "/index.ts" not in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]


def test_statements_are_read_once(spark):
    """A guard on the size of the statements read every text a second and third time."""
    files = spark.createDataFrame([("r", "a.py", "import os\n"), ("r", "b.py", ""), ("r", "c.py", None)],
                                  "repo_id string, rel string, content string")
    got = scan.python_import_stmts(scan.parse_python(files))
    assert rows(got, "rel", "module") == [("a.py", "os")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_extract_all" not in line for line in plan.split("\n") if "Filter" in line)


def test_listing_of_odd_paths(spark):
    paths = ["a", "a/b", "a/c/d", "x\ny/z", "/lead", "t//u"]
    got = tree.listing_of(spark.createDataFrame([("r", p) for p in paths] + [("r", None)], "repo_id string, rel string"))
    dirs = {"/".join(p.split("/")[:n]) for p in paths for n in range(1, len(p.split("/")))} - {""}
    assert {r.rel for r in got.where("is_dir").collect()} == dirs
    assert got.where("not is_dir").count() == len(paths) + 1


def test_ignored_paths_stay_in_place(spark):
    """Ignored paths were met by three joins over the whole listing."""
    paths = ["a.o", "keep.o", "t1/x.c", "t1", "sub/t1/deep/y.c", "src/gen/z.c", "src/z.c", "doc", "doc/q", ".git/x", "exact"]
    files = spark.createDataFrame([("r", p) for p in paths] + [(None, "a.o")], "repo_id string, rel string")
    rules = tree.ignore_rules(spark.createDataFrame([("r", "*.o\n!keep.o\nt1/\n/src/gen\ndoc/\nexact\n")], "repo_id string, content string"))
    got = tree.apply_ignore(tree.listing_of(files), rules)
    kept = {(r.rel, r.is_dir) for r in got.where("repo_id = 'r'").collect()}
    assert {p for p, d in kept if not d} == {"keep.o", "t1", "src/z.c", "doc"}
    assert {p for p, d in kept if d} == {"src", "sub"}
    assert got.where("repo_id is null").count() == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 4


def test_includes_that_climb_and_hide(spark):
    files = [("r", p) for p in ("include/a.h", "lib/inc/a.h", "lib/b.h", "src/main.cpp", "src/a.h", "include/string", "top.h")]
    inc = [("a.h", False), ("a.h", True), ("../b.h", True), ("string", True), ("./b/../a.h", True), ("missing.h", True), ("../../top.h", True),
           ("..x/no.h", True)]
    includes = spark.createDataFrame([("r", f"src/{i}.cpp", 0, p, angled, 1, p) for i, (p, angled) in enumerate(inc)],
                                     "repo_id string, rel string, ord bigint, path string, angled boolean, line int, snippet string")
    known = spark.createDataFrame(files, "repo_id string, rel string")
    got = resolve.resolve_cpp(includes, resolve.cpp_roots(tree.listing_of(known)), known)
    assert [(s, d, a) for s, d, a in rows(got, "src", "dst", "ambiguous")] == [
        ("src/0.cpp", "src/a.h", False), ("src/1.cpp", "include/a.h", True), ("src/2.cpp", "lib/b.h", False),
        ("src/3.cpp", "include/string", False), ("src/4.cpp", "include/a.h", True), ("src/6.cpp", "top.h", False)]


def test_includes_nobody_comes_to_are_not_walked(spark):
    targets = spark.createDataFrame([("r", "t", ["a.cpp"])], "repo_id string, name string, sources array<string>")
    files = spark.createDataFrame([("r", p) for p in ("a.cpp", "a.h", "b.h", "o.cpp")], "repo_id string, rel string")
    includes = spark.createDataFrame([("r", "a.cpp", "a.h"), ("r", "a.h", "b.h"), ("r", "o.cpp", "b.h"), ("r", "a.h", "gone.h")],
                                     "repo_id string, src string, dst string")
    _, edges = ownership._listed(targets, files, includes)
    assert rows(edges, "src", "dst") == [("a.cpp", "a.h"), ("a.h", "b.h")]


def test_questions_derive_only_what_they_read(spark):
    sf = "/root/testdata/sf0.001/."
    fleet.nodes(spark, sf).count()
    names = {key[3] for key in fleet._derived if key[1] == sf}
    assert "nodes" in names and not names & {"imports", "units", "edges"}


def test_corpus_mixes_all_kinds_of_files(spark):
    files = corpus._cpp(spark, "/root/testdata/sf0.001")
    assert files.where("rel is null or content is null").count() == 0
