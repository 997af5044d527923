"""Source trees rendered from the order lines, read back, resolved and compared with SQL.

Every order line becomes one small source file per language that imports the part it
sold, so the text grows with the tables and no file collects a group of rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fleet
from ..operators import diff, ownership, resolve
from ..plans.durable import stored
from ..sources import manifests, scan, tree

_ID = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"
_PAIRS = "SELECT DISTINCT repo_id, l_suppkey AS s, l_partkey AS p FROM lines"
_SUPPS = "SELECT DISTINCT l.repo_id, l.l_suppkey AS s, d.s_nationkey AS n FROM lines l JOIN {supplier} d ON d.s_suppkey = l.l_suppkey"
_LINES = f"SELECT DISTINCT repo_id, {_ID} AS id, l_suppkey AS s, l_partkey AS p FROM lines"

# (select list, base rows); content is an expression over s, p, n or id.
_PYTHON = [
    ("'src/s' || s || '/p' || p || '.py'", r"'class K' || p || ':\n    pass\n\ndef make_' || p || '(x):\n    return x\n'", _PAIRS),
    ("'s' || s || '/p' || p || '.py'", "'# copy\n'", f"SELECT * FROM ({_PAIRS}) x WHERE p % 7 = 0"),
    ("'src/s' || s || '/__init__.py'", "''", "SELECT DISTINCT repo_id, l_suppkey AS s FROM lines"),
    ("'app/o' || id || '.py'",
     r"""'\"\"\"import fake.mod\nfrom nowhere import x\"\"\"\nimport os  # import sys\nfrom s' || s || '.p' || p || """
     r"""' import (\n    make_' || p || ' as mk,\n)\ntext = \"from s1.p1 import q\"\nmk(1)\n'""", _LINES),
]
_TS = [
    ("'ts/s' || s || '/p' || p || '.ts'", "'export const v = 1\n'", _PAIRS),
    ("'ts/s' || s || '/package.json'",
     r"""'{\n  \"name\": \"@fleet/s' || s || '\",\n  \"version\": \"1.' || n || '\",\n  \"dependencies\": {\n    \"@fleet/s' || (s + 1) || """
     r"""'\": \"1\",\n    \"left_pad\": \"2\"\n  },\n  \"devDependencies\": {\"Left.Pad\": \"3\"}\n}\n'""", _SUPPS),
    ("'web/o' || id || '.ts'",
     r"""'// import z from \"./no\"\nimport { a } from \"@fleet/s' || s || '/p' || p || '\"\nconst q = require(\"./local\")\n'""", _LINES),
]
_CPP = [
    ("'cpp/include/s' || s || '/p' || p || '.h'", "'#pragma once\n'", _PAIRS),
    ("'cpp/o/o' || id || '.cpp'",
     r"""'/* #include \"no.h\" */\n#include <s' || s || '/p' || p || '.h>\n#include \"missing.h\"\n'""", _LINES),
    ("'cpp/t' || s || '/CMakeLists.txt'",
     r"""'# add_library(no no.cpp)\nadd_library(lib' || s || ' STATIC a.cpp\n  ../t' || s || '/gone.cpp)\nadd_executable(lib' || s || '_app a.cpp lib' || s || '_app.cpp)\n'""", _SUPPS),
    ("'cpp/t' || s || '/a.cpp'", r"""'#include \"../inc/shared' || n || '.h\"\n'""", _SUPPS),
    ("'cpp/t' || s || '/lib' || s || '_app.cpp'", "'int main() {}\n'", _SUPPS),
    ("'cpp/inc/shared' || n || '.h'", "'#pragma once\n'", f"SELECT DISTINCT repo_id, n FROM ({_SUPPS}) x"),
]

# a target tree in which whole directories belong to one target
_LIFT = [
    ("'x/s' || s || '/CMakeLists.txt'",
     r"""'add_library(lib' || s || ' core/a.cpp core/deep/b.cpp top.cpp mix/l.cpp)\nadd_executable(exe' || s || '\n  bin/m.cpp mix/e.cpp)\n'""", _SUPPS),
    *[(f"'x/s' || s || '/{name}.cpp'", "'int x;\n'", _SUPPS)
      for name in ("core/a", "core/deep/b", "top", "mix/l", "bin/m", "mix/e")],
]

_stored: dict[tuple, object] = {}


def _corpus(spark, sf, name, parts):
    """A rendered tree, written once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        # every base is a set: rows of all of them are made distinct together, and that shuffle spreads the rows of
        # all kinds over all cores, because reading text is bound by the processor
        bases = list(dict.fromkeys(base for _, _, base in parts))
        rows = None
        for n, base in enumerate(bases):
            part = fleet.query(spark, sf, base.replace("SELECT DISTINCT ", "SELECT ")).withColumn("base", F.lit(n))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        made = F.array(*[F.array(*[F.lit(k) for k, p in enumerate(parts) if p[2] == base]) for base in bases])
        rows = rows.distinct().withColumn("part", F.explode(F.get(made, F.col("base"))))

        def text(at: int):
            return F.expr("CASE part " + " ".join(f"WHEN {n} THEN {part[at]}" for n, part in enumerate(parts)) + " END")

        out = rows.select("repo_id", text(0).alias("rel"), text(1).alias("content"))
        _stored[key] = stored(out, name)
    return _stored[key]


def _python(spark, sf):
    return _corpus(spark, sf, "python", _PYTHON)


def _ts(spark, sf):
    return _corpus(spark, sf, "typescript", _TS)


def _cpp(spark, sf):
    return _corpus(spark, sf, "cpp", _CPP)


def _py_roots(spark, files):
    return resolve.python_roots(tree.listing_of(files), spark.createDataFrame([], "repo_id string, rel string"))


def python_imports(spark, sf):
    files = _python(spark, sf)
    stmts = scan.python_import_stmts(scan.parse_python(files))
    return resolve.resolve_python(stmts, _py_roots(spark, files), files).drop("ord")


def python_statements(spark, sf):
    return scan.python_import_stmts(scan.parse_python(_python(spark, sf))).select(
        "repo_id", "rel", "module", "level", F.array_join("names", ",").alias("names"),
        F.array_join("bound", ",").alias("bound"), "line")


def python_definitions(spark, sf):
    return scan.python_definitions(scan.parse_python(_python(spark, sf)))


def _refs(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "refs")
    if key in _stored:
        return _stored[key]
    files = _python(spark, sf)
    parsed = stored(scan.parse_python(files), "parsed")
    defs = scan.python_definitions(parsed)
    refs = resolve.resolve_symbol_uses(scan.python_uses(parsed), scan.python_import_stmts(parsed), defs,
                                       _py_roots(spark, files), files)
    _stored[key] = stored(refs, "refs"), defs
    return _stored[key]


def symbol_references(spark, sf):
    return _refs(spark, sf)[0]


def symbol_nodes(spark, sf):
    nodes, _ = ownership.symbol_graph(*_refs(spark, sf))
    return nodes.select("repo_id", "id", "name", "parent", F.col("attrs")["kind"].alias("symbol_kind"),
                        F.col("attrs")["line"].alias("line"))


def python_package_list(spark, sf):
    files = _python(spark, sf)
    return ownership.python_packages(files, _py_roots(spark, files))


def typescript_imports(spark, sf):
    files = _ts(spark, sf)
    pkgs, _ = manifests.packages(files)
    return resolve.resolve_ts(scan.ts_import_specs(files), pkgs, files).drop("ord")


def manifest_packages(spark, sf):
    return manifests.packages(_ts(spark, sf))[0].drop("home", "entry")


def _declared(spark, sf):
    pkgs, deps = manifests.packages(_ts(spark, sf))
    return ownership.declared_dependencies(stored(pkgs, "packages"), stored(deps, "deps"))


def declared_dependencies(spark, sf):
    return _declared(spark, sf)[1].select("repo_id", "id", "src", "dst", F.col("evidence.line").alias("line"),
                                          F.col("evidence.snippet").alias("snippet"))


def external_packages(spark, sf):
    return _declared(spark, sf)[0].select("repo_id", "id", "kind")


def cpp_include_edges(spark, sf):
    files = _cpp(spark, sf)
    return resolve.resolve_cpp(scan.cpp_includes(files), resolve.cpp_roots(tree.listing_of(files)), files).drop("ord")


def build_targets(spark, sf):
    return manifests.build_targets(_cpp(spark, sf)).withColumn("sources", F.array_join("sources", ","))


def _ranked(spark, sf):
    """Targets and ranked claims, derived once per application."""
    key = (spark.sparkContext.applicationId, sf, "ranked")
    if key in _stored:
        return _stored[key]
    files = _cpp(spark, sf)
    targets = stored(ownership.first_declarations(manifests.build_targets(files)), "targets")
    includes = resolve.resolve_cpp(scan.cpp_includes(files), resolve.cpp_roots(tree.listing_of(files)), files)
    claims = ownership.target_claims(targets, files, includes)
    _stored[key] = targets, stored(ownership.rank_owners(claims, targets), "ranked")
    return _stored[key]


def _owned(spark, sf):
    """The owner of each file, derived once per application without the claims."""
    key = (spark.sparkContext.applicationId, sf, "owned")
    if key not in _stored:
        files = _cpp(spark, sf)
        targets = stored(ownership.first_declarations(manifests.build_targets(files)), "targets")
        includes = resolve.resolve_cpp(scan.cpp_includes(files), resolve.cpp_roots(tree.listing_of(files)), files)
        _stored[key] = stored(ownership.best_owners(targets, files, includes), "owned")
    return _stored[key]


def target_owners(spark, sf):
    return _ranked(spark, sf)[1].select("repo_id", "rel", "target", "tier", F.col("rank").alias("place"))


def target_homes(spark, sf):
    return ownership.target_homes(_owned(spark, sf))


def target_parents(spark, sf):
    owned = _owned(spark, sf)
    return ownership.lift_single_owner_dirs(owned, ownership.target_homes(owned))


def lifted_directories(spark, sf):
    """Directories that move as a unit below their only owner, and the files that move alone."""
    files = _corpus(spark, sf, "lift", _LIFT)
    targets = stored(ownership.first_declarations(manifests.build_targets(files)), "lift-targets")
    includes = resolve.resolve_cpp(scan.cpp_includes(files), resolve.cpp_roots(tree.listing_of(files)), files)
    owned = stored(ownership.best_owners(targets, files, includes), "lift-owned")
    return ownership.lift_single_owner_dirs(owned, ownership.target_homes(owned))


def secondary_owners(spark, sf):
    targets, ranked = _ranked(spark, sf)
    return ownership.secondary_owns_edges(ranked, targets).select("repo_id", "id", "src", "dst")


def target_module_lists(spark, sf):
    return ownership.module_list(ownership.target_modules(_ranked(spark, sf)[1]))


def containment_tree(spark, sf):
    files = _cpp(spark, sf)
    owned = _owned(spark, sf)
    overrides = ownership.lift_single_owner_dirs(owned, ownership.target_homes(owned))
    dirs = files.select("repo_id").distinct().select(
        "repo_id", F.lit("cpp/include").alias("rel"), F.lit("pkg:headers").alias("package"))
    return ownership.containment_nodes(tree.listing_of(files), dirs, overrides).select(
        "repo_id", "id", "kind", "name", "parent", "language")


def kept_listing(spark, sf):
    files = _cpp(spark, sf)
    text = "# rules\n*.h\n!shared1*.h\nt1*/\n/cpp/o/*_9.cpp\n"
    rules = tree.ignore_rules(files.select("repo_id").distinct().withColumn("content", F.lit(text)))
    return tree.apply_ignore(tree.listing_of(files), rules).select("repo_id", "rel", "is_dir")


def distribution_twins(spark, sf):
    """Every supplier directory is a python package; a distribution at the root is named like one of them."""
    files = _python(spark, sf)
    py = stored(ownership.python_packages(files, _py_roots(spark, files)), "pypkgs")
    even = py.where("module = 's0'").select(
        "repo_id", F.lit("pkg:S0").alias("id"), F.lit("S0").alias("name"), F.lit("").alias("rel"),
        F.lit("").alias("home"))
    kept, moved, modules = ownership.merge_distribution_twins(py, even, ownership.package_dirs(even))
    return (kept.select("repo_id", F.lit("kept").alias("what"), F.col("rel").alias("value"))
            .unionByName(moved.select("repo_id", F.lit("home").alias("what"), F.col("home").alias("value")))
            .unionByName(modules.select("repo_id", F.lit("module").alias("what"), F.col("node").alias("value"))))


def _edge_changes(spark, sf, family):
    both = fleet.edges(spark, sf, table="imports").drop("ord")
    n = F.expr("cast(substring(repo_id, 2) as int)")
    before = both.withColumn("repo_id", (n * 2).cast("string"))
    after = both.withColumn("repo_id", F.when(n % 10 == 0, n * 2 + 2).otherwise(n * 2 + 18).cast("string"))
    return diff.reconcile_edges(after, before, 7, family).select("repo_id", "id", "change", "valid_from")


def edge_changes(spark, sf):
    """Imports of one half-year against the next, as two versions of one repository."""
    return _edge_changes(spark, sf, "imports")


def edge_changes_symbols(spark, sf):
    """The same by the rule of symbol edges: how sure an edge is does not count."""
    return _edge_changes(spark, sf, "symbols")


def edge_changes_aggregated(spark, sf):
    """The same by the rule of folded edges: the text of the line does not count."""
    return _edge_changes(spark, sf, "aggregated")


def listing_changes(spark, sf):
    files = fleet.query(spark, sf, "SELECT repo_id, p, max(gen) AS gen FROM (SELECT repo_id, l_partkey AS p, gen FROM lines) x "
                                   "GROUP BY repo_id, p")
    n = F.expr("cast(substring(repo_id, 2) as int)")
    now = files.select(n.cast("string").alias("repo_id"), F.concat(F.lit("p"), "p").alias("rel"),
                       F.lit(False).alias("is_dir"), F.col("gen").cast("double").alias("mtime"))
    nxt = F.when(n % 10 == 0, n + 1).otherwise(n + 9)
    was = files.select(nxt.cast("string").alias("repo_id"), F.concat(F.lit("p"), "p").alias("rel"),
                       F.lit(False).alias("is_dir"), F.col("gen").cast("double").alias("mtime"))
    return diff.diff_listing(was, now)


def _ask(select: str, *parts: str) -> str:
    base = f"""
pairs AS MATERIALIZED ({_PAIRS}),
supps AS MATERIALIZED ({_SUPPS.replace('{supplier}', 'supplier')}),
sold AS MATERIALIZED ({_LINES})"""
    return "WITH " + ",\n".join([fleet.ctes(), base.strip(), *[p.strip() for p in parts]]) + "\n" + select


_MIN = """
firsts AS MATERIALIZED (SELECT repo_id, n, min('lib' || s) AS target FROM supps GROUP BY repo_id, n),
nats AS MATERIALIZED (SELECT repo_id, count(DISTINCT n) AS c FROM supps GROUP BY repo_id)"""
_PARENTS = """
parents AS MATERIALIZED (
  SELECT s.repo_id, 'cpp/t' || s.s || '/a.cpp' AS rel, 'lib' || s.s AS target FROM supps s
  UNION ALL
  SELECT s.repo_id, 'cpp/t' || s.s || '/lib' || s.s || '_app.cpp', 'lib' || s.s || '_app' FROM supps s
  UNION ALL
  SELECT f.repo_id, 'cpp/inc/shared' || f.n || '.h', f.target FROM firsts f)"""
_TREE = """
files AS MATERIALIZED (
  SELECT repo_id, 'cpp/include/s' || s || '/p' || p || '.h' AS rel FROM pairs
  UNION ALL SELECT repo_id, 'cpp/o/o' || id || '.cpp' FROM sold
  UNION ALL SELECT repo_id, 'cpp/t' || s || '/' || unnest(['CMakeLists.txt', 'a.cpp', 'lib' || s || '_app.cpp']) FROM supps
  UNION ALL SELECT DISTINCT repo_id, 'cpp/inc/shared' || n || '.h' FROM supps),
listing AS MATERIALIZED (
  SELECT repo_id, rel, false AS is_dir FROM files
  UNION ALL SELECT DISTINCT repo_id, 'cpp', true FROM files
  UNION ALL SELECT DISTINCT repo_id, unnest(['cpp/include', 'cpp/o', 'cpp/inc']), true FROM files
  UNION ALL SELECT DISTINCT repo_id, 'cpp/include/s' || s, true FROM pairs
  UNION ALL SELECT DISTINCT repo_id, 'cpp/t' || s, true FROM supps)"""



def _changes(same: str) -> str:
    return _ask(f"""
SELECT CAST(coalesce(a.r, b.r) AS STRING) AS repo_id, coalesce(a.id, b.id) AS id,
       CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
            WHEN {same} THEN 'kept' ELSE 'updated' END AS change, coalesce(a.valid_from, 7) AS valid_from
FROM (SELECT *, CASE WHEN h % 10 = 0 THEN h * 2 + 2 ELSE h * 2 + 18 END AS r FROM numbered) a
FULL JOIN (SELECT *, h * 2 AS r FROM numbered) b ON a.r = b.r AND a.id = b.id""",
                "numbered AS (SELECT *, CAST(substring(repo_id, 2) AS INT) AS h FROM imports)")


QUERIES = {f.__name__: f for f in (
    python_imports, python_statements, python_definitions, symbol_references, symbol_nodes,
    python_package_list, typescript_imports, manifest_packages, declared_dependencies, external_packages,
    cpp_include_edges, build_targets, target_owners, target_homes, target_parents, lifted_directories, secondary_owners,
    target_module_lists, containment_tree, kept_listing, distribution_twins, edge_changes, edge_changes_symbols,
    edge_changes_aggregated, listing_changes)}

SQL = {
    "python_imports": _ask("""
SELECT repo_id, 'app/o' || id || '.py' AS src,
       CASE WHEN p % 7 = 0 THEN '' ELSE 'src/' END || 's' || s || '/p' || p || '.py' AS dst,
       4 AS line, 'from s' || s || '.p' || p || ' import (' AS snippet, p % 7 = 0 AS ambiguous FROM sold"""),
    "python_statements": _ask("""
SELECT repo_id, 'app/o' || id || '.py' AS rel, 'os' AS module, 0 AS level, '' AS names, 'os' AS bound, 3 AS line FROM sold
UNION ALL
SELECT repo_id, 'app/o' || id || '.py', 's' || s || '.p' || p, 0, 'make_' || p, 'mk', 4 FROM sold"""),
    "python_definitions": _ask("""
SELECT repo_id, 'src/s' || s || '/p' || p || '.py' AS rel, 'K' || p AS name, 'class' AS kind, 1 AS line FROM pairs
UNION ALL SELECT repo_id, 'src/s' || s || '/p' || p || '.py', 'make_' || p, 'function', 4 FROM pairs"""),
    "symbol_references": _ask("""
SELECT repo_id, 'app/o' || id || '.py' AS rel, 'src/s' || s || '/p' || p || '.py' AS target, 'make_' || p AS symbol,
       'calls' AS kind, 8 AS line, 'mk(1)' AS snippet FROM sold WHERE p % 7 <> 0"""),
    "symbol_nodes": _ask("""
SELECT repo_id, 'sym:src/s' || s || '/p' || p || '.py#make_' || p AS id, 'make_' || p AS name,
       'file:src/s' || s || '/p' || p || '.py' AS parent, 'function' AS symbol_kind, '4' AS line FROM pairs WHERE p % 7 <> 0"""),
    "python_package_list": _ask("SELECT DISTINCT repo_id, 'src/s' || s AS rel, 's' || s AS module FROM supps"),
    "typescript_imports": _ask("""
SELECT repo_id, 'web/o' || id || '.ts' AS src, 'ts/s' || s || '/p' || p || '.ts' AS dst, 2 AS line,
       'import { a } from "@fleet/s' || s || '/p' || p || '"' AS snippet, false AS ambiguous FROM sold"""),
    "manifest_packages": _ask("""
SELECT repo_id, 'pkg:@fleet/s' || s AS id, '@fleet/s' || s AS name, 'ts/s' || s AS rel,
       'ts/s' || s || '/package.json' AS manifest, 'npm' AS provider, '1.' || n AS version FROM supps"""),
    "declared_dependencies": _ask("""
SELECT s.repo_id, 'e:dep:@fleet/s' || s.s || '->@fleet/s' || (s.s + 1) AS id, 'pkg:@fleet/s' || s.s AS src,
       CASE WHEN o.s IS NULL THEN 'ext:' ELSE 'pkg:' END || '@fleet/s' || (s.s + 1) AS dst, 5 AS line,
       '"@fleet/s' || (s.s + 1) || '": "1"' AS snippet
FROM supps s LEFT JOIN supps o ON o.repo_id = s.repo_id AND o.s = s.s + 1
UNION ALL
SELECT repo_id, 'e:dep:@fleet/s' || s || '->left_pad', 'pkg:@fleet/s' || s, 'ext:left-pad', 6, '"left_pad": "2"' FROM supps
UNION ALL
SELECT repo_id, 'e:dep:@fleet/s' || s || '->Left.Pad', 'pkg:@fleet/s' || s, 'ext:left-pad', 8,
       '"devDependencies": {"Left.Pad": "3"}' FROM supps"""),
    "external_packages": _ask("""
SELECT DISTINCT repo_id, 'ext:left-pad' AS id, 'external_package' AS kind FROM supps
UNION ALL
SELECT s.repo_id, 'ext:@fleet/s' || (s.s + 1), 'external_package' FROM supps s WHERE NOT EXISTS (
  SELECT 1 FROM supps o WHERE o.repo_id = s.repo_id AND o.s = s.s + 1)"""),
    "cpp_include_edges": _ask("""
SELECT repo_id, 'cpp/o/o' || id || '.cpp' AS src, 'cpp/include/s' || s || '/p' || p || '.h' AS dst, 2 AS line,
       '#include <s' || s || '/p' || p || '.h>' AS snippet, false AS ambiguous FROM sold
UNION ALL
SELECT repo_id, 'cpp/t' || s || '/a.cpp', 'cpp/inc/shared' || n || '.h', 1, '#include "../inc/shared' || n || '.h"', false FROM supps"""),
    "build_targets": _ask("""
SELECT repo_id, 'lib' || s AS name, 'library' AS kind, 'cpp/t' || s || '/CMakeLists.txt' AS manifest, 2 AS line,
       'add_library(lib' || s || ' STATIC a.cpp' AS snippet, 'cpp/t' || s || '/a.cpp,cpp/t' || s || '/gone.cpp' AS sources FROM supps
UNION ALL
SELECT repo_id, 'lib' || s || '_app', 'executable', 'cpp/t' || s || '/CMakeLists.txt', 4,
       'add_executable(lib' || s || '_app a.cpp lib' || s || '_app.cpp)',
       'cpp/t' || s || '/a.cpp,cpp/t' || s || '/lib' || s || '_app.cpp' FROM supps"""),
    "target_owners": _ask("""
SELECT repo_id, 'cpp/t' || s || '/a.cpp' AS rel, 'lib' || s AS target, 0 AS tier, 0 AS place FROM supps
UNION ALL SELECT repo_id, 'cpp/t' || s || '/a.cpp', 'lib' || s || '_app', 0, 1 FROM supps
UNION ALL SELECT repo_id, 'cpp/t' || s || '/lib' || s || '_app.cpp', 'lib' || s || '_app', 0, 0 FROM supps
UNION ALL
SELECT repo_id, 'cpp/inc/shared' || n || '.h', target, 1,
       row_number() OVER (PARTITION BY repo_id, n ORDER BY exe, target) - 1 FROM (
  SELECT repo_id, n, 'lib' || s AS target, 0 AS exe FROM supps
  UNION ALL SELECT repo_id, n, 'lib' || s || '_app', 1 FROM supps) x"""),
    "target_homes": _ask("""
SELECT s.repo_id, 'lib' || s.s AS target, CASE WHEN f.target IS NULL THEN 'cpp/t' || s.s ELSE 'cpp' END AS home
FROM supps s LEFT JOIN firsts f ON f.repo_id = s.repo_id AND f.n = s.n AND f.target = 'lib' || s.s
UNION ALL SELECT repo_id, 'lib' || s || '_app', 'cpp/t' || s FROM supps""", _MIN),
    "target_parents": _ask("SELECT repo_id, rel, target FROM parents", _MIN, _PARENTS),
    "lifted_directories": _ask("""
SELECT repo_id, 'x/s' || s || '/core' AS rel, 'lib' || s AS target FROM supps
UNION ALL SELECT repo_id, 'x/s' || s || '/' || unnest(['top.cpp', 'mix/l.cpp']), 'lib' || s FROM supps
UNION ALL SELECT repo_id, 'x/s' || s || '/' || unnest(['bin', 'mix/e.cpp']), 'exe' || s FROM supps"""),
    "secondary_owners": _ask("""
SELECT repo_id, 'e:owns:tgt:lib' || s || '_app->file:cpp/t' || s || '/a.cpp' AS id, 'tgt:lib' || s || '_app' AS src,
       'file:cpp/t' || s || '/a.cpp' AS dst FROM supps"""),
    "target_module_lists": _ask("""
SELECT repo_id, 'tgt:lib' || s || '_app' AS unit, 'file:cpp/t' || s || '/lib' || s || '_app.cpp' AS module_nodes FROM supps"""),
    "containment_tree": _ask("""
SELECT l.repo_id, CASE WHEN is_dir THEN 'dir:' ELSE 'file:' END || l.rel AS id,
       CASE WHEN is_dir THEN 'directory' ELSE 'file' END AS kind, split_part(l.rel, '/', -1) AS name,
       CASE WHEN p.target IS NOT NULL THEN 'tgt:' || p.target
            WHEN l.rel = 'cpp' THEN 'repo:root'
            WHEN regexp_replace(l.rel, '/[^/]*$', '') = 'cpp/include' THEN 'pkg:headers'
            ELSE 'dir:' || regexp_replace(l.rel, '/[^/]*$', '') END AS parent,
       CASE WHEN l.rel LIKE '%.cpp' OR l.rel LIKE '%.h' THEN 'cpp' ELSE '' END AS language
FROM listing l LEFT JOIN parents p ON p.repo_id = l.repo_id AND p.rel = l.rel
WHERE l.rel <> 'cpp/include'""", _MIN, _PARENTS, _TREE),
    "kept_listing": _ask("""
SELECT repo_id, rel, is_dir FROM listing
WHERE NOT (rel LIKE '%.h' AND NOT regexp_matches(rel, '/shared1[^/]*\\.h$'))
  AND NOT regexp_matches(rel, '^cpp/t1[^/]*(/|$)') AND NOT regexp_matches(rel, '^cpp/o/[^/]*_9\\.cpp$')""", _TREE),
    "distribution_twins": _ask("""
SELECT DISTINCT repo_id, 'kept' AS what, 'src/s' || s AS value FROM supps WHERE s <> 0
UNION ALL SELECT DISTINCT repo_id, 'home', 'src/s0' FROM supps WHERE s = 0
UNION ALL SELECT DISTINCT repo_id, 'module', 'file:src/s0/__init__.py' FROM supps WHERE s = 0"""),
    "edge_changes": _changes("a.confidence = b.confidence AND a.line = b.line"),
    "edge_changes_symbols": _changes("a.line = b.line AND a.dst = b.dst"),
    "edge_changes_aggregated": _changes("a.confidence = b.confidence AND a.line = b.line AND a.src = b.src"),
    "listing_changes": _ask("""
SELECT CAST(coalesce(a.r, b.h) AS STRING) AS repo_id, 'p' || coalesce(a.p, b.p) AS rel, false AS is_dir,
       CASE WHEN a.p IS NULL THEN 'fresh' WHEN b.p IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT *, CASE WHEN h % 10 = 0 THEN h + 1 ELSE h + 9 END AS r FROM parts) a
FULL JOIN parts b ON a.r = b.h AND a.p = b.p
WHERE a.p IS NULL OR b.p IS NULL OR a.gen <> b.gen""", """
parts AS MATERIALIZED (SELECT CAST(substring(repo_id, 2) AS INT) AS h, l_partkey AS p, max(gen) AS gen FROM lines GROUP BY ALL)"""),
}
