"""Readers: statements, definitions, uses, specifiers, includes, manifests."""

from conftest import rows

from rippletrace.operators import resolve
from rippletrace.sources import manifests, scan, tree


def tree_of(spark, mapping):
    return spark.createDataFrame([("r", k, v) for k, v in mapping.items()],
                                 "repo_id string, rel string, content string")


PY = '''"""doc
import not_this
"""
import os, a.b as c
from x.y import (
    one as uno,  # note
    two,
)
from . import sib; import later
from ..up import *
text = "import nope"  # import nope2
importer = 1
if True:
    import inner
from __future__ import annotations
from long \\
    import thing
'''


def test_python_statements(spark):
    parsed = scan.parse_python(tree_of(spark, {"p/m.py": PY}))
    got = [(r.module, r.level, list(r.names), list(r.bound), r.line, r.snippet)
           for r in scan.python_import_stmts(parsed).orderBy("ord").collect()]
    assert got == [
        ("os", 0, [], ["os"], 4, "import os, a.b as c"),
        ("a.b", 0, [], ["c"], 4, "import os, a.b as c"),
        ("x.y", 0, ["one", "two"], ["uno", "two"], 5, "from x.y import ("),
        ("", 1, ["sib"], ["sib"], 9, "from . import sib; import later"),
        ("later", 0, [], ["later"], 9, "from . import sib; import later"),
        ("up", 2, ["*"], ["*"], 10, "from ..up import *"),
        ("inner", 0, [], ["inner"], 14, "import inner"),
        ("long", 0, ["thing"], ["thing"], 16, "from long"),
    ]


def test_python_definitions_and_uses(spark):
    text = ("from m import f, K as k\nimport mod\n\nclass A:\n    def method(self): pass\n\n"
            "async def go():\n    f(1)\n    x.f()\n    k\n    mod.attr(2)\n    s = 'f()'\n\ndef f(): pass\n")
    parsed = scan.parse_python(tree_of(spark, {"a.py": text}))
    assert rows(scan.python_definitions(parsed), "name", "kind", "line") == [
        ("A", "class", 4), ("f", "function", 14), ("go", "function", 7)]
    assert rows(scan.python_uses(parsed), "line", "name", "attr", "call", "snippet") == [
        (8, "f", "", True, "f(1)"), (10, "k", "", False, "k"), (11, "mod", "attr", True, "mod.attr(2)")]


TS = '''// import x from "commented"
import a from './a'
import {
  b,
} from "pkg/b";
import type { T } from './t'
export { q } from './q'
export function f() {
  const s = "plain"
}
const r = require('r'), d = import(`./dyn`)
/* import z from 'z' */
import './side'
export const from1 = 'no'
'''


def test_ts_specs(spark):
    got = rows(scan.ts_import_specs(tree_of(spark, {"x.ts": TS})), "line", "spec", "type_only")
    assert got == [(2, "./a", False), (3, "pkg/b", False), (6, "./t", True), (7, "./q", False),
                   (11, "./dyn", False), (11, "r", False), (13, "./side", False)]


CPP = '''// #include "no.h"
#include "a.h"
  #  include <b/c.hpp>  // tail
/* #include "block.h"
#include "block2.h" */
const char* s = R"x(
#include "raw.h"
)x";
int n = 1'000; #include "late.h"
#include \\
  "cont.h"
#include MACRO
'''


def test_cpp_includes(spark):
    got = rows(scan.cpp_includes(tree_of(spark, {"x.cpp": CPP})), "line", "path", "angled")
    assert got == [(2, "a.h", False), (3, "b/c.hpp", True), (10, "cont.h", False)]


def test_manifests(spark):
    pkgs, deps = manifests.packages(tree_of(spark, {
        "web/package.json": '{\n  "name": "@app/web", // main\n  "version": "1.0",\n  "main": "",\n  "module": "m.js",\n'
                            '  "dependencies": {\n    "zeta": "1",\n    "alpha": "2"\n  },\n  "devDependencies": {"vite": "5"}\n}',
        "lib/pyproject.toml": '[project]\nname = "My_Lib"\nversion = "0.1"\nrequires-python = ">=3"\ndependencies = [\n'
                              '  "numpy[extra]>=1", "pandas",\n  # "commented",\n  \'python\',\n]\n[tool.x]\nname = "no"\n',
        "old/pyproject.toml": '[tool.poetry]\nname = "poem"\n[tool.poetry.dependencies]\npython = "^3"\nrich = "*"\n'
                              '[tool.poetry.dev-dependencies]\npytest = "^7"\n',
        "zz/pyproject.toml": '[project]\nname = "my-lib"\n', "bad/package.json": "{nope", "none/package.json": "{}",
    }))
    assert rows(pkgs, "id", "rel", "provider", "version", "entry") == [
        ("pkg:@app/web", "web", "npm", "1.0", "m.js"), ("pkg:My_Lib", "lib", "python", "0.1", ""),
        ("pkg:poem", "old", "python", "", "")]
    assert rows(deps, "package", "name", "line", "snippet", "dev") == [
        ("pkg:@app/web", "alpha", 8, '"alpha": "2"', False),
        ("pkg:@app/web", "vite", 10, '"devDependencies": {"vite": "5"}', True),
        ("pkg:@app/web", "zeta", 7, '"zeta": "1"', False),
        ("pkg:My_Lib", "numpy", 6, "numpy[extra]>=1", False), ("pkg:My_Lib", "pandas", 6, "pandas", False),
        ("pkg:poem", "pytest", 7, "pytest", True), ("pkg:poem", "rich", 5, "rich", False)]


def test_cmake_targets(spark):
    text = ('# add_library(no x.cpp)\nadd_library(core STATIC\n  src/a.cpp "src/b c.cpp" # c\n  ${VAR}/x.cpp\n'
            '  ${CMAKE_CURRENT_SOURCE_DIR}/d.cpp)\nadd_library(alias ALIAS core)\n'
            'add_executable(app main.cpp $<TARGET_OBJECTS:core>)\nmy_add_library(z z.cpp)\n')
    got = rows(manifests.build_targets(tree_of(spark, {"lib/CMakeLists.txt": text})),
               "name", "kind", "line", "snippet", "sources")
    assert got == [("app", "executable", 7, "add_executable(app main.cpp $<TARGET_OBJECTS:core>)", ["lib/main.cpp"]),
                   ("core", "library", 2, "add_library(core STATIC",
                    ["lib/src/a.cpp", "lib/src/b c.cpp", "lib/d.cpp"])]


def test_ignore(spark):
    rules = tree.ignore_rules(spark.createDataFrame(
        [("r", "# c\n*.log\n!keep.log\nout/\n/top.txt\ndocs/*.md\n**/deep\n[ab]\n")], "repo_id string, content string"))
    paths = ["a.log", "keep.log", "out", "src/out", "src/out/x.py", "top.txt", "src/top.txt", "docs/a.md",
             "docs/s/b.md", "x/deep", "src/a", "node_modules/q.js", ".hidden", "src/main.py"]
    dirs = {"out", "src/out", "x/deep"}
    listing = spark.createDataFrame(
        [("r", p, p in dirs) for p in paths] + [("r", "src", True), ("r", "node_modules", True), ("r", "docs", True),
                                                ("r", "docs/s", True)],
        "repo_id string, rel string, is_dir boolean")
    kept = {r.rel for r in tree.apply_ignore(listing, rules).collect()}
    assert kept == {"keep.log", "src/top.txt", "docs/s/b.md", "src", "docs", "docs/s", "src/a", "src/main.py"}


def test_resolve_python(spark):
    src = tree_of(spark, {
        "app/main.py": "from lib.core import helper\nimport lib.util as u\nfrom . import sib\nfrom lib import both\nimport os\n",
        "app/sib.py": "", "app/__init__.py": "", "lib/__init__.py": "", "lib/core.py": "def helper(): pass\n",
        "src/lib/core.py": "", "lib/util.py": "", "lib/both.py": ""})
    listing = tree.listing_of(src)
    roots = resolve.python_roots(listing, spark.createDataFrame([], "repo_id string, rel string"))
    parsed = scan.parse_python(src)
    got = resolve.resolve_python(scan.python_import_stmts(parsed), roots, src)
    assert rows(got, "src", "dst", "line", "ambiguous") == [
        ("app/main.py", "app/sib.py", 3, False), ("app/main.py", "lib/both.py", 4, False),
        ("app/main.py", "lib/core.py", 1, True), ("app/main.py", "lib/util.py", 2, False)]


def test_resolve_ts(spark):
    src = tree_of(spark, {
        "web/src/a.ts": "import b from './b'\nimport c from './c.js'\nimport d from '@x/ui'\nimport e from '@x/ui/parts/e'\n"
                        "import f from '../../../out'\nimport g from './dir'\n",
        "web/src/b.tsx": "", "web/src/c.ts": "", "ui/lib/main.ts": "", "ui/parts/e.ts": "", "web/src/dir/index.ts": ""})
    pkgs = spark.createDataFrame([("r", "@x/ui", "ui", "lib/main.ts"), ("r", "@x", "other", "")],
                                 "repo_id string, name string, rel string, entry string")
    got = resolve.resolve_ts(scan.ts_import_specs(src), pkgs, src)
    assert rows(got, "src", "dst", "line") == [
        ("web/src/a.ts", "ui/lib/main.ts", 3), ("web/src/a.ts", "ui/parts/e.ts", 4), ("web/src/a.ts", "web/src/b.tsx", 1),
        ("web/src/a.ts", "web/src/c.ts", 2), ("web/src/a.ts", "web/src/dir/index.ts", 6)]


def test_resolve_cpp(spark):
    src = tree_of(spark, {
        "src/a.cpp": '#include "a.h"\n#include <lib/x.h>\n#include "y.h"\n', "src/a.h": "", "include/lib/x.h": "",
        "include/y.h": "", "inc/y.h": ""})
    got = resolve.resolve_cpp(scan.cpp_includes(src), resolve.cpp_roots(tree.listing_of(src)), src)
    assert rows(got, "src", "dst", "line", "ambiguous") == [
        ("src/a.cpp", "inc/y.h", 3, True), ("src/a.cpp", "include/lib/x.h", 2, False), ("src/a.cpp", "src/a.h", 1, False)]


def test_symbol_uses_follow_reexports(spark):
    src = tree_of(spark, {
        "main.py": "from pkg import make, sub\nimport pkg.deep as d\nmake()\nsub.run\nd.low(1)\n",
        "pkg/__init__.py": "from .a import make\nfrom .b import *\n", "pkg/a.py": "from .c import build as make\n",
        "pkg/c.py": "def build(): pass\n", "pkg/b.py": "def make(): pass\n", "pkg/sub.py": "def run(): pass\n",
        "pkg/deep.py": "def low(x): pass\n"})
    listing = tree.listing_of(src)
    roots = resolve.python_roots(listing, spark.createDataFrame([], "repo_id string, rel string"))
    parsed = scan.parse_python(src)
    got = resolve.resolve_symbol_uses(scan.python_uses(parsed), scan.python_import_stmts(parsed),
                                      scan.python_definitions(parsed), roots, src)
    assert rows(got, "rel", "target", "symbol", "kind", "line") == [
        ("main.py", "pkg/c.py", "build", "calls", 3), ("main.py", "pkg/deep.py", "low", "calls", 5),
        ("main.py", "pkg/sub.py", "run", "references", 4)]


def test_comments_go_in_one_pass_where_they_hold_no_line_break(spark):
    """Counts of Java regex calls don't show; each text is read as the token-by-token reading reads it."""
    from pyspark.sql import functions as F

    from rippletrace.functions import blank_tokens, drop_tokens
    from rippletrace.sources import scan

    texts = ["", "a", "/", "//", "/**/x", "/*/ \n*/y", "a /* b\nc */ d // e\nf", "'/*' \"//\" `/*`", "x /* never closed",
             "x /* never\nclosed", "// a /* b\nc", 'R"x(/* )" )x" y', 'u8R"(a\nb)" // c\nd', 'aR"(b)"', "1'000 /* c */ 'd'",
             "$1 ${kept} \\ /* x */ $", "/* é\U0001f600 */ é\U0001f600 // z", "inc/**/lude", "/* a */" * 500 + "\n" + "q" * 5000, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    raw = r"^(u8|[uUL])?R\""
    for dropped, kept, more in ((scan._TS_DROPPED, scan._TS_KEPT, ""), (scan._CPP_DROPPED, scan._CPP_KEPT, '|R"')):
        def gone(t, raw=raw if more else r"\A\z"):
            return t.rlike(r"^/[/*]") | t.rlike(raw)
        got = df.select("t", drop_tokens(F.col("t"), dropped, kept, scan._COMMENT + more, scan._LONG_COMMENT + more, gone).alias("one"),
                        blank_tokens(F.col("t"), f"(?:{dropped}|{kept})", gone).alias("each")).collect()
        assert [r.one for r in got] == [r.each for r in got]


def test_statements_parted_by_comments_are_found(spark):
    from rippletrace.sources import scan

    files = spark.createDataFrame([
        ("r", "a.cpp", '#inc/* x */lude "a.h"\n'), ("r", "b.cpp", '#/**/include <b.h>\n'), ("r", "c.h", "#pragma once\n"),
        ("r", "d.ts", 'im/* x */port x from "./d"\n'), ("r", "e.ts", "req/**/uire('./e')\n"), ("r", "f.ts", "export const v = 1\n"),
        ("r", "g.ts", 'const a = import ( "./g" ); require(`./h`)\nexport * from \'./i\' // "j"\n')], "repo_id string, rel string, content string")
    assert sorted((r.rel, r.path) for r in scan.cpp_includes(files).collect()) == [("a.cpp", "a.h"), ("b.cpp", "b.h")]
    assert sorted((r.rel, r.spec) for r in scan.ts_import_specs(files).collect()) == [
        ("d.ts", "./d"), ("e.ts", "./e"), ("g.ts", "./g"), ("g.ts", "./h"), ("g.ts", "./i")]


def test_names_of_libraries_are_dropped_before_rows_move(spark):
    from pyspark.sql import functions as F

    texts = {f"src/pkg{n}/m{n}.py": f"import os\nfrom lib{n}.sub import x\nfrom pkg{n - 1}.m{n - 1} import y\nimport top\n"
             for n in range(1, 40)}
    files = tree_of(spark, {**texts, "top.py": "", "src/pkg0/__init__.py": "", "src/pkg0/m0.py": ""})
    roots = resolve.python_roots(tree.listing_of(files), spark.createDataFrame([], "repo_id string, rel string"))
    modules = resolve._modules(files, roots)
    crumbs = resolve._crumbs(modules)
    assert crumbs.count() == 1
    kept = modules.where(resolve._may_be(crumbs.scalar(), F.col("repo_id"), F.col("inner")))
    assert kept.count() == modules.count()
    asked = spark.createDataFrame([("r", m) for m in ("os", "lib3/sub", "lib3/sub/x", "pkg3/m3/y", "pkg3/m3", "top")], "repo_id string, m string")
    asked = asked.join(files.select("repo_id").distinct().withColumnRenamed("repo_id", "own"))
    left = asked.where(resolve._may_be(crumbs.scalar(), F.col("own"), F.col("m")))
    assert {r.m for r in left.collect()} == {"pkg3/m3", "top"}
    got = rows(resolve.resolve_python(scan.python_import_stmts(scan.parse_python(files)), roots, files), "src", "dst")
    assert got == sorted(e for n in range(1, 40) for e in (
        (f"src/pkg{n}/m{n}.py", f"src/pkg{n - 1}/m{n - 1}.py"), (f"src/pkg{n}/m{n}.py", "top.py")))


def test_comments_between_runs_of_kept_text(spark):
    text = 'a /* "x" */ b\n#include "u8R.h" // R"( no\nauto s = u8R"q(#include <no.h>)q"; x1\'000/2; R "y";\n#include <yes.h>\n'
    got = rows(scan.cpp_includes(tree_of(spark, {"a.cpp": text, "b.cpp": text.replace("\n", "\r\n"), "c.cpp": text.replace("\n", "\r")})),
               "rel", "path", "angled", "line")
    assert got == [(f, p, a, n) for f in ("a.cpp", "b.cpp", "c.cpp") for p, a, n in (("u8R.h", False, 2), ("yes.h", True, 4))]
