"""Readers over long and dirty text: every document becomes a comment and a literal around statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import manifests, scan

# Fixed value: characters that a literal of some language cannot hold.
QUOTED = "\"'`\\"


def _documents(spark, sf):
    """repo_id, doc_id, the text as a comment body, and as one long line that fits any quotes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.translate("text", QUOTED, " " * len(QUOTED))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id") % 7).alias("repo_id"), F.col("doc_id").cast("string").alias("k"),
                       F.replace(F.translate("text", "\r", " "), F.lit("*/"), F.lit("* /")).alias("note"),
                       F.regexp_replace(plain, "[\r\n]", " ").alias("line"))


def _files(spark, sf, ending, *parts):
    docs = _documents(spark, sf)
    content = F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return docs.select("repo_id", F.concat(F.lit("f"), "k", F.lit(ending)).alias("rel"), content.alias("content"))


def cpp_long_text(spark, sf):
    k, note, line = F.col("k"), F.col("note"), F.col("line")
    files = _files(spark, sf, ".cpp", "/* ", note, " */\n#include \"a_", k, ".h\"\nconst char* s = \"", line, "\\\"",
                   line, "\"; // #include \"no.h\"\nauto r = R\"x(\n#include \"raw.h\"\n)x\";\n  #  include <b/c_", k, ".hpp>\n")
    return scan.cpp_includes(files).select("repo_id", "rel", "ord", "path", "angled", "line")


def typescript_long_text(spark, sf):
    k, note, line = F.col("k"), F.col("note"), F.col("line")
    files = _files(spark, sf, ".ts", "/* ", note, " */\nimport a from './a_", k, "'\nconst s = \"", line, "\", t = `", line,
                   "`; const r = require('", line, " ", k, "');\n// import no from 'no'\nexport { x } from \"pkg/", k, "\";\n")
    return scan.ts_import_specs(files).select("repo_id", "rel", "spec", "line", "type_only")


def python_long_text(spark, sf):
    k, note, line = F.col("k"), F.translate("note", '"\\', "  "), F.col("line")
    files = _files(spark, sf, ".py", '"""', note, '\nimport no\n"""\nimport a', k, '; import b.c as d\ns = "', line,
                   "\"  # import no\nfrom ..up import (\n    x as y,  # ", line, "\n    z,\n)\nfrom . import *\nfrom long \\\n    import thing\n")
    stmts = scan.python_import_stmts(scan.parse_python(files))
    return stmts.select("repo_id", "rel", "ord", "module", "level", F.array_join("names", ",").alias("names"),
                        F.array_join("bound", ",").alias("bound"), "line")


def cmake_nested_targets(spark, sf):
    docs = _documents(spark, sf).withColumn("depth", F.col("k").cast("long") % 12 + 1)
    depth = F.col("depth").cast("int")
    content = F.concat(
        F.lit("# "), F.col("line"), F.lit("\nadd_library(t_"), F.col("k"), F.lit(" a.cpp $<IF:"), F.repeat(F.lit("("), depth),
        F.lit("x"), F.repeat(F.lit(")"), depth), F.lit(",1,2> \""), F.regexp_replace("line", r"[()#$/\\.]", "_"), F.lit("\"\n  b.cpp) add_library(no c.cpp)\n"
              "add_executable(e_"), F.col("k"), F.lit("\n  WIN32 ${CMAKE_CURRENT_SOURCE_DIR}/m.cpp\n)\n"))
    files = docs.select("repo_id", F.concat(F.lit("s"), "k", F.lit("/CMakeLists.txt")).alias("rel"), content.alias("content"))
    got = manifests.build_targets(files)
    return got.select("repo_id", "name", "kind", "manifest", "line", F.size("sources").alias("sources"),
                      F.element_at("sources", 1).alias("first"), F.element_at("sources", -1).alias("last"))


QUERIES = {f.__name__: f for f in (cpp_long_text, typescript_long_text, python_long_text, cmake_nested_targets)}

_D = """
WITH d AS (
  SELECT 'd' || CAST(doc_id % 7 AS VARCHAR) AS repo_id, CAST(doc_id AS VARCHAR) AS k, doc_id,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n,
         regexp_replace(translate(coalesce(text, ''), '"''`\\', '    '), '[\r\n]', ' ', 'g') AS line
  FROM documents)
"""

SQL = {
    "cpp_long_text": _D + """
SELECT repo_id, 'f' || k || '.cpp' AS rel, CAST(0 AS BIGINT) AS ord, 'a_' || k || '.h' AS path, false AS angled,
       CAST(n + 2 AS INT) AS line FROM d
UNION ALL SELECT repo_id, 'f' || k || '.cpp', 1, 'b/c_' || k || '.hpp', true, CAST(n + 7 AS INT) FROM d""",
    "typescript_long_text": _D + """
SELECT repo_id, 'f' || k || '.ts' AS rel, './a_' || k AS spec, CAST(n + 2 AS INT) AS line, false AS type_only FROM d
UNION ALL SELECT repo_id, 'f' || k || '.ts', d.line || ' ' || k, CAST(n + 3 AS INT), false FROM d
UNION ALL SELECT repo_id, 'f' || k || '.ts', 'pkg/' || k, CAST(n + 5 AS INT), false FROM d""",
    "python_long_text": _D + """
SELECT repo_id, 'f' || k || '.py' AS rel, CAST(o AS BIGINT) AS ord, CASE o WHEN 0 THEN 'a' || k ELSE m END AS module,
       lv AS level, names, CASE o WHEN 0 THEN 'a' || k ELSE bound END AS bound, CAST(n + ln AS INT) AS line
FROM d, (VALUES (0, '', 0, '', '', 4), (1, 'b.c', 0, '', 'd', 4), (2, 'up', 2, 'x,z', 'y,z', 6), (3, '', 1, '*', '*', 10),
         (4, 'long', 0, 'thing', 'thing', 11)) v(o, m, lv, names, bound, ln)""",
    "cmake_nested_targets": _D + """
SELECT repo_id, 't_' || k AS name, 'library' AS kind, 's' || k || '/CMakeLists.txt' AS manifest, 2 AS line,
       len(list_distinct(['a.cpp', q, 'b.cpp'])) AS sources, 's' || k || '/a.cpp' AS "first", 's' || k || '/b.cpp' AS "last"
FROM (SELECT *, regexp_replace(line, '[()#$/\\\\.]', '_', 'g') AS q FROM d)
WHERE q <> ''
UNION ALL SELECT repo_id, 't_' || k, 'library', 's' || k || '/CMakeLists.txt', 2, 2, 's' || k || '/a.cpp', 's' || k || '/b.cpp'
FROM d WHERE line = ''
UNION ALL SELECT repo_id, 'e_' || k, 'executable', 's' || k || '/CMakeLists.txt', 4, 1, 's' || k || '/m.cpp', 's' || k || '/m.cpp' FROM d""",
}
