"""A fleet of repositories derived from the order tables, for demonstrations and checks.

Each order period is a repository; the parts sold in it are files, suppliers are
directories, nations packages and regions workspaces. Two parts on neighbouring lines
of an order form an import. The derivation is one SQL text that any SQL engine can run
over the same tables, and it always reads them whole. Spark gets the same rows with fewer
shuffles: see ``_SPARK``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.impact import Filters
from .plans.durable import stored

TABLES = ["region", "nation", "supplier", "part", "orders", "lineitem", "events"]

_PERIOD = {
    "month": "year(o_orderdate) * 100 + month(o_orderdate)",
    "half": "year(o_orderdate) * 10 + CAST(floor((month(o_orderdate) - 1) / 6.0) AS INT)",
}

_STEPS = {
    "tagged": """
  SELECT o_orderkey, 'r' || CAST(@PERIOD@ AS STRING) AS repo_id,
         CAST(100 + dayofyear(o_orderdate) AS BIGINT) AS gen
  FROM @orders@""",
    "lines": """
  SELECT t.repo_id, t.gen, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_discount, l_tax, l_quantity
  FROM @lineitem@ JOIN tagged t ON l_orderkey = t.o_orderkey""",
    "imports": """
  SELECT a.repo_id,
         'e:imp:' || CAST(a.l_partkey AS STRING) || '->' || CAST(b.l_partkey AS STRING) AS id,
         'imports' AS kind,
         'file:' || CAST(a.l_partkey AS STRING) AS src,
         'file:' || CAST(b.l_partkey AS STRING) AS dst,
         CASE WHEN min(a.l_discount) >= 0.09 THEN 'heuristic' ELSE 'exact' END AS confidence,
         CASE WHEN min(a.l_tax) >= 0.08 THEN 'invalid'
              WHEN min(a.l_tax) >= 0.07 THEN 'stale' ELSE 'current' END AS freshness,
         min(a.gen) AS valid_from,
         CASE WHEN min(a.l_quantity) >= 48 THEN max(a.gen) + 1 ELSE NULL END AS valid_to,
         min(a.l_orderkey * 10 + a.l_linenumber) AS ord,
         CAST(min(a.l_linenumber) AS INT) AS line
  FROM lines a JOIN lines b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
   AND a.l_partkey <> b.l_partkey
  GROUP BY a.repo_id, a.l_partkey, b.l_partkey""",
    "homes": """
  SELECT repo_id, l_partkey AS part,
         min_by(l_suppkey, @ROW@(l_orderkey, l_linenumber, l_suppkey)) AS supp
  FROM lines GROUP BY repo_id, l_partkey""",
    "dirs": """
  SELECT DISTINCT h.repo_id, h.supp, s.s_nationkey AS nation, n.n_regionkey AS region
  FROM homes h JOIN @supplier@ s ON h.supp = s.s_suppkey JOIN @nation@ n ON s.s_nationkey = n.n_nationkey""",
    "nodes": """
  SELECT h.repo_id, 'file:' || CAST(h.part AS STRING) AS id, 'file' AS kind, p_name AS name,
         'src/n' || CAST(d.nation AS STRING) || '/s' || CAST(h.supp AS STRING) || '/p'
           || CAST(h.part AS STRING) || '.py' AS path,
         'dir:' || CAST(h.supp AS STRING) AS parent, p_brand AS language,
         CASE WHEN p_size % 10 = 0 THEN 'stale' WHEN p_size % 10 = 1 THEN 'invalid'
              WHEN p_size % 10 = 2 THEN 'pending' ELSE 'current' END AS freshness
  FROM homes h JOIN @part@ ON h.part = p_partkey
       JOIN dirs d ON d.repo_id = h.repo_id AND d.supp = h.supp
  UNION ALL
  SELECT repo_id, 'dir:' || CAST(supp AS STRING), 'directory', 's' || CAST(supp AS STRING),
         'src/n' || CAST(nation AS STRING) || '/s' || CAST(supp AS STRING),
         'pkg:' || CAST(nation AS STRING), '', 'current' FROM dirs
  UNION ALL
  SELECT DISTINCT repo_id, 'pkg:' || CAST(nation AS STRING), 'package', 'n' || CAST(nation AS STRING),
         'src/n' || CAST(nation AS STRING), 'ws:' || CAST(region AS STRING), '', 'current' FROM dirs
  UNION ALL
  SELECT DISTINCT repo_id, 'ws:' || CAST(region AS STRING), 'workspace', 'w' || CAST(region AS STRING),
         'src', 'repo:root', '', 'current' FROM dirs
  UNION ALL
  SELECT DISTINCT repo_id, 'repo:root', 'repository', repo_id, '', '', '', 'current' FROM dirs""",
    "owners": """
  SELECT h.repo_id, 'file:' || CAST(h.part AS STRING) AS node,
         'pkg:' || CAST(d.nation AS STRING) AS owner
  FROM homes h JOIN dirs d ON d.repo_id = h.repo_id AND d.supp = h.supp""",
    "units": """
  SELECT i.repo_id, 'e:dep:' || a.owner || '->' || b.owner AS id, 'depends_on' AS kind,
         a.owner AS src, b.owner AS dst,
         CASE WHEN min(CASE WHEN i.confidence = 'heuristic' THEN 1 ELSE 0 END) = 1
              THEN 'heuristic' ELSE 'exact' END AS confidence,
         'current' AS freshness, min(i.valid_from) AS valid_from, CAST(NULL AS BIGINT) AS valid_to,
         min(i.ord) AS ord, min_by(i.line, @ROW@(i.ord, i.id)) AS line
  FROM imports i JOIN owners a ON a.repo_id = i.repo_id AND a.node = i.src
       JOIN owners b ON b.repo_id = i.repo_id AND b.node = i.dst
  WHERE a.owner <> b.owner GROUP BY i.repo_id, a.owner, b.owner""",
    "edges": """SELECT * FROM imports UNION ALL SELECT * FROM units""",
}
_KEPT = ["lines", "imports", "homes", "dirs", "nodes", "owners", "units", "edges"]

# The same tables for Spark. A line keeps its amounts as the grades they are asked for, pairs and packages
# are joined as numbers, and names are spelled out where they are read.
_SPARK = {
    "lines": """
  SELECT t.repo_id, t.gen, l_orderkey, l_linenumber, l_partkey, l_suppkey, discounted, taxed, bulky
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_discount >= 0.09 THEN 1 WHEN l_discount < 0.09 THEN 0 END AS discounted,
               CASE WHEN l_tax >= 0.08 THEN 2 WHEN l_tax >= 0.07 THEN 1 WHEN l_tax < 0.07 THEN 0 END AS taxed,
               CASE WHEN l_quantity >= 48 THEN 1 WHEN l_quantity < 48 THEN 0 END AS bulky
        FROM @lineitem@) graded JOIN tagged t ON l_orderkey = t.o_orderkey""",
    "import_pairs": """
  SELECT a.repo_id, a.l_partkey AS a, b.l_partkey AS b, min(a.discounted) AS discounted, min(a.taxed) AS taxed,
         min(a.gen) AS valid_from, CASE WHEN min(a.bulky) = 1 THEN max(a.gen) + 1 ELSE NULL END AS valid_to,
         min(a.l_orderkey * 10 + a.l_linenumber) AS ord, CAST(min(a.l_linenumber) AS INT) AS line
  FROM lines a JOIN lines b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
   AND a.l_partkey <> b.l_partkey
  GROUP BY a.repo_id, a.l_partkey, b.l_partkey""",
    "imports": """
  SELECT repo_id, 'e:imp:' || CAST(a AS STRING) || '->' || CAST(b AS STRING) AS id, 'imports' AS kind,
         'file:' || CAST(a AS STRING) AS src, 'file:' || CAST(b AS STRING) AS dst,
         CASE WHEN discounted = 1 THEN 'heuristic' ELSE 'exact' END AS confidence,
         CASE WHEN taxed = 2 THEN 'invalid' WHEN taxed = 1 THEN 'stale' ELSE 'current' END AS freshness,
         valid_from, valid_to, ord, line
  FROM import_pairs""",
    "homes": """
  SELECT repo_id, l_partkey AS part, min(struct(l_orderkey, l_linenumber, l_suppkey)).l_suppkey AS supp
  FROM lines GROUP BY repo_id, l_partkey""",
    "part_nations": """
  SELECT h.repo_id, h.part, d.nation FROM homes h JOIN dirs d ON d.repo_id = h.repo_id AND d.supp = h.supp""",
    "owners": """
  SELECT repo_id, 'file:' || CAST(part AS STRING) AS node, 'pkg:' || CAST(nation AS STRING) AS owner
  FROM part_nations""",
    "units": """
  SELECT repo_id, 'e:dep:pkg:' || CAST(x AS STRING) || '->pkg:' || CAST(y AS STRING) AS id, 'depends_on' AS kind,
         'pkg:' || CAST(x AS STRING) AS src, 'pkg:' || CAST(y AS STRING) AS dst,
         CASE WHEN min(guess) = 1 THEN 'heuristic' ELSE 'exact' END AS confidence,
         'current' AS freshness, min(valid_from) AS valid_from, CAST(NULL AS BIGINT) AS valid_to,
         min(ord) AS ord, min(struct(ord, id, line)).line AS line
  FROM (SELECT i.repo_id, m.nation AS x, n.nation AS y, CASE WHEN i.discounted = 1 THEN 1 ELSE 0 END AS guess, i.valid_from, i.ord,
               'e:imp:' || CAST(i.a AS STRING) || '->' || CAST(i.b AS STRING) AS id, i.line
        FROM import_pairs i JOIN part_nations m ON m.repo_id = i.repo_id AND m.part = i.a
             JOIN part_nations n ON n.repo_id = i.repo_id AND n.part = i.b
        WHERE m.nation <> n.nation) between GROUP BY repo_id, x, y""",
}
# written once; the others are spelled out of these where they are read
_WRITTEN = ["lines", "import_pairs", "homes", "dirs", "nodes", "part_nations", "units"]


def _text(name: str, grain: str, engine: str) -> str:
    text = {**_STEPS, **_SPARK}[name] if engine == "spark" else _STEPS[name]
    text = text.replace("@PERIOD@", _PERIOD[grain]).replace("@ROW@", "row")
    for table in TABLES:
        text = text.replace(f"@{table}@", f"{{{table}}}" if engine == "spark" else table)
    return text.strip()


def ctes(grain: str = "half") -> str:
    """The derivation as a list of common table expressions."""
    return ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _KEPT else ''}({_text(name, grain, 'sql')})"
                      for name in _STEPS)


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _named(sql: str) -> str:
    """``sql`` with the derived tables after FROM and JOIN written like base tables, as ``{table}``."""
    return re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(dict.fromkeys([*_STEPS, *_SPARK])) + r")\b", r"\1 {\2}", sql)


def _run(spark: SparkSession, sf_dir: str, grain: str, sql: str) -> DataFrame:
    """Run SQL whose FROM and JOIN name derived tables (or ``{table}`` for a base table)."""
    named = _named(sql)
    used = dict.fromkeys(re.findall(r"\{(\w+)\}", named))
    return spark.sql(named, **{name: derive(spark, sf_dir, grain, name) for name in used})


_derived: dict[tuple[str, str, str, str], DataFrame] = {}


def derive(spark: SparkSession, sf_dir: str, grain: str, name: str) -> DataFrame:
    """A base or derived table. Derived ones come with those they are made of, and no others.

    They are written once per application and read by every question; ``imports`` and ``owners`` are names for
    written numbers, ``edges`` is imports and units read together.
    """
    key = (spark.sparkContext.applicationId, sf_dir, grain, name)
    if key not in _derived:
        if name in TABLES:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = _run(spark, sf_dir, grain, _text(name, grain, "spark"))
        _derived[key] = stored(df, name) if name in _WRITTEN else df
    return _derived[key]


def query(spark: SparkSession, sf_dir: str, sql: str, grain: str = "half") -> DataFrame:
    """Run ``sql`` over the derived tables ``nodes``, ``edges``, ``imports``, ``lines`` ..."""
    return _run(spark, sf_dir, grain, sql)


def nodes(spark: SparkSession, sf_dir: str, grain: str = "half") -> DataFrame:
    base = query(spark, sf_dir, "SELECT * FROM nodes", grain)
    return base.withColumn("attrs", F.create_map().cast("map<string,string>"))


def edges(spark: SparkSession, sf_dir: str, grain: str = "half", table: str = "edges") -> DataFrame:
    base = query(spark, sf_dir, f"SELECT * FROM {table}", grain)
    evidence = F.struct(F.col("src").alias("artifact"), F.col("line"),
                        F.concat(F.lit("import "), "dst").alias("snippet"))
    return base.select(
        "repo_id", "id", "kind", "src", "dst", F.lit("demo").alias("provider"),
        F.lit("1").alias("provider_version"), "confidence", "freshness", "valid_from", "valid_to",
        evidence.alias("evidence"), "ord")


PACKAGE_FILTERS = Filters(edge_kinds=("depends_on",))
