"""Rename pairing and impact limited to the repositories a batch touched."""

from conftest import rows
from test_graph import edges_of, nodes_of

from rippletrace.operators import diff
from rippletrace.streaming import impact_on_change


def test_rename_pairs(spark):
    gone = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x"), ("r", "c", "y")],
                                 "repo_id string, rel string, digest string")
    new = spark.createDataFrame([("r", "k", "x"), ("r", "z", "w")], "repo_id string, rel string, digest string")
    assert rows(diff.rename_pairs(gone, new), "from_path", "path") == [("a", "k")]


def test_impact_only_where_touched(spark):
    nodes = nodes_of(spark, [("a", "file", ""), ("b", "file", "")])
    edges = edges_of(spark, [("e", "b", "a", "exact", "current", 1)])
    changed = spark.createDataFrame([("r", "a")], "repo_id string, node string")
    for repo, want in (("r", [("a", 0), ("b", 1)]), ("other", [])):
        batch = spark.createDataFrame([(repo, "file.changed")], "repo_id string, type string")
        assert rows(impact_on_change(batch, nodes, edges, changed, "file"), "node", "distance") == want


def test_best_owners_are_the_first_of_the_full_ranking(spark):
    import random

    from rippletrace.operators import ownership

    rng, targets, files, includes = random.Random(2), [], set(), []
    for repo in ("r", "s"):
        names = [f"{d}/{s}{k}.{e}" for d in ("a", "a/b", "c") for s in "xy" for k in range(6) for e in ("cpp", "h")]
        files |= {(repo, f) for f in names}
        for k in range(14):
            sources = rng.sample(names, rng.randint(0, 4)) + ["gone.cpp"]
            targets.append((repo, f"t{k}", rng.choice(["library", "executable"]), sources))
        includes += [(repo, rng.choice(names), rng.choice([*names, "gone.h"])) for _ in range(60)]
    t = spark.createDataFrame(targets, "repo_id string, name string, kind string, sources array<string>")
    f = spark.createDataFrame(sorted(files), "repo_id string, rel string")
    i = spark.createDataFrame(sorted(set(includes)), "repo_id string, src string, dst string")
    ranked = ownership.rank_owners(ownership.target_claims(t, f, i), t).where("rank = 0")
    cols = ("repo_id", "rel", "target", "tier", "rank")
    want = rows(ranked, *cols)
    assert rows(ownership.best_owners(t, f, i), *cols) == want and {r[3] for r in want} == {0, 1}


def test_overlap_of_hundreds_of_changes(spark):
    import random

    from rippletrace.operators import impact
    from rippletrace.operators.impact import Filters
    from rippletrace.schemas import EDGES, NODES

    rng = random.Random(9)
    ids = [f"n{k:02d}" for k in range(40)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(70)})
    nodes = spark.createDataFrame([("r", i, "file", i, i, "d", "", "current", {}) for i in ids]
                                  + [("r", "d", "package", "d", "d", "", "", "current", {})], NODES)
    edges = spark.createDataFrame([("r", f"e{k}", "imports", a, b, "t", "", "exact", "current", 1, None, None)
                                   for k, (a, b) in enumerate(pairs)], EDGES)
    seeds = [(g, rng.choice(ids)) for g in range(200) for _ in range(2)]
    groups = spark.createDataFrame([("r", *s) for s in seeds], "repo_id string, grp int, node string")
    want = {}
    for g, start in seeds:
        far, layer, hops = {start: 0}, {start}, 0
        while layer and hops < 3:
            hops += 1
            layer = {a for a, b in pairs if b in layer} - set(far)
            far |= dict.fromkeys(layer, hops)
        for node, d in far.items():
            names, least = want.get(node, (set(), 99))
            want[node] = (names | {g}, min(least, d))
    got = {r.node: (set(r.grps), r.distance, r.hits) for r in
           impact.seed_overlap(nodes, edges, groups, "file", Filters(3, ("imports",))).collect()}
    assert got == {n: (g, d, len(g)) for n, (g, d) in want.items()}
    up = impact.seed_overlap(nodes, edges, groups, "package", Filters(3, ("imports",))).collect()
    assert [(r.node, r.hits, r.distance) for r in up] == [("d", len({g for g, _ in seeds}), 0)]


def test_a_module_that_every_root_holds_is_asked_for_once(spark, monkeypatch):
    """2,000 roots with the same names: one answer per statement, and no table of statements times roots."""
    from pyspark.sql import functions as F

    from rippletrace.operators import resolve

    n = 2000
    files = spark.range(n).select(F.lit("r").alias("repo_id"), F.explode(F.array(
        F.format_string("p%04d/utils.py", "id"), F.format_string("p%04d/include/config.h", "id"))).alias("rel"))
    roots = spark.range(n).selectExpr("'r' AS repo_id", "format_string('p%04d', id) AS root", "cast(id AS int) AS ord")
    stmts = spark.range(300).selectExpr(
        "'r' AS repo_id", "concat('m', id, '.py') AS rel", "0 AS ord", "'utils' AS module", "0 AS level",
        "array('a', 'b') AS names", "1 AS line", "'x' AS snippet")
    sizes = []
    best = resolve._best
    monkeypatch.setattr(resolve, "_best", lambda found, key: (sizes.append(found.count()), best(found, key))[1])
    got = resolve.resolve_python(stmts, roots, files).collect()
    assert {(r.dst, r.ambiguous) for r in got} == {("p0000/utils.py", True)} and len(got) == 300
    assert max(sizes) <= 2 * n
    include_roots = roots.withColumn("root", F.concat("root", F.lit("/include")))
    asks = stmts.selectExpr("repo_id", "rel", "ord", "'config.h' AS path", "true AS angled", "line", "snippet")
    sizes.clear()
    got = resolve.resolve_cpp(asks, include_roots, files).collect()
    assert {(r.dst, r.ambiguous) for r in got} == {("p0000/include/config.h", True)} and len(got) == 300 and not sizes
