"""Traversal, cycles, closure and state against brute force on small graphs."""

import random
from collections import deque

import pytest
from conftest import rows

from rippletrace import fleet
from rippletrace.operators import ancestry, closure, cycles, impact, integrity, scores, temporal
from rippletrace.operators.impact import Filters
from rippletrace.plans import sequence_number, trace_back
from rippletrace.schemas import EDGES, NODES
from rippletrace.sources import events as reader


def nodes_of(spark, triples):
    return spark.createDataFrame(
        [("r", i, k, i, f"src/{i}", p, "", "current", {}) for i, k, p in triples], NODES)


def edges_of(spark, rows_, kind="imports"):
    return spark.createDataFrame(
        [("r", i, kind, s, d, "t", "", c, f, v, None, None) for i, s, d, c, f, v in rows_], EDGES)


def random_graph(seed, n=14, m=26):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return [(f"e{i:02d}", f"n{a:02d}", f"n{b:02d}", "exact", "stale" if i % 9 == 0 else "current", 1)
            for i, (a, b) in enumerate(pairs)]


def queue_search(edges, seeds, depth):
    into = {}
    for e in sorted(edges):
        into.setdefault(e[2], []).append(e)
    seen = {s: (0, None) for s in sorted(seeds)}
    queue = deque(sorted(seeds))
    while queue:
        node = queue.popleft()
        if seen[node][0] >= depth:
            continue
        for e in into.get(node, []):
            if e[1] not in seen:
                seen[e[1]] = (seen[node][0] + 1, e)
                queue.append(e[1])
    out = {}
    for node, (distance, via) in seen.items():
        path = []
        while via:
            path.append(via[0])
            via = seen[via[2]][1]
        out[node] = (distance, tuple(path))
    return out


def reachable(edges):
    out = {}
    for start in {e[1] for e in edges} | {e[2] for e in edges}:
        seen, todo = set(), [start]
        while todo:
            cur = todo.pop()
            for e in edges:
                if e[1] == cur and e[2] not in seen:
                    seen.add(e[2])
                    todo.append(e[2])
        out[start] = seen
    return out


def test_blast_radius_matches_a_queue(spark):
    for seed in (1, 2):
        es = random_graph(seed)
        ids = sorted({e[1] for e in es} | {e[2] for e in es})
        nodes = nodes_of(spark, [(i, "file", "") for i in ids])
        seeds = spark.createDataFrame([("r", ids[0]), ("r", ids[5])], "repo_id string, node string")
        got = impact.blast_radius(nodes, edges_of(spark, es), seeds, "file", Filters(max_depth=3)).collect()
        want = queue_search(es, [ids[0], ids[5]], 3)
        assert {r.node: (r.distance, tuple(r.paths[0]) if r.paths else ()) for r in got} == want
        stale = {e[0] for e in es if e[4] == "stale"}
        assert all((r.freshness == "stale") == bool(r.paths and stale & set(r.paths[0])) for r in got)


def test_cycles_and_reach_match_brute_force(spark):
    shapes = [random_graph(3), random_graph(4, 20, 30),
              [(f"e{i}", f"n{i:02d}", f"n{(i + 1) % 12:02d}", "exact", "current", 1) for i in range(12)]
              + [("x", "n03", "a", "exact", "current", 1), ("y", "b", "b", "exact", "current", 1)]]
    for es in shapes:
        down = reachable(es)
        want = sorted({(min(g), n) for n in down
                       for g in [{m for m in down[n] if n in down[m]} | {n}] if len(g) > 1})
        assert rows(cycles.cycle_groups(edges_of(spark, es)), "group", "node") == want
        up = {n: len({m for m in down if n in down[m] and m != n}) for n in down}
        got = {r.node: r.dependents for r in closure.transitive_counts(edges_of(spark, es)).collect()}
        assert got == {n: c for n, c in up.items() if c}


def test_specificity_and_relevance(spark):
    nodes = nodes_of(spark, [(i, "package", "") for i in ("app", "auth", "log", "web")])
    es = edges_of(spark, [("e1", "app", "log", "exact", "current", 1), ("e2", "auth", "log", "exact", "current", 1),
                          ("e3", "web", "log", "exact", "current", 1), ("e4", "app", "auth", "exact", "current", 1)],
                  "depends_on")
    spec = scores.specificity(nodes, es, "package")
    by = {r.node: (r.dependents, round(r.specificity, 4)) for r in spec.collect()}
    assert by == {"app": (0, 1.0), "auth": (1, 1.0), "log": (3, 0.2075), "web": (0, 1.0)}
    seeds = spark.createDataFrame([("r", "log")], "repo_id string, node string")
    hits = impact.blast_radius(nodes, es, seeds, "package")
    rel = {r.node: round(r.relevance, 4) for r in scores.relevance(hits, es, spec).collect()}
    assert rel == {"log": 1.0, "app": 0.2075, "auth": 0.2075, "web": 0.2075}
    assert rows(scores.hub_alerts(hits, spec), "node", "dependents", "reach") == [("log", 3, 3)]
    assert integrity.check_paths(hits, es, seeds).count() == 0


def test_provider_reach_names_new_edges(spark):
    es = edges_of(spark, [("e1", "b", "a", "exact", "current", 5), ("e2", "c", "b", "exact", "current", 1),
                          ("e3", "d", "a", "heuristic", "current", 1)])
    one = spark.createDataFrame([("r", "a")], "repo_id string, node string")
    base = spark.createDataFrame([("r", 3)], "repo_id string, baseline_generation long")
    got = rows(impact.provider_reach(es, one, base), "node", "distance", "cause")
    assert got == [("a", 0, "implementation"), ("b", 1, "dependency_added"), ("c", 2, "dependency_added")]


def test_containment(spark):
    nodes = nodes_of(spark, [("root", "repository", ""), ("p", "package", "root"), ("d", "directory", "p"),
                             ("f", "file", "d"), ("q", "package", "s"), ("s", "package", "q"), ("g", "file", "gone")])
    assert rows(ancestry.ancestor_of_kind(nodes, "package"), "node", "ancestor", "depth") == [
        ("d", "p", 1), ("f", "p", 2), ("p", "p", 0), ("q", "q", 0), ("s", "s", 0)]
    assert rows(integrity.check_containment(nodes), "node", "problem") == [
        ("g", "missing_parent"), ("q", "cycle"), ("s", "cycle")]
    picked = spark.createDataFrame([("r", "f"), ("r", "p"), ("r", "g")], "repo_id string, node string")
    assert rows(ancestry.project(nodes, picked, "package"), "node") == [("p",)]


def replay(lines):
    nodes, edges = {}, {}
    for ev in lines:
        for n in ev.get("added_nodes", []) + ev.get("updated_nodes", []):
            nodes[n["id"]] = n
        for e in ev.get("added_edges", []) + ev.get("updated_edges", []):
            edges[e["id"]] = e
        for e in ev.get("removed_edges", []):
            edges.pop(e, None)
        for n in ev.get("removed_nodes", []):
            if nodes.pop(n, None) is not None:
                for i in [i for i, e in edges.items() if e.get("valid_to") is None and n in (e["from"], e["to"])]:
                    del edges[i]
    return set(nodes), set(edges)


def test_state_equals_replay(spark):
    import json

    everything, want = [], {}
    for repo in range(12):
        rng, log = random.Random(repo), []
        for _ in range(25):
            n = lambda: f"n{rng.randrange(4)}"
            edge = lambda: {"id": f"e{rng.randrange(5)}", "kind": "imports", "from": n(), "to": n(),
                            **({"valid_to": 3} if rng.random() < 0.2 else {})}
            ev = {"type": "graph.updated"}
            if rng.random() < 0.5:
                ev["added_nodes"] = [{"id": n(), "kind": "file"}]
            if rng.random() < 0.6:
                ev["updated_edges"] = [edge(), edge()]
            if rng.random() < 0.4:
                ev["removed_nodes"] = [n()]
            if rng.random() < 0.2:
                ev["removed_edges"] = [f"e{rng.randrange(5)}"]
            log.append(ev)
        want[str(repo)] = replay(log)
        everything += [(str(repo), i, json.dumps(ev)) for i, ev in enumerate(log)]
    lines = spark.createDataFrame(everything, "repo_id string, seq long, value string")
    good, bad = reader.validate_events(reader.decode_events(lines))
    assert bad.count() == 0
    nodes, edges = temporal.state_at(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), good)
    got_n, got_e = rows(nodes, "repo_id", "id"), rows(edges, "repo_id", "id")
    assert got_n == sorted((r, i) for r, (ns, _) in want.items() for i in ns)
    assert got_e == sorted((r, i) for r, (_, es) in want.items() for i in es)


def test_snapshot_event_restarts(spark):
    values = ['{"type":"graph.updated","added_nodes":[{"id":"old","kind":"file"}]}',
              '{"type":"snapshot","snapshot":{"schema":"x.snapshot/1","nodes":[{"id":"new","kind":"file"}],"edges":[]}}',
              '{"type":"graph.updated","added_nodes":[{"id":"later","kind":"file"}]}']
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "repo_id string, seq long, value string")
    good, _ = reader.validate_events(reader.decode_events(lines))
    nodes, _ = temporal.state_at(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), good)
    assert rows(nodes, "id") == [("later",), ("new",)]


def test_sequence_number_is_dense_for_a_hot_key(spark):
    df = spark.range(2000).selectExpr("if(id % 10 < 9, 'hot', 'cold') as k", "(id * 7919) % 2000 as o")
    got = sequence_number(df, ["k"], ["o"]).orderBy("k", "o").collect()
    for key in ("hot", "cold"):
        mine = [r.seq for r in got if r.k == key]
        assert mine == list(range(len(mine)))


@pytest.mark.parametrize("bound", [cycles.LOCAL_EDGES, 70, 0])
def test_components_of_every_size(spark, monkeypatch, bound):
    """Settled in tasks, in rounds, or both. A giant, rings beside, before and behind it, nested repositories, and a long chain between rings."""
    es, want = [], set()

    def ring(repo, names):
        es.extend((repo, a, b) for a, b in zip(names, names[1:] + names[:1], strict=True))
        want.update((repo, min(names), n) for n in names)

    monkeypatch.setattr(cycles, "LOCAL_EDGES", bound)
    for repo in ("r", "s"):
        ring(repo, [f"g{k:03d}" for k in range(60)])
        ring(repo, ["a1", "a2"])
        ring(repo, ["b1", "b2", "b3"])
        ring(repo, ["c1", "c2"])
        es += [(repo, "a1", "g000"), (repo, "g010", "b1"), (repo, "a2", "b3"), (repo, "g000", "g030"), (repo, "x", "a1")]
        chain = [f"k{k:03d}" for k in range(14)]
        es += [(repo, a, b) for a, b in zip(["b2", *chain], [*chain, "c1"], strict=True)]
    edges = spark.createDataFrame(es, "repo_id string, src string, dst string")
    assert set(rows(cycles.cycle_groups(edges), "repo_id", "group", "node")) == want
    assert cycles.cycle_groups(edges.where("false")).count() == 0
    if bound == 70:
        return
    up = {}
    for repo in ("r", "s"):
        mine = [("", s, d) for q, s, d in es if q == repo]
        down = reachable(mine)
        up |= {(repo, n): len({m for m in down if n in down[m] and m != n}) for n in down}
    got = {(r.repo_id, r.node): r.dependents for r in closure.transitive_counts(edges).collect()}
    assert got == {n: c for n, c in up.items() if c}


def test_reach_in_a_task_of_columns(monkeypatch):
    import numpy as np

    monkeypatch.setattr(closure, "_COLUMNS", 64)
    rng = random.Random(3)
    for n, m in ((5, 9), (150, 170), (300, 280), (200, 900)):
        es = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(k, (k + 1) % n) for k in range(0, n, 3)})
        es = [(a, b) for a, b in es if a != b]
        down = reachable([("", a, b) for a, b in es])
        got = closure.reached_by(np.array([a for a, _ in es]), np.array([b for _, b in es]), n)
        assert got.tolist() == [sum(1 for o in down if v in down[o] and o != v) for v in range(n)]


def test_small_parts_need_no_rounds(spark, monkeypatch):
    """One repository of far more edges than a part may have: chains of four, rings of two, a null name of the repository."""
    def refuse(*_):
        raise AssertionError("walked in rounds")

    monkeypatch.setattr(closure, "_distributed", refuse)
    monkeypatch.setattr(cycles, "_giants", refuse)
    chains = spark.range(30_000).selectExpr("'r' as repo_id", "id", "explode(array(0, 1, 2)) as k").selectExpr(
        "repo_id", "concat('c', id, '_', k) as src", "concat('c', id, '_', k + 1) as dst")
    rings = spark.range(40_000).selectExpr("if(id < 3, null, 'r') as repo_id", "id", "explode(array(0, 1)) as k").selectExpr(
        "repo_id", "concat('o', id, '_', k) as src", "concat('o', id, '_', 1 - k) as dst")
    got = closure.transitive_counts(chains.unionByName(rings))
    assert rows(got.groupBy(got.node.startswith("c").alias("c"), "dependents").count()) == [
        (False, 1, 80_000), (True, 1, 30_000), (True, 2, 30_000), (True, 3, 30_000)]
    assert got.where("repo_id is null").count() == 6
    found = cycles.cycle_groups(rings.where("repo_id is not null").unionByName(chains))
    assert found.count() == 79_994 and found.where("group <> concat(split_part(node, '_', 1), '_0')").count() == 0


def test_large_parts_are_handed_back(spark, monkeypatch):
    """A part above the bound is walked by all tasks, the others beside it are closed where they are."""
    rng = random.Random(5)
    monkeypatch.setattr(closure, "PART_EDGES", 20)
    es = [(q, f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for q in ("r", "s") for _ in range(70)]
    es += [("r", "x", "y"), ("r", "y", "z"), ("r", "z", "y"), ("t", "x", "y")]
    up = {}
    for repo in ("r", "s", "t"):
        down = reachable([("", s, d) for q, s, d in es if q == repo and s != d])
        up |= {(repo, n): len({m for m in down if n in down[m] and m != n}) for n in down}
    got = closure.transitive_counts(spark.createDataFrame(es, "repo_id string, src string, dst string")).collect()
    assert {(r.repo_id, r.node): r.dependents for r in got} == {n: c for n, c in up.items() if c}
    assert len(got) == sum(1 for c in up.values() if c)


def test_sketched_reach_is_near(spark, monkeypatch):
    monkeypatch.setattr(cycles, "LOCAL_EDGES", 100)
    rng = random.Random(7)
    es = [("r", f"n{rng.randrange(4000)}", f"n{rng.randrange(4000)}") for _ in range(4400)] + [("s", "a", "b"), ("s", "b", "c")]
    edges = spark.createDataFrame(es, "repo_id string, src string, dst string")
    near = {(r.repo_id, r.node): r.dependents for r in closure.transitive_counts(edges, approx=True).collect()}
    monkeypatch.setattr(cycles, "LOCAL_EDGES", 50_000)
    exact = {(r.repo_id, r.node): r.dependents for r in closure.transitive_counts(edges).collect()}
    assert set(near) == set(exact) and max(exact.values()) > 300 and near["s", "c"] == 2
    assert max(abs(near[n] - c) / c for n, c in exact.items()) < 0.03


def test_deep_trees_and_parent_cycles(spark):
    """Sixty levels, a shallow branch, a cycle of three with a tail, and a missing parent, against plain climbing."""
    parent = {f"d{k:02d}": f"d{k - 1:02d}" if k else "" for k in range(60)}
    parent |= {"leaf": "d59", "side": "d10", "c1": "c2", "c2": "c3", "c3": "c1", "tail": "c1", "own": "own", "lost": "gone"}
    nodes = nodes_of(spark, [(i, "directory", p) for i, p in parent.items()])
    want = set()
    for node in parent:
        at, depth, seen = node, 0, {node}
        want.add((node, node, 0))
        while (at := parent.get(at, "")) and at in parent and at not in seen and depth < 63:
            depth += 1
            seen.add(at)
            want.add((node, at, depth))
    got = {(r.node, r.ancestor, r.depth) for r in ancestry.ancestors(nodes).collect()}
    assert got == want
    assert rows(ancestry.parent_cycles(nodes), "node") == [("c1",), ("c2",), ("c3",), ("own",)]


def test_a_search_reaches_only_listed_nodes(spark):
    """c is not listed, so neither c nor what only c leads to is reached; repeats in the list change nothing."""
    edges = spark.createDataFrame([("r", f"{s}{d}", s, d, False, 1) for s, d in ("ba", "cb", "dc", "eb", "fe")],
                                  "repo_id string, id string, src string, dst string, stale boolean, valid_from long")
    seeds = spark.createDataFrame([("r", "a")], "repo_id string, node string")
    among = spark.createDataFrame([("r", n) for n in "bbdef"] + [("q", "c"), (None, "c")], "repo_id string, node string")
    found = trace_back(edges, seeds, 8, among)
    assert [(n, d, ",".join(p)) for n, d, p in rows(found, "node", "distance", "path")] == [
        ("a", 0, ""), ("b", 1, "ba"), ("e", 2, "eb,ba"), ("f", 3, "fe,eb,ba")]
    assert trace_back(edges, seeds, 8).count() == 6


def test_the_fleet_joins_numbers_and_agrees_with_its_sql(spark, tmp_path):
    """Lines repeated, without number, part, supplier or amounts, an order twice and one without a date."""
    from datetime import datetime

    import duckdb

    lines = [(1, 1, 5, 1, 48.0, 0.09, 0.08), (1, 2, 6, 2, 50.0, 0.1, 0.08), (1, 2, 7, 2, 1.0, 0.0, 0.0), (1, 3, 6, 3, None, None, None),
             (1, 1, 5, 2, 49.0, 0.09, 0.07), (2, 9, 5, None, 1.0, 0.0, 0.0), (2, 8, 6, 1, 1.0, 0.0, 0.07), (2, 8, None, 2, 1.0, 0.0, 0.0),
             (3, 1, 5, 1, 1.0, 0.0, 0.0), (3, 2, 5, 2, 1.0, 0.0, 0.0), (None, 1, 5, 1, 1.0, 0.0, 0.0), (3, None, 6, 3, 1.0, 0.0, 0.0)]
    order = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    tables = {
        "lineitem": (lines, order),
        "orders": ([(1, datetime(1995, 2, 1)), (1, datetime(1995, 9, 1)), (2, datetime(1995, 3, 1)), (3, None), (None, datetime(1995, 3, 1))],
                   "o_orderkey long, o_orderdate timestamp"),
        "supplier": ([(5, 1), (6, 2), (6, 1), (7, None)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, 0), (2, 0)], "n_nationkey int, n_regionkey int"),
        "part": ([(1, "a", "x", 10), (2, "b", "x", 1), (3, None, "y", 2), (3, "c", "y", None)], "p_partkey long, p_name string, p_brand string, p_size int")}
    other = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        other.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    shown = {"edges": "repo_id, id, kind, src, dst, confidence, freshness, valid_from, valid_to, ord, line",
             "owners": "repo_id, node, owner", "homes": "repo_id, part, supp", "nodes": "repo_id, id, kind, name, path, parent, language, freshness"}
    for name, columns in shown.items():
        got = fleet.query(spark, str(tmp_path), f"SELECT {columns} FROM {name}").collect()
        want = other.execute(f"WITH {fleet.ctes()} SELECT {columns} FROM {name}").fetchall()
        assert want and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), name
    written = {key[3]: df for key, df in fleet._derived.items() if key[1] == str(tmp_path)}
    assert "a" in written["import_pairs"].columns and "l_tax" not in written["lines"].columns
