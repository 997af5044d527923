from collections import defaultdict
from fractions import Fraction

from rippletrace.llm import mixing
from rippletrace.plans.durable import stored

from .cases import none, odd


def _targets(sizes, weights, most=3):
    """Water-filling by rounds, in exact fractions."""
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        share = Fraction(total - sum(held.values()), sum(weights[s] for s in free) or 1)
        over = [s for s in free if share * weights[s] > most * sizes[s]]
        if not over:
            return {s: held.get(s, share * weights[s]) for s in sizes}
        held |= {s: Fraction(most * sizes[s]) for s in over}


def _check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = stored(mixing.sizes(df))
    got = mixing.taken(sized, mixing.plan(sized)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = _targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for s in order:
        assert abs(targets[s] - expected[s]) < 1e-6
        assert abs(taken[s] - targets[s]) <= 1, s
    again = mixing.taken(sized, mixing.plan(sized)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_targets_and_taken_words(spark):
    # two sources too small for their weights, one empty, a null one
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 4}") for k in range(80)]
    rows += [(100 + k, "tiny", "a") for k in range(3)] + [(200, "b b", "b"), (300, "", "z"), (301, None, "z"), (302, "n n n", None)]
    _check(spark, rows)
    _check(spark, [(1, "", "a")])


def test_null_source_over_several_blocks(spark):
    import duckdb

    from rippletrace.llm.queries import _OP6_SQL

    rows = [(k, "w " * (k % 7 + 1), None if k % 3 else f"s{k % 2}") for k in range(600)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        got = _check(spark, rows)
    finally:
        spark.conf.set(merge, before)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").toArrow()
    con = duckdb.connect()
    con.register("documents", docs)
    expected = con.execute(f"SELECT doc_id, taken FROM ({_OP6_SQL})").fetchall()
    assert sorted((r.id, r.taken) for r in got) == sorted(expected)


def test_mix_repeats_what_the_plan_takes(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(k % 5 + 1)), f"s{k % 3}") for k in range(60)] + [(99, "x y z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = stored(mixing.sizes(df))
    taken = {r.id: r.taken for r in mixing.taken(sized, mixing.plan(sized)).collect()}
    words = defaultdict(int)
    for r in mixing.mix(df).collect():
        words[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    assert words[99] == 9


def test_odd_rows(spark):
    df = odd(spark)
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(none(spark)).count() == 0
