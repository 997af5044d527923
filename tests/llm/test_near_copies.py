import random

import corpus_pipeline
import pytest

from rippletrace.llm import graph, near_copies

from .cases import none, odd, words


def _set(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _groups(texts, ids):
    sets, label, changed = [_set(t) for t in texts], list(ids), True
    near = [[j for j, u in enumerate(sets) if 10 * len(u & s) >= 8 * len(u | s)] for s in sets]
    while changed:
        changed = False
        for i in range(len(sets)):
            low = min(label[j] for j in near[i])
            changed |= label[i] != low
            label[i] = low
    return label


def _edited(draw, base, times):
    w = list(base)
    for _ in range(times):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("local", [graph.LOCAL_LINKS, 0])
def test_groups_equal_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_LINKS", local)
    draw = random.Random(5)
    texts = []
    for k in range(40):
        base = [f"b{k}w{draw.randrange(5000)}" for _ in range(draw.choice([30, 120, 400]))]
        texts += [_edited(draw, base, draw.randint(0, len(base) // 40 + 1)) for _ in range(6)]
    # a chain whose ends are not alike, and a passage that many texts share by half
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k * 12:] + [f"d{k}x{j}" for j in range(k * 12)]) for k in range(10)]
    texts += [" ".join([f"p{j}" for j in range(40)] + [f"own{k}x{j}" for j in range(40)]) for k in range(40)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    expected = _groups(texts, ids)
    assert len(set(expected)) < len(texts)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(expected)


def test_distances_cover_every_pair():
    import numpy as np

    draw = random.Random(6)
    for parts in (1, 2, 5, 40):
        key = np.sort(np.array([draw.randrange(6) for _ in range(90)]))
        node = np.arange(90)
        part = np.array([draw.randrange(parts) for _ in range(90)])
        got = []
        size, place = np.full(90, 10), np.zeros(90, np.int64)
        for first, last in ((1, 1), (2, 5), (6, 21), (22, 85)):
            for a, b in near_copies._across(key, node, part, size, place, first, last):
                got += [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(90) for j in range(i + 1, 90) if key[i] == key[j] and part[i] != part[j]}


def test_alike_sets_share_a_rare_shingle():
    import numpy as np

    draw = np.random.default_rng(3)
    counts = draw.integers(0, 5, near_copies.COUNTERS)
    for _ in range(400):
        n = int(draw.integers(1, 60))
        base = np.unique(draw.integers(0, 1 << 40, n))
        other = np.unique(np.concatenate([base[draw.random(len(base)) < 0.93], draw.integers(0, 1 << 40, int(draw.integers(0, 5)))]))
        both = len(np.intersect1d(base, other))
        if len(other) and both >= 0.8 * (len(base) + len(other) - both):
            a, b = (near_copies.rarest(x, counts, 0.8).tolist() for x in (base, other))
            shared = set(a) & set(b)
            assert shared
            # the places of the first one allow the pair
            key = next(k for k in a if k in shared)
            ahead = min(len(base) - a.index(key), len(other) - b.index(key))
            assert ahead * 1.8 >= 0.8 * (len(base) + len(other)) - 1e-6


def test_texts_that_share_most_of_a_passage_meet_in_few_pairs(spark, monkeypatch):
    """Alike below 0.8 they never become one component; the pairs compared must not be their square."""
    seen = []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, n, *rest: (seen.append(n), alike(pairs, n, *rest))[1])
    for n in (60, 120, 240):
        texts = [" ".join([f"p{j}" for j in range(80)] + [f"o{k}x{j}" for j in range(20)]) for k in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert near_copies.deduplicate(df).count() == n
        assert sum(seen) <= 4 * n
        seen.clear()


def test_crowds_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 20)
    draw = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = [_edited(draw, base, draw.randint(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicate(df).collect()} == set(_groups(texts, list(range(120))))


def test_same_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, c), (None, c), (3, ""), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_copies.deduplicate(df).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (None, c), (3, "")], df.schema).collect()))
    kept = near_copies.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(set(_groups([r.text for r in odd(spark).collect()], range(17))))
    assert near_copies.deduplicate(none(spark)).count() == 0
