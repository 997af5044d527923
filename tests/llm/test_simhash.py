import random

import numpy as np
import xxhash

from rippletrace.llm import graph, simhash

from .cases import documents, none, odd, words


def _fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(values, ids, radius=4):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, v in enumerate(values):
            near = [j for j, u in enumerate(values) if (u ^ v).bit_count() <= radius]
            low = min(label[j] for j in near)
            for j in near:
                changed |= label[j] != low
                label[j] = low
    return label


def test_fingerprints_equal_brute_force():
    for text in ["", " ", "One two", "İ A\x85b c d e", "é É a b c d " * 9] + [t for _, t, _ in documents(20)]:
        assert simhash.fingerprint(text) == _fingerprint(text)


def _near(draw, n, bases, most):
    out = set()
    while len(out) < n:
        x = draw.choice(bases)
        for _ in range(draw.randint(0, most)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out)


def test_forest_finds_every_component():
    draw = random.Random(3)
    for sizes in ([1, 2, 3, 40, 120], [300], [5] * 60):
        shard, values, expected = [], [], []
        for k, n in enumerate(sizes):
            own = _near(draw, n, [draw.getrandbits(64) for _ in range(max(1, n // 12))], 7)
            expected += [len(values) + x for x in _components(own, range(n))]
            shard += [k] * n
            values += own
        got = simhash.Forest(np.array(shard), np.array(values, np.uint64)).link(4)
        assert got.tolist() == expected


def test_shards_and_chunks_lose_no_link(spark, monkeypatch):
    draw = random.Random(4)
    values = _near(draw, 500, [draw.getrandbits(64) for _ in range(30)], 6)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(signed, range(500), strict=True)), "fp long, rep long")
    expected = _components(values, range(500))
    for chunk, shard, buffer in ((40_000, 256, 30_000), (7, 256, 20), (40_000, 1, 64)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "_BUFFER", buffer)
        named = {r.node: r.component for r in graph.components(simhash.links(nodes)).collect()}
        assert [named.get(k, k) for k in range(500)] == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert graph.components(links.where("false")).count() == 0


def test_groups_and_deduplication_of_odd_rows(spark):
    df = odd(spark)
    got = simhash.groups(df).collect()
    assert len(got) == df.count()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[0].component_id == of[1].component_id == of[2].component_id == 0 and of[0].fingerprint == 0
    assert of[7].component_id == 6 and of[5].component_id == 4
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(6) == 1 and not {1, 2, 5, 7} & set(ids)
    assert simhash.groups(none(spark)).count() == 0


def test_a_null_id_links_the_others(spark):
    """Ids 1, null, 2 in a chain whose ends are too far apart are one component."""
    draw = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    chain = [" ".join(words)]
    for _ in range(60):
        words[draw.randrange(300)] = f"x{draw.randrange(10**6)}"
        chain.append(" ".join(words))
    fp = [simhash.fingerprint(t) for t in chain]
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4
    a, b, c = next((a, b, c) for a in range(60) for b in range(a + 1, 60) for c in range(b + 1, 60)
                   if near(a, b) and near(b, c) and not near(a, c) and len({fp[a], fp[b], fp[c]}) == 3)
    df = spark.createDataFrame([(1, chain[a]), (None, chain[b]), (2, chain[c]), (None, "far away")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(df).collect()}
    assert sorted(v for k, v in got.items() if v is not None) == [1, 1, 1] and None in got.values()
