import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from rippletrace.llm import periodic_runs
from rippletrace.llm.queries import QUERIES

from .cases import documents, none, odd, words


def brute(tokens, least=12):
    """Every longest stretch of every period, straight from the definition."""
    n, best = len(tokens), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and tokens[j] == tokens[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def _sequences():
    draw = random.Random(5)
    for k in range(400):
        letters = draw.choice(["a", "ab", "ab", "abc", "abcdefgh"])
        out = [draw.choice(letters) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            a, p, times = draw.randint(0, len(out)), draw.randint(1, 9), draw.randint(2, 6)
            out[a:a] = [draw.choice(letters) for _ in range(p)] * times
        yield out + out[:draw.randint(0, len(out))] * (k % 3)


@pytest.mark.parametrize("pairs", [periodic_runs.PAIRS, 10**9, -1])
def test_runs_equal_the_definition(monkeypatch, pairs):
    """With the usual bound, by diagonals alone and by anchors alone."""
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    monkeypatch.setattr(periodic_runs, "_ANCHORS", 50)
    texts = list(_sequences())
    codes = [np.array([ord(c) for c in t], np.int64) for t in texts]
    assert periodic_runs.runs_of(codes) == [brute(t) for t in texts]
    assert periodic_runs.runs_of(codes, 5) == [brute(t, 5) for t in texts]


def test_a_false_match_of_keys_is_noticed(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_MULTIPLIER", np.uint64(0))
    texts = list(_sequences())[:60]
    codes = [np.array([ord(c) for c in t], np.int64) for t in texts]
    assert periodic_runs.runs_of(codes) == [brute(t) for t in texts]


def test_long_texts_of_few_words_take_no_square():
    draw = random.Random(1)
    blocks = np.concatenate([np.append(np.zeros(draw.randint(1, 900), np.int64), 1) for _ in range(600)])
    began = time.time()
    for code in (np.zeros(300_000, np.int64), np.arange(300_000) % 7, blocks):
        periodic_runs.runs_of([code])
    assert periodic_runs.runs_of([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]
    assert time.time() - began < 60


def _edited(doc_id, tokens):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(tokens)
    if h % 10 or not n:
        return tokens
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return tokens[:a] + [tokens[a + (i - a) % p] for i in range(a, n)]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(doc_id, text):
    tokens = _edited(doc_id, words(text))
    runs = brute(tokens)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *best, _sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            _sha(" ".join(w for i, w in enumerate(tokens) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(d, " ".join(words(t)[:300])) for d, t, _ in documents(150)]
    rows += [(d, "\t" + t + "\n") for d, t in ((k, " ".join(random.Random(k).choices("abcdef", k=k))) for k in range(1000, 1120))]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "né \x85 " * 30), (5000, "x " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((_expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_nulls_clashes_and_no_rows(spark):
    df = odd(spark)
    found = periodic_runs.find(df)
    assert sorted(found.columns) == sorted({*df.columns, "n_words", "runs", "collapsed"})
    got = found.select("text", "n_words", "runs", "collapsed", "score").collect()
    assert len(got) == df.count()
    for r in got:
        tokens = words(r.text)
        assert r.n_words == len(tokens) and r.score == "mine"
        if len(tokens) < 1000:
            assert [tuple(x) for x in r.runs] == brute(tokens)
    assert periodic_runs.find(none(spark)).count() == 0
