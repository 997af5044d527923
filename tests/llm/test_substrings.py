import hashlib
import random

from rippletrace.llm import substrings

from .cases import documents, none, odd, words


def _brute(rows, length):
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    out = []
    for k, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if k is not None and first[tuple(w[i:i + length])] < k:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_planted_passages_equal_brute_force(spark):
    draw = random.Random(8)
    vocabulary = [f"v{k}" for k in range(40)]
    passages = [[draw.choice(vocabulary) for _ in range(n)] for n in (20, 21, 25, 40, 90)]
    rows = []
    for k in range(150):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            p = list(draw.choice(passages))
            if draw.random() < 0.4:
                p[draw.randrange(len(p))] = "edit"
            at = draw.randint(0, len(w))
            w[at:at] = p
        rows.append((k, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (7, rows[9][1]), (7, rows[7][1]), (300, "a " * 70), (301, "a " * 45), (302, "a " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(substrings.repeats(df, length=20)) == _brute(rows, 20)


def test_real_texts_equal_brute_force(spark):
    rows = [(k, t) for k, t, _ in documents()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(substrings.repeats(df)) == _brute(rows, 50)


def test_odd_rows(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert _rows(substrings.repeats(df)) == _brute(rows, 50)
    assert substrings.repeats(none(spark)).count() == 0
