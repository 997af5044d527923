import hashlib
import random

from pyspark.sql import functions as F

from rippletrace.llm import spotsigs

from .cases import documents, none, odd


def test_edited_texts_and_order(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    rows = [(3 * k, t) for k, t, _ in documents(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.compare_edited(df).collect()}
    down = sorted(rows, reverse=True)
    sets = {r.doc_id: set(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    for k, (i, t) in enumerate(down):
        j, n = down[(k + 1) % len(down)]
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_next - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 1e-12
        assert (got[i].edited_fingerprint == got[i].fingerprint) == (got[i].near_edited == 1)
        # both likenesses follow from the fingerprints
        own, other, after = (set(x.split(",")) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[j].fingerprint))
        assert abs(got[i].near_edited - len(own & other) / len(own | other)) < 1e-12
        assert abs(got[i].near_next - len(own & after) / len(own | after)) < 1e-12
    assert len({r.fingerprint for r in got.values()}) >= len({t for _, t in rows}) - 2


def test_more_ranges_than_two_thousand(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 1)
    ids = [7 * k - 9_000 for k in range(2_300)]
    df = spark.createDataFrame([(k, f"the cat {k}") for k in ids], "id long, body string")
    placed = df.withColumn("at", spotsigs._range_of(F.col("id"), spotsigs._ranges(df.select("id"))))
    assert placed.agg(F.count_distinct("at")).first()[0] > 2_000
    got = {r.id: r.next_body for r in spotsigs.with_next(df, ["body"]).collect()}
    assert got == {k: f"the cat {k - 7 if k > ids[0] else ids[-1]}" for k in ids}


def test_chains_follow_common_words(spark):
    df = spark.createDataFrame([("The cat, of the old barn!",), ("the CAT of (the) old barn",), ("cat old barn",), ("of the",)], "t string")
    a, b, c, d = (r.s for r in df.select(spotsigs.signatures(F.col("t")).alias("s")).collect())
    assert a == b and len(a) == 2 and len(c) == 1 and len(d) == 1 and not set(a) & set(c)


def test_odd_rows_and_lone_row(spark):
    df = odd(spark)
    got = spotsigs.compare_edited(df).collect()
    assert len(got) == df.count()
    by_text = {}
    for r, t in zip(sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id),
                    sorted((r for r in df.collect() if r.doc_id is not None), key=lambda r: r.doc_id), strict=True):
        assert by_text.setdefault(t.text or "", r.fingerprint) == r.fingerprint
    lone = spark.createDataFrame([(5, "the one row here")], "doc_id long, text string")
    assert spotsigs.compare_edited(lone).first().near_next == 1
    assert spotsigs.compare_edited(none(spark)).count() == 0


def test_near_pairs_equal_brute_force(spark):
    draw = random.Random(2)
    base = [[f"w{draw.randrange(400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(70):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            w[draw.randrange(len(w))] = f"e{k}"
        rows.append((k, " the ".join(w)))
    df = spark.createDataFrame(rows + [(None, "the a b")], "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.s) for r in df.where("doc_id is not null").select(
        "doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    named = {s: min(k for k in sets if sets[k] == s) for s in sets.values()}
    members, pairs = spotsigs.near_pairs(df)
    assert {(r.doc_id, r["class"]) for r in members.collect()} == {(k, named[s]) for k, s in sets.items()}
    expected = {(named[a], named[b]) for a in named for b in named
                if named[a] < named[b] and len(a & b) / len(a | b) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected
