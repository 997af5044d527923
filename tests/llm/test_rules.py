from rippletrace.llm import quality_rules

from .cases import LONG, noise, none, odd, words


def _brute(text):
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_measures_equal_brute_force():
    for text in noise(7, 500, "ab c\n#|é") + ["", "a b c d e " * 9, "p q r s t p q r s t x"]:
        assert quality_rules.measure(text)[:6] == _brute(text), repr(text)


def test_many_different_words_are_ranked_exactly():
    tokens = [f"w{k}" for k in range(9000)]
    assert quality_rules.repeated_words(tokens) == 0
    assert quality_rules.repeated_words(tokens + tokens[100:107]) == 14


def test_ledger_policies_and_ablations(spark):
    df = spark.createDataFrame(
        [(1, "few words"), (2, "a b c d e " * 20), (3, "&&& " * 5 + "an ordinary line of eleven words stands here for all"),
         (4, "this is an ordinary line of more than ten words indeed"), (5, None)], "doc_id long, text string")
    book = quality_rules.ledger(df)
    kept = {r.doc_id for r in book.where(quality_rules.passes("strict")).collect()}
    base = {r.doc_id for r in book.where(quality_rules.passes("base")).collect()}
    assert kept == {4} and base == {3, 4}
    rows = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in quality_rules.ablations(book).collect()}
    brute = [{n for k, n in enumerate(quality_rules.RULES) if r.failed_bits >> k & 1} for r in book.collect()]
    for rule in quality_rules.RULES:
        assert rows[rule] == (sum(rule in f for f in brute), sum(f == {rule} for f in brute), sum(not f - {rule} for f in brute))


def test_odd_rows(spark):
    df = odd(spark)
    got = quality_rules.ledger(df)
    assert got.count() == df.count()
    assert {r.n_words for r in got.where("doc_id = 6").collect()} == {len(words(LONG))}
    assert quality_rules.ledger(none(spark)).count() == 0
    assert {r.failed for r in quality_rules.ablations(quality_rules.ledger(none(spark))).collect()} == {0}
