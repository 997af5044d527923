"""Rows that every operator has to survive, and the plainest reading of words."""

import random
import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
CLASHING = ("spans", "ids", "decoded", "score", "n_words", "failed_bits", "id", "body", "fp", "sigs", "size", "taken",
            "anchors", "notes", "host", "path", "rule", "verdict", "_range", "_copy", "component", "rep", "t")

TEXTS = [None, "", " \t\n ", "one", "a b c", "A b C", LONG, LONG, "x" * 50_000, "né \U0001f600 \x85 \x1c z\n\nq", "p q r s t " * 40,
         "\0 a \0", "İ ſ K password: abcdefghijklmnop"]


def odd(spark, ids=True):
    """Null, empty, long, repeated and odd texts; null ids and sources; columns named like the operators' own."""
    rows = [(k, t, "s" if k % 3 else None, "en", None) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[6], (None, "a null id b c d", "s", None, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for name in CLASHING:
        df = df.selectExpr("*", f"'mine' AS `{name}`")
    return df


def none(spark):
    return odd(spark).where("false")


def words(text):
    return WORD.findall(text or "")


def documents(n=200, path="/root/testdata/sf0.001/documents.parquet"):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{path}' ORDER BY doc_id LIMIT {n}").fetchall()


def noise(seed, n, letters="ab c\n"):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)]
