"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.plans.durable import stored

from . import (
    bpe,
    collocations,
    html_template,
    mixing,
    periodic_runs,
    quality_model,
    quality_rules,
    rank_array,
    secrets,
    simhash,
    spotsigs,
    substrings,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
#: Words as the contracts name them, as a DuckDB pattern.
_SQL_WORD = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha(column) -> F.Column:
    return F.sha2(column, 256)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    spans = F.col("spans")

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(part):
        one = F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(one, ",")

    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(of, secrets.BASE), _sha(listed(base)).alias("base_sha256"),
                        listed(spans).alias("spans"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_template.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: Rules given by the contract of op5: site and verdict.
SITE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = [url_filter.site_rule(name, verdict) for name, verdict in SITE_RULES.items()] + url_filter.word_rules()
    judged = url_filter.judge(pages, rules)
    by_site = F.col("rule").isin(*SITE_RULES)
    return judged.select("page_id", "host", "path", F.when(by_site, F.col("rule")).alias("rule"), "verdict",
                         F.when(~by_site, F.col("rule")).alias("word_rule"))


_OP5_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^?#]*') AS place FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(place, length(raw) + 1) AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    nullif(regexp_extract(host || path,
      '(?s)^([^/]*[.-])?({"|".join(url_filter.WORD_LIST)})([.-][^/]*)?(/.*)?$', 2), '') AS word
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL AND word IS NOT NULL THEN '~' || word END AS word_rule
FROM r"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(mixing.sizes(_documents(spark, sf_dir)), "sizes")
    mixed = mixing.taken(sized, mixing.plan(sized))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}')) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
lv AS (
  SELECT *, {mixing.MAX_EPOCHS} * source_size AS lim,
         (SELECT sum(source_size) FROM s)
           - coalesce(sum({mixing.MAX_EPOCHS} * source_size) OVER before_, 0) AS num,
         (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before_, 0) AS den
  FROM s WINDOW before_ AS (ORDER BY source_size / w, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by(num, -den) AS num, max(den) AS den FROM lv WHERE w * num <= lim * den),
t AS (
  SELECT source, source_size,
         CASE WHEN w * l.num > lim * l.den THEN CAST(lim AS DOUBLE)
              ELSE CAST(CAST(w * l.num AS BIGINT) AS DOUBLE) / CAST(CAST(l.den AS BIGINT) AS DOUBLE) END AS target
  FROM lv, level l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {mixing.MAX_EPOCHS}) ELSE 0 END AS whole
  FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, CAST(p.whole AS BIGINT) AS whole,
         CAST(floor(target + 0.5) AS BIGINT) - CAST(p.whole AS BIGINT) * p.source_size AS extra,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken
FROM r"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_documents(spark, sf_dir).select("doc_id", "text"))


_OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS ws, row_number() OVER () AS row_id
  FROM documents),
win AS (
  SELECT row_id, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS w
  FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
gone AS (
  SELECT row_id, i FROM (SELECT row_id, i, doc_id, min(doc_id) OVER (PARTITION BY w) AS lead FROM win)
  WHERE doc_id > lead),
covered AS (
  SELECT row_id, list(DISTINCT i + k) AS places FROM gone, range(0, 50) r(k) GROUP BY row_id),
kept AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT d.row_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT row_id, unnest(places) AS i FROM covered) c
                    WHERE c.row_id = t.row_id AND c.i = t.i)
  GROUP BY row_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN kept USING (row_id)"""


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(_documents(spark, sf_dir))


def held_out() -> F.Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(docs, labels, ~held_out())
    scored = quality_model.score(docs, model).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("strict").alias("kept"),
        "n_lines", "n_letters", "n_capitals", "failed_bits")


_OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, text, row_number() OVER () AS row_id,
         regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SQL_WORD}')) AS ls
  FROM documents),
grams AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS times
  FROM (SELECT row_id, i, ws[i:i + 4] AS gram
        FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, range(0, 5) r(k) WHERE times >= 2 GROUP BY row_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g'))
              AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS BIGINT) AS n_letters,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN covered USING (row_id)),
b AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
                 + 4 * (2 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 5 * n_lines)::INT
                 + 16 * (word_chars < 2 * n_words OR word_chars > 30 * n_words)::INT
                 + 32 * (n_letters >= 20 AND 10 * n_capitals > 7 * n_letters)::INT AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, n_lines, n_letters, n_capitals, failed_bits
FROM b"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir).select("lang", "text"))


_OP11_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (
  SELECT lang, ws, count(*) AS times
  FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) GROUP BY lang, ws),
g AS MATERIALIZED (
  SELECT lang, size, phrase, CAST(sum(times) AS BIGINT) AS f
  FROM (SELECT lang, times, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, ws, times, size, unnest(range(1, len(ws) - size + 2)) AS i
              FROM w, range(1, {collocations.LONGEST + 1}) s(size) WHERE len(ws) >= size))
  GROUP BY lang, size, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE size > 1 AND f >= {collocations.MIN_COUNT}),
parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
often AS MATERIALIZED (SELECT lang, phrase, f FROM g WHERE f >= {collocations.MIN_COUNT}),
cut AS (
  SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r,
         ({collocations.SCALE}::HUGEINT * a) // (l.f::HUGEINT + r.f::HUGEINT) AS score
  FROM parts p JOIN often l ON l.lang = p.lang AND l.phrase = p.first
  JOIN often r ON r.lang = p.lang AND r.phrase = p.rest),
weakest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(ws[i:i + width - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, size - width + 2)) AS i FROM c, range(2, {collocations.LONGEST}) t(width)
        WHERE size > width)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.f IS NULL OR 100 * o.f::HUGEINT < {collocations.ABSORBED_PERCENT} * w.a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""


def op12_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = rank_array.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    both = rank_array.encode(docs, vocabulary, ids_col=None, packed_col="packed", decoded_col="decoded")
    return both.select("doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
                       _sha("packed").alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def _looped(doc_id: F.Column, text: F.Column) -> F.Column:
    """The text, with the tail of every tenth document (by the CRC-32 of its id) replaced by a loop."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(w: F.Column) -> F.Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        rounds = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), rounds)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    # the words are bound once, as the element of an array
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find(docs, keep_text=False)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(ranked)
    length = -top["less"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), length.alias("length"),
        top["period"].alias("period"),
        ((length * 1000 - length * 1000 % top["period"]) / top["period"]).cast("long").alias("exponent_milli"),
        _sha(F.array_join(line, "")).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op3_html_text": op3_html_text,
    "op5_url_filter": op5_url_filter,
    "op6_source_mixing": op6_source_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_spotsigs": op8_spotsigs,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_rank_array_bpe": op12_rank_array_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op5_url_filter": _OP5_SQL,
    "op6_source_mixing": _OP6_SQL,
    "op7_substring_dedup": _OP7_SQL,
    "op10_quality_rules": _OP10_SQL,
    "op11_collocations": _OP11_SQL,
}
