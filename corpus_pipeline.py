"""From raw documents to token ids: five stages, each one of the text operators at work."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm import bpe, mixing, near_copies, quality_model, secrets
from rippletrace.llm.common import free
from rippletrace.llm.queries import held_out
from rippletrace.plans.durable import stored

#: A document stays if good quality is at least this likely.
KEEP_FROM = 0.3

#: SQL has no hashed embeddings, XXH64 fingerprints or merges; tests compare with brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text wherever a stage changes it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are judged by the labels' share, equal texts alike; rows with a null id are
    judged like any other, and repeated rows all stay or all go.
    """
    column, = free(docs, "_quality_score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(docs, labels, ~held_out())
    scored = quality_model.score(docs, model, score_col=column)
    return scored.where(F.col(column) >= KEEP_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike by 0.8 or more in five-word shingles, the one with the smallest id.

    SimHash fingerprints linked by BK-trees find most of them; four bits reach only about 0.95, so
    MinHash keys name what lies beyond, and an exact check decides every link. Null and empty
    texts are one group; repeated rows leave one; a null id stays only where its group has no other.
    """
    return near_copies.deduplicate(docs)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with each secret in its text replaced by a mark; a null text stays null."""
    return _measured(secrets.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, kept or left out as the target weights of their sources ask.

    A null source is a source; a null text has no words to count. Rows of one id are drawn by size.
    """
    return _measured(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, repeated ones too, and whether they decode to its text; null texts have none."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secret_removal", secret_removal),
    ("source_mix", source_mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
