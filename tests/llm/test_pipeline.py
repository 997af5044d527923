import public_tokenizers
import pytest
import tiktoken

from rippletrace.llm import bpe

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    kept = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    assert len(set(kept.values())) == len(kept) == seen["near_duplicates"].count()
    assert seen["secret_removal"].count() == len(kept)
    assert seen["secret_removal"].where("text rlike 'AKIA[A-Z0-9]{14}' or text rlike '[0-9a-f]{16}'").count() == 0
    mixed = seen["source_mix"].select("doc_id", "text").collect()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.read_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    expected = sorted((r.doc_id, coder.encode_ordinary(r.text)) for r in mixed)
    got = seen["tokens"].collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == expected and all(r.round_trip for r in got)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    stays = {r.doc_id for r in seen["quality"].collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(good & known & stays) >= 0.95 * len(good & known)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
