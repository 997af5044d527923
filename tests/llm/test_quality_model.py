import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rippletrace.llm import quality_model

from .cases import none, odd


def test_held_out_accuracy_and_reruns(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality_model.fit(documents, labels, ~held)
    again = quality_model.fit(documents.repartition(7), labels, ~held)
    assert np.array_equal(model.weight, again.weight) and model.bias == again.bias
    rows = quality_model.score(documents.join(labels, "doc_id"), model).select("doc_id", "quality", "score").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean(np.array(good) >= 0.3) > 0.97


def test_scores_do_not_depend_on_blocks():
    draw = random.Random(1)
    texts = [" ".join(draw.choice("ab cd ef gh".split()) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    weight = np.random.default_rng(0).normal(size=quality_model.BUCKETS).astype(np.float32)
    model = quality_model.Model(weight, 0.2)
    together = model.scores(quality_model.Features(), texts)
    alone = [model.scores(quality_model.Features(), [t])[0] for t in texts]
    assert np.allclose(together, alone)


def test_training_and_scoring_read_the_same_features(spark):
    """The score of a text is the model applied to the counts that training is given."""
    texts = ["one two two three", "", "née ab", "word " * 40, " ".join(f"w{k}" for k in range(300))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    weight = np.random.default_rng(2).normal(size=quality_model.BUCKETS).astype(np.float32)
    model = quality_model.Model(weight, -0.1)
    counted = {r.doc_id: r for r in quality_model._counted(df, "text").collect()}
    for r in quality_model.score(df, model).collect():
        buckets = np.array(counted[r.doc_id].buckets, int) + quality_model.BUCKETS // 2
        counts = np.array(counted[r.doc_id].counts)
        mean = (weight[buckets] * counts).sum() / counts.sum() if len(counts) else 0.0
        assert abs(r.score - 1 / (1 + np.exp(0.1 - mean))) < 1e-6


def test_the_sample_is_bounded_in_bytes_and_does_not_depend_on_partitions(spark, monkeypatch):
    rows = [(k % 40, f"text {k} " + "word " * (k % 17), k % 2) for k in range(120)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    whole = quality_model.fit(df, labels, F.lit(True))
    monkeypatch.setattr(quality_model, "SAMPLE_BYTES", 800)
    models = [quality_model.fit(df.repartition(n), labels, F.lit(True)) for n in (1, 7)]
    assert np.array_equal(models[0].weight, models[1].weight) and not np.array_equal(models[0].weight, whole.weight)


def test_odd_rows_and_missing_labels(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_model.fit(df, labels, F.lit(True))
    got = quality_model.score(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    empty = quality_model.fit(df, labels.where("false"), F.lit(True))
    assert {round(r.score, 6) for r in quality_model.score(df, empty).collect()} == {0.5}
    assert quality_model.score(none(spark), model).count() == 0
