"""Quality scores: held-out accuracy, and that labels never reach a score."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality
from quillon.llm.registry import op4_quality_classifier


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op4_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y, _ in held]) >= 0.97
    good, bad = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_fold_is_not_learned_from(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.cut == b.cut


def test_edges(spark):
    schema = "doc_id long, text string, score string, c0 string, lang string"
    rows = [(None, None, "a", "b", None), (1, "", "a", "b", "x"), (2, "good words here. " * 5, None, None, None), (2, "good words here. " * 5, None, None, None), (3, "%%% ### " * 90000, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(2, 1, 0), (3, 0, None), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, some)
    kept = quality.filter_quality(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.filter("doc_id >= 2").collect()] == [2, 2]
    assert quality.classify(docs.limit(0), some).count() == 0
