"""The pipeline against its stages' definitions on a small table."""

import corpus_pipeline
from quillon.llm import decontamination, language, quality
from tests.llm.test_simhash import brute_similar


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, function(spark, docs, sf_dir)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    model = language.train(before)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == {d for d, p in zip(texts, model.predict(list(texts.values()))[0], strict=True) if p != "und"}
    before, after = seen["quality_classifier"]
    scores = {r.doc_id: r.score for r in quality.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert ids(after) == {d for d, s in scores.items() if s >= 0.7}
    before, after = seen["simhash_near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert ids(after) == {rows[k][0] for k in brute_similar([t for _, t in rows])}
    before, after = seen["benchmark_decontamination"]
    held = {r.doc_id for r in decontamination.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(after) == ids(before) - held
    before, after = seen["best_fit_packing"]
    assert ids(after) == ids(before)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, after.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated and null ids, clashing columns, empty tables."""
    good = " ".join(f"word{k} and the" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, row string, score int, c0 string, text_hash long"
    rows = [
        (1, good, "en", "s", "r", 1, "x", 1), (1, "der Hund und die Katze", "de", None, None, None, None, None), (None, "one without id", None, "", "", 0, "", 0),
        (None, "another without id", "en", "s", "r", 1, "x", 1), (2, None, "en", None, None, None, None, None), (3, "", None, None, "a", 2, "b", 3), (4, "123 456", "en", None, None, None, None, None),
        (5, good, "en", "s", "other", 9, "y", 2), (5, good, "en", "s", "other", 9, "y", 2), (6, "long " * 60_000 + good, "en", "s", None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "unheard of item words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shown = lambda df: sorted((r.doc_id or 0, (r.text or "")[:9]) for r in df.collect())
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and len(shown(kept)) == 7 and not {2, 3, 4} & {d for d, _ in shown(kept)}
    assert shown(steps["quality_classifier"](spark, docs, str(tmp_path))) == shown(docs)
    single = steps["simhash_near_dedup"](spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    assert shown(single) == sorted([(1, good[:9]), (1, "der Hund "), (0, "one witho"), (0, "another w"), (2, ""), (4, "123 456")])  # the sets of shingles of 6 and 1 are alike
    assert shown(steps["benchmark_decontamination"](spark, docs, str(tmp_path))) == shown(docs)
    packed = steps["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.filter("piece = 0").count() == len(rows)
    for name, function in corpus_pipeline.STAGES:
        empty = function(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (empty.columns == docs.columns or name == "best_fit_packing")
