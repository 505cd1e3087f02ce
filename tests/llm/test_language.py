"""Language prediction: held-out accuracy, the unknown, and edge rows."""

import zlib

import numpy as np

from quillon.llm import language
from quillon.llm.registry import op10_language_id


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.97


def test_pairs_only_within_families():
    x = np.eye(8, language.DIMENSIONS, dtype=np.float32)
    model = language.fit(x, ["en", "de", "fr", "es", "pt", "xx", "en", "de"])
    assert model.families == ["germanic", "only-xx", "romance"]
    assert model.pairs == [("de", "en"), ("es", "fr"), ("es", "pt"), ("fr", "pt")]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int, c1 string"
    rows = [(k, "the cat and the dog " * 3, "en", 1, "x") for k in range(8)] + [(k, "der Hund und die Katze " * 3, "de", 1, "x") for k in range(20, 28)]
    odd = [(None, None, None, None, None), (100, "", "en", 1, ""), (101, "123 !!", None, 1, ""), (103, "² ½ Ⅷ ①", "en", 1, ""), (104, "_ ʰ", None, 1, ""), (102, "der Hund " * 100000, None, None, "y"), (102, "der Hund", None, None, "y")]
    docs = spark.createDataFrame(rows + odd, schema)
    got = sorted(((r.doc_id or -1, r.lang_pred) for r in language.classify(docs).collect()), key=str)
    assert dict(got)[-1] == dict(got)[100] == dict(got)[101] == dict(got)[103] == "und" != dict(got)[104]
    assert [p for d, p in got if d == 102] == ["de", "de"] and dict(got)[3] == "en" and dict(got)[25] == "de"
    kept = language.filter_language(docs, language.train(docs))
    assert kept.columns == docs.columns and kept.count() == 19
    assert language.classify(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    langs = [f"x{k}" for k in range(60)]
    words = {v: " ".join(chr(97 + k // 26) + chr(97 + k % 26) + c for c in "abcdefgh") for k, v in enumerate(langs)}
    rows = [(k * 8 + j, words[v], v) for k, v in enumerate(langs) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (20_000, 10):
        monkeypatch.setattr(language, "ALL_FIT_ROWS", bound)
        model = language.train(docs)
        assert sorted(sum(model.members.values(), [])) == sorted(langs)
        assert model.predict(list(words.values()))[0] == langs


def test_an_id_on_many_rows_takes_one_place(spark, monkeypatch):
    seen, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda x, y: seen.append(list(y)) or fit(x, y))
    free = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, f"the cat and dog number {k}", "en") for k in free[:300]] + [(free[300], "der Hund", "de")]
    hot = spark.createDataFrame([(free[400], "the hot one", "en")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(hot.crossJoin(spark.range(3000)).drop("id"))
    language.train(docs)
    assert seen[0].count("en") == 301 and seen[0].count("de") == 1
