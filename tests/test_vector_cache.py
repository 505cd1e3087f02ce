"""The vector cache over runs: what is encoded, what is read, what counts as a miss."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.operators.vectors import hashing_vectors
from quillon.sources.vector_cache import Model, append, cached_vectors, read

MODEL = Model("hashing", "1", 16)


@pytest.fixture
def run(spark, tmp_path):
    asked = []

    def encode(missing):
        asked.extend(r.text for r in missing.collect())
        return hashing_vectors(missing, 16)

    def go(rows, model=MODEL):
        asked.clear()
        got = cached_vectors(spark.createDataFrame(rows, "id string, text string"), encode, model, str(tmp_path / "cache"))
        plain = {r.id: r.v for r in hashing_vectors(spark.createDataFrame(rows, "id string, text string").fillna("", "text"), 16).collect()}
        assert {r.id: r.v for r in got.vectors.collect()} == plain or model != MODEL
        return got.hits, got.encoded, sorted(asked)

    return go


ROWS = [("a", "one text"), ("b", "one text"), ("c", "another text"), ("d", None), ("e", "")]


def test_each_text_is_encoded_once(run):
    assert run(ROWS) == (0, 3, ["", "another text", "one text"])
    assert run(ROWS) == (3, 0, [])
    assert run([*ROWS, ("f", "new")]) == (3, 1, ["new"])
    assert run(ROWS, Model("hashing", "2", 16)) == (0, 3, ["", "another text", "one text"])
    assert run([]) == (0, 0, [])


def test_broken_rows_files_and_batches_are_misses(spark, run, tmp_path):
    root = tmp_path / "cache"
    run(ROWS)
    [batch] = root.glob("batch=*")
    (batch / "_SUCCESS").unlink()
    assert run(ROWS)[1] == 3
    [batch] = [b for b in root.glob("batch=*") if (b / "_SUCCESS").exists()]
    files = sorted(batch.rglob("*.parquet"))
    files[0].write_bytes(b"no table")
    Path(files[0].parent, f".{files[0].name}.crc").unlink(missing_ok=True)
    assert run(ROWS)[:2] == (2, 1)
    keys = [r.key for r in read(spark, str(root), MODEL).select("key").collect()]
    assert len(keys) == 3


@pytest.mark.parametrize("change", ["transform(v, x -> x + 0.5)", "slice(v, 1, 3)", "transform(v, x -> double('NaN'))", "transform(v, x -> 0D)", "CAST(NULL AS array<double>)"])
def test_altered_rows_are_not_read(spark, tmp_path, change):
    root = str(tmp_path / "cache")
    vectors = spark.createDataFrame([("0" * 64, [1.0] * 16)], "key string, v array<double>")
    append(vectors, root, MODEL)
    assert read(spark, root, MODEL).count() == 1 and read(spark, root, MODEL, ["ff"]).count() == 0
    [batch] = (tmp_path / "cache").glob("batch=*")
    other = spark.read.parquet(str(batch)).withColumn("v", F.expr(change)).withColumn("shelf", F.lit("00"))
    other.write.partitionBy("shelf").parquet(str(tmp_path / "other" / "batch=x"))
    assert read(spark, str(tmp_path / "other"), MODEL).count() == 0


def test_an_encoder_that_fails_adds_nothing(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    for encode in (lambda m: hashing_vectors(m, 16).limit(1), lambda m: hashing_vectors(m, 8)):
        with pytest.raises(ValueError):
            cached_vectors(texts, encode, MODEL, str(tmp_path / "cache"))
    assert not os.path.exists(tmp_path / "cache")


def test_a_second_command_encodes_nothing(spark, tmp_path, capsys):
    rows = [{"id": f"t-{k}", "title": f"work {k % 2}", "status": "open"} for k in range(4)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "context.json").write_text(json.dumps({"project_id": "p"}))
    given = ["--list", str(tmp_path / "list.json"), "--context", str(tmp_path / "context.json"), "neighbors", "t-0", "--json"]
    out = []
    for more in ([], ["--vector-cache", str(tmp_path / "cache")], ["--vector-cache", str(tmp_path / "cache")]):
        assert cli.run([*more, *given], spark) == 0
        out.append(json.loads(capsys.readouterr().out))
    assert [r.get("vector_cache") for r in out] == [None, {"hits": 0, "encoded": 2}, {"hits": 2, "encoded": 0}]
    assert out[0]["neighbors"] == out[1]["neighbors"] == out[2]["neighbors"]
