"""Token-plane files: exact round trips, order, and the query against brute force."""

import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import token_planes as tp
from quillon.llm.registry import op9_token_planes, tokenizer_file


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("planes", [4, 32])
def test_file_round_trip(planes):
    rng = np.random.default_rng(0)
    docs = [(d, rng.integers(0, 2**32, n, dtype=np.uint32)) for d, n in [(None, 3), (-5, 0), (7, 1), (7, 1000), (2**62, 64), (2**62 + 1, 129)]]
    out = io.BytesIO()
    writer = tp.ShardWriter(out, planes, 64, 3)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = tp.ShardReader(Source(out.getvalue()))
    assert reader.n_ids == sum(len(i) for _, i in docs)
    for (d, ids), (got_d, _, got) in zip(docs, reader.documents(), strict=True):
        assert d == got_d and np.array_equal(ids, got)
    broken = bytearray(out.getvalue())
    broken[12] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(tp.ShardReader(Source(bytes(broken))).documents())


def test_query_against_brute_force(spark, sf_dir):
    rows = op9_token_planes(spark, sf_dir).collect()
    tok, start = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows}
    for doc, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edges(spark):
    path, schema = tokenizer_file("byte_bpe_50k.json"), "text string, doc_id long, part int, path string"
    rows = [("b", 2, 1, "x"), (None, 1, 2, None), ("", None, 3, "y"), ("a", 2, None, "z"), ("a", 2, None, "z")]
    for planes in ("byte", "bit"):
        shards = tp.write_planes(spark.createDataFrame(rows, schema), path, 2, planes=planes, block_ids=2)
        got = sorted(tp.read_planes(spark, shards, with_ids=True).collect(), key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
        got.sort(key=lambda r: (r.doc_id is not None, r.doc_id, list(r.ids)))
        assert [(r.doc_id, list(r.ids)) for r in got] == [(None, [2]), (1, [2]), (2, [64, 2]), (2, [64, 2]), (2, [65, 2])]
    assert tp.write_planes(spark.createDataFrame([], schema), path, 2) == []
    assert tp.read_planes(spark, []).count() == 0


def test_a_retried_task_counts_once(spark, tmp_path, monkeypatch):
    """Attempts that die after their file is written leave no rows and no file."""
    out, path = tmp_path / "planes", tokenizer_file("byte_bpe_50k.json")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    first = tp.write_planes(docs, path, 2, f"file://{out}")
    run = first[0].path.rsplit("/", 1)[1][:12]
    (out / f"{run}-000000-deadattempt1.qpl").write_bytes(b"half")
    tp._drop_strays(spark, f"file://{out}", run, {s.path.rsplit("/", 1)[1] for s in first})
    assert sorted(f"file://{p}" for p in out.glob("*.qpl")) == sorted(s.path for s in first)
    again = tp.write_planes(docs, path, 2, f"file://{out}")
    assert not {s.path for s in first} & {s.path for s in again}
    for shards in (first, again):
        assert sorted(r.doc_id for r in tp.read_planes(spark, shards).collect()) == list(range(50))


def test_a_hot_id_is_parted(spark):
    rows = [(None, f"text {k}") for k in range(600)] + [(k, "x") for k in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tp.write_planes(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 2 and max(s.documents for s in shards) < 400
    got = sorted(tp.read_planes(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 600 + list(range(200))
