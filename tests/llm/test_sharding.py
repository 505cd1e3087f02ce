"""Sharding: sizes, checksums, gapless places, near-equal bytes, map edits."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import sharding
from quillon.llm.registry import op6_virtual_slot_sharding


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_virtual_slot_sharding(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    places, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]))
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(places) == set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 40


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_no_group_of_equal_texts_is_split_and_shards_are_equal(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    placed = sharding.shard_documents(docs).join(docs.select("doc_id", "text"), "doc_id").groupBy("text")
    assert placed.agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    sizes = [r.bytes for r in sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 40 and max(sizes) <= 1.01 * sum(sizes) / 40 and min(sizes) >= 0.99 * sum(sizes) / 40


def test_rebalance_moves_only_into_new_shards():
    loads = [sharding.SlotLoad(s, 100 + s * 37 % 91, 3) for s in range(800)]
    old = sharding.first_map(loads, 10)
    new = sharding.rebalance(old, loads, 11)
    moved = {s for s in old if old[s] != new[s]}
    assert moved and all(new[s] == 10 for s in moved)
    sizes = defaultdict(int)
    for load in loads:
        sizes[new[load.slot]] += load.bytes
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 11
    fewer = sharding.rebalance(new, loads, 9)
    assert set(fewer.values()) == set(range(9)) and set(fewer) == set(new)


def test_edges(spark):
    schema = "doc_id long, text string, size string, slot int, shard int"
    rows = [(None, None, "a", 1, 1), (1, "", "a", 1, 1), (2, "x", None, None, None), (2, "x", None, None, None), (3, "é" * 100000, "b", 2, 2)]
    got = sharding.shard_documents(spark.createDataFrame(rows, schema), shards=2, slots=8).collect()
    assert sorted(r.size for r in got) == [16, 16, 17, 17, 200016]
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0


def test_stored_maps_and_read_back(spark, tmp_path):
    rows = [(k, f"text {k % 700} " * (k % 9 + 1)) for k in range(2000)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/maps"
    first = {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard_documents(docs, 10, 256, path).collect()}
    second = {r.doc_id: (r.virtual_slot, r.shard, r.map_version) for r in sharding.shard_documents(docs, 11, 256, path).collect()}
    maps = sharding.SlotMaps(spark, path)
    assert maps.versions() == [1, 2]
    one, two = ({r.virtual_slot: r.shard for r in maps.load(v).collect()} for v in (1, 2))
    assert {r.version for r in maps.load().collect()} == {2} and one.keys() == two.keys()
    assert all(two[s] == 10 for s in one if one[s] != two[s]) and 10 in two.values()
    for doc, (slot, shard) in first.items():
        assert one[slot] == shard and second[doc] == (slot, two[slot], 2)


def test_equal_texts_share_a_slot_unless_they_are_many(spark):
    rows = [(k, f"unique {k}") for k in range(3000)] + [(5000 + k, "twice the same") for k in range(2)] + [(None, "hot group") for k in range(1500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 512).collect()
    assert len({r.virtual_slot for r in got if r.doc_id in (5000, 5001)}) == 1
    assert len({r.virtual_slot for r in got if r.doc_id is None}) > 50
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8
