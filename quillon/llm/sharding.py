"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by their text into a fixed number of slots (thousands, many
times the shards), so equal texts share a slot and a shard; only a group of equal texts
with more bytes than the mean shard, which no one shard could hold beside equal others,
is salted into pieces of about the mean slot. Bytes and rows are summed by slot,
and the map gives every slot a shard. Rebalancing edits the map: only slots that
must move get another shard, and the records keep their slots for good.

The map is stored as a Parquet table with a folder for each version; versions are
only ever added, and a reader takes the newest or the one that it names.

Places within a shard come from the row number inside a slot and the running
count of the shard's slots, so no shard is gathered in one task. Only DataFrame
functions run on the executors; the driver plans over one row for each slot.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.staging import shared_path, stage

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16  # added to the bytes of the text for each record

MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long, base long"


@dataclass(frozen=True)
class SlotLoad:
    slot: int
    bytes: int
    rows: int


def digest(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; a null text has no bytes.

    Fewer than ``shards`` groups can be above the mean shard, so the table of their
    sizes that is broadcast has a proven bound. Pieces of a group are dealt by
    row, so a repeated ``doc_id`` does not gather in one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    columns = [F.col("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group")]
    rows = stage(docs.select(*columns, F.monotonically_increasing_id().alias("row")), "digest")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().bytes
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > total / shards)
    large = F.broadcast(groups.select("group", F.ceil(F.col("bytes") / max(1.0, total / slots)).alias("pieces")))
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1)))
    slot = F.pmod(F.xxhash64("group", piece), F.lit(slots)).cast("int")
    return rows.join(large, "group", "left").select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> list[SlotLoad]:
    """Bytes and rows by slot: at most as many rows as there are slots."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return sorted((SlotLoad(r.virtual_slot, r.bytes, r["rows"]) for r in sums.collect()), key=lambda s: (-s.bytes, s.slot))


def first_map(loads: list[SlotLoad], shards: int = SHARDS) -> dict[int, int]:
    """Slots by falling bytes, each to the shard that has the fewest so far."""
    heap, chosen = [(0, k) for k in range(shards)], {}
    for load in sorted(loads, key=lambda s: (-s.bytes, s.slot)):
        size, shard = heapq.heappop(heap)
        chosen[load.slot] = shard
        heapq.heappush(heap, (size + load.bytes, shard))
    return chosen


def rebalance(current: dict[int, int], loads: list[SlotLoad], shards: int) -> dict[int, int]:
    """An edit of the map for other loads or more shards that moves few slots.

    Slots leave a shard only while it is above the mean, and go only to shards
    below it, so shards that are added take slots and no other traffic occurs.
    Slots of shards that are taken away are dealt out first.
    """
    by_slot, chosen = {s.slot: s for s in loads}, {}
    sizes = [0] * shards
    homeless = []
    for load in loads:
        shard = current.get(load.slot, shards)
        if shard < shards:
            chosen[load.slot] = shard
            sizes[shard] += load.bytes
        else:
            homeless.append(load.slot)
    mean = sum(s.bytes for s in loads) / shards
    moving = list(homeless)
    for shard in range(shards):
        for slot in sorted((s for s, k in chosen.items() if k == shard), key=lambda s: (by_slot[s].bytes, s)):
            if sizes[shard] - by_slot[slot].bytes < mean:
                break
            sizes[shard] -= by_slot[slot].bytes
            moving.append(slot)
    heap = [(size, k) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-by_slot[s].bytes, s)):
        size, shard = heapq.heappop(heap)
        chosen[slot] = shard
        heapq.heappush(heap, (size + by_slot[slot].bytes, shard))
    return chosen


def map_table(spark: SparkSession, chosen: dict[int, int], loads: list[SlotLoad], version: int) -> DataFrame:
    """The stored form of a map: a row for each slot that holds records.

    ``base`` is the number of rows of the shard's slots before it.
    """
    at: dict[int, int] = {}
    rows = []
    for load in sorted(loads, key=lambda s: s.slot):
        shard = chosen[load.slot]
        rows.append({"version": version, "virtual_slot": load.slot, "shard": shard, "bytes": load.bytes, "rows": load.rows, "base": at.get(shard, 0)})
        at[shard] = at.get(shard, 0) + load.rows
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{MAP_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return spark.range(1).select(F.inline(parsed))


class SlotMaps:
    """The versions of a slot-to-shard map under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The stored versions; one counts once its write is complete."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop(self.path)):
            return []
        done = (s.getPath().getName() for s in fs.listStatus(hadoop(self.path)) if fs.exists(hadoop(s.getPath(), "_SUCCESS")))
        return sorted(int(name.removeprefix("version-")) for name in done if name.startswith("version-"))

    def load(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        number = version if version is not None else max(self.versions())
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version-{number:06d}")

    def store(self, chosen: dict[int, int], loads: list[SlotLoad]) -> int:
        """Write the next version; an existing one is never written over."""
        number = max(self.versions(), default=0) + 1
        map_table(self.spark, chosen, loads, number).write.mode("error").parquet(f"{self.path}/version-{number:06d}")
        return number

    def edit(self, loads: list[SlotLoad], shards: int) -> int:
        """Rebalance the newest version for other loads or shards; the new version."""
        current = {r.virtual_slot: r.shard for r in self.load().collect()}
        return self.store(rebalance(current, loads, shards), loads)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard``, ``slot`` (place in the shard, gapless) and ``map_version``.

    The map has at most one row for each slot, so broadcasting it is bounded.
    Equal records take neighbouring places in either order.
    """
    own = slot_map.select("virtual_slot", "shard", "base", F.col("version").alias("map_version"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("local", F.row_number().over(order) - 1)
    placed = ranked.join(F.broadcast(own), "virtual_slot")
    return placed.withColumn("slot", (F.col("base") + F.col("local")).cast("long")).drop("base", "local")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every document with its slot and shard under the newest map.

    With a ``map_path`` that holds versions the newest is edited for these loads
    and stored as the next; otherwise version 1 is made (in the shared folder
    where no path is given). Null ids and texts, empty and very long texts,
    repeated rows and other columns of any name are all allowed; equal records
    take neighbouring places in either order; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(digest(docs, slots, shards), "slot-digest")
    loads, maps = slot_loads(rows), SlotMaps(spark, map_path or shared_path(spark, "slot-maps"))
    version = maps.edit(loads, shards) if maps.versions() else maps.store(first_map(loads, shards), loads)
    return place(rows, maps.load(version))
