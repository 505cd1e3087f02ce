"""Near-duplicates by SimHash fingerprints searched with BK-trees.

A fingerprint sums the 64 hash bits of a text's word shingles. Texts link where
their fingerprints differ in at most ``radius`` bits; a component of links is a
group of near copies.

Only distinct fingerprints are searched. Two that differ in at most r bits agree
in one of r + 1 blocks of bits, so fingerprints that share a block's value form a
shard. A shard that is larger than ``shard_size`` is dealt again by the bits that
its members do not share, by the same rule, so no link is lost and no task gets
an unbounded shard. Each shard's BK-tree has children keyed by their whole-number
distance to the parent, and a search follows only the edges within the radius.
The tree is built where its shard is: a shard's members are also its only
queries, so nothing that grows with the corpus is broadcast.
A shard yields at most one link for each member (a spanning forest).

``representatives`` keeps one document of each group of texts with a similarity
of 0.8 or more over five words. 64 bits tell that similarity only to within a
few tenths, and a radius that covers it leaves no block to share, so there the
fingerprint has 512 bits, its radius is the angle of that similarity and a margin,
shards are texts that share the least hash of one of eight hash functions, and the
sets of shingles decide what is linked. What is too large for a task, by members or
by bytes, is cut into blocks of which every two meet in a task, so a link is found
whatever blocks its ends are in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.sketches import GOLDEN, mix, shingle_hashes
from quillon.plans.components import components
from quillon.plans.staging import bounded_batches, stage

SHINGLE_WORDS = 3
RADIUS = 2
WIDE_WORDS, SIMILARITY = 5, 0.8
WIDE_BITS, MINIMA = 512, 8  # 64 bits from each hash function
WIDE_SHARD, WIDE_DEALS = 16_384, 2
CELL_BYTES = 128 << 20  # of shingles that a task holds, unless a text or two have more
WIDE_CHUNK, SPREADS = 1 << 14, 2.5
SEED = 42
SHARD_SIZE = 256
DEALS = 3  # times that a large shard is dealt again
BATCH_DOCS = 400
HASH_CHUNK = 1 << 16


def word_shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of A-Z-lowered words parted by ASCII white space, space-joined.

    A text of fewer words is one shingle, one without words none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text, as a signed 64-bit number; zero without words."""
    shingles = word_shingles(text, words)
    n, sums = len(shingles), np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        part = shingles[at : at + HASH_CHUNK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of whole texts; null and empty texts have fingerprint zero."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                made = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` near-equal blocks of bit positions."""
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def mask_levels(radius: int, deals: int) -> list[dict[int, list[int]]]:
    """For each deal, the shared masks of shards and the masks they are dealt by."""
    levels, frontier = [], [0]
    for _ in range(deals + 1):
        level = {m: [m | s for s in split_bits([b for b in range(64) if not m >> b & 1], radius + 1) if s] for m in frontier}
        levels.append(level)
        frontier = sorted({m for made in level.values() for m in made})
    return levels


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("value")) for m in masks])


def shards(nodes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, deals: int = DEALS) -> DataFrame:
    """``mask, value, fp``: every shard that a fingerprint is in.

    Any two fingerprints within ``radius`` share a shard. After the last deal a
    shard's members differ in so few bits that their number is bounded by them.
    """
    levels = mask_levels(radius, deals)
    rows = nodes.select("fp", F.explode(_dealt(F.col("fp"), levels[0][0])).alias("s")).select("s.mask", "s.value", "fp")
    for level in levels[1:]:
        rows = stage(rows, "shards")
        large = rows.groupBy("mask", "value").count().filter(F.col("count") > shard_size).select("mask", "value", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        again = F.lit(None)
        for mask, made in level.items():
            again = F.when(F.col("mask") == _signed(mask), _dealt(F.col("fp"), made)).otherwise(again)
        dealt = F.when(F.col("large"), again).otherwise(F.array(F.struct("mask", "value")))
        rows = rows.join(large, ["mask", "value"], "left").select("fp", F.explode(dealt).alias("s")).select("s.mask", "s.value", "fp")
    return rows


class BKTree:
    """Children keyed by distance to the parent; members are joined to components.

    A search follows only the edges within the radius, and no subtree whose
    members are all in the searcher's own component already, so a dense group of
    near copies costs each member a few steps.
    """

    def __init__(self, radius: int, check: Callable[[int, int], bool] | None = None) -> None:
        self.radius, self.check = radius, check  # by place, of what is within the radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.above: list[int] = []  # union-find
        self.whole: list[int] = []  # a member, if the subtree is of one component

    def component(self, node: int) -> int:
        above = self.above
        while above[node] != node:
            above[node] = above[above[node]]
            node = above[node]
        return node

    def join(self, value: int) -> list[int]:
        """Add a member; a near member of each component that it joins up."""
        values, children, whole, component = self.values, self.children, self.whole, self.component
        new, linked, todo = len(values), [], [0] if values else []
        values.append(value)
        children.append({})
        self.above.append(new)
        whole.append(new)
        while todo:
            node = todo.pop()
            if linked and whole[node] >= 0 and component(whole[node]) == component(new):
                continue
            d = (values[node] ^ value).bit_count()
            if d <= self.radius and component(node) != component(new) and (self.check is None or self.check(new, node)):
                self.above[component(new)] = component(node)
                linked.append(node)
            todo += [child for k, child in children[node].items() if abs(k - d) <= self.radius]
        node = 0
        while node != new:
            if whole[node] >= 0 and component(whole[node]) != component(new):
                whole[node] = -1
            node = children[node].setdefault((values[node] ^ value).bit_count(), new)
        return linked


def forest(members: list[int], radius: int, check: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links, by place, that join all members that chains of near ones connect."""
    tree = BKTree(radius, check)
    for k, value in enumerate(members):
        yield from ((k, near) for near in tree.join(value))


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints of ``nodes (fp)`` within the radius."""

    rows = shards(nodes, radius, shard_size)
    search = _by_shard(["mask", "value"], ["fp"], lambda fps: forest(fps.view(np.uint64).tolist(), radius))
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(search, "u long, v long")


def _by_shard(keys: list[str], columns: list[str], near: Callable[..., Iterator[tuple[int, int]]]):
    """A search of sorted rows, shard after shard, for ``u, v``.

    ``near`` gets a shard's ``columns`` and yields the places of near members; the
    first column names them.
    """

    def run(batches):
        last, held = None, [[] for _ in columns]
        for batch in batches:
            if not batch.num_rows:
                continue
            by = [batch.column(k).to_numpy() for k in keys]
            changes = np.any([k[1:] != k[:-1] for k in by], axis=0)
            bounds, links = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows], []
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                shard = tuple(int(k[lo]) for k in by)
                if shard != last:
                    links += linked(held)
                    last, held = shard, [[] for _ in columns]
                for parts, column in zip(held, own, strict=True):
                    parts.append(column[lo:hi])
            yield _links(links)
        yield _links(linked(held))

    def linked(held: list[list[np.ndarray]]) -> list[tuple[int, int]]:
        if sum(map(len, held[0])) < 2:
            return []
        members = [np.concatenate(parts) for parts in held]
        names = members[0].tolist()
        return [(names[a], names[b]) for a, b in near(*members)]

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest non-null ``doc_id`` of the group (null where
    it has none). Repeated rows stay rows of their own; other columns are not
    read; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius, shard_size))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    rooted = stage(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(groups, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- one document of each group of texts with a similarity of 0.8 or more ---------


def radius_of(similarity: float, bits: int = WIDE_BITS) -> int:
    """Bits in which two sets of one size with that Jaccard similarity may differ.

    The bits that differ are binomial, by the sets' angle; the radius is
    ``SPREADS`` standard deviations above their mean.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + SPREADS * math.sqrt(bits * share * (1 - share)))


def wide_fingerprint(text: str | None, words: int = WIDE_WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """SimHash of ``WIDE_BITS`` bits of a text's distinct shingles, the least hash of
    each of ``MINIMA`` hash functions (zeros without words), and the shingles
    themselves: their distinct hashes, sorted, of 32 bits."""
    shingles = np.unique(shingle_hashes(text, words) >> np.uint64(32))
    sums, minima = np.zeros(WIDE_BITS, np.int64), np.zeros(MINIMA, np.uint64)
    for at in range(0, len(shingles), WIDE_CHUNK):
        part = shingles[at : at + WIDE_CHUNK]
        hashes = np.stack([mix(part + np.uint64(k * GOLDEN % 2**64)) for k in range(1, MINIMA + 1)], axis=1)
        minima = hashes.min(axis=0) if at == 0 else np.minimum(minima, hashes.min(axis=0))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        sums += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(sums * 2 > len(shingles), bitorder="little").tobytes(), minima.view(np.int64), shingles.astype("<u4")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct numbers; 1 for two empty ones."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if not len(b):
        return 1.0 if not len(a) else 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def wide_fingerprints(rows: DataFrame, words: int = WIDE_WORDS) -> DataFrame:
    """``row, doc_id, text_hash, fp, minima, shingles`` of ``rows (row, doc_id, text)``."""
    given = ["row", "doc_id", "text_hash"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                made = [wide_fingerprint(t, words) for t in batch.column("text").to_pylist()]
                fps, minima, shingles = zip(*made, strict=True) if made else ((), (), ())
                new = pa.array(fps, pa.binary()), pa.array([m.tolist() for m in minima], pa.list_(pa.int64())), pa.array([x.tobytes() for x in shingles], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(batch.column, given), *new], [*given, "fp", "minima", "shingles"])

    text = F.col("text").cast("string")
    sent = bounded_batches(rows).select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text.isNull(), text).alias("text_hash"), text.alias("text"))
    return sent.mapInArrow(run, "row long, doc_id long, text_hash long, fp binary, minima array<long>, shingles binary")


def _agreeing(which: Column) -> Column:
    """The shard of a text for a set of hash functions: those minima, hashed."""
    picked = F.filter(F.col("minima"), lambda _, k: F.getbit(which, k) == 1)
    return F.xxhash64(which, picked)


def shards_by_minima(nodes: DataFrame, shard_size: int = WIDE_SHARD, deals: int = WIDE_DEALS) -> DataFrame:
    """``mask, value, cell, node, fp``: the shards that each of ``nodes (node, fp, minima)`` is in.

    Two texts of Jaccard similarity s have one least hash in common with
    probability s, and so share one of the first shards with 1 - (1 - s) ** MINIMA.
    Members of a shard beyond ``shard_size`` are dealt again, to those of its
    members that have another minimum in common too. What is still larger after
    the last deal is searched in cells of two blocks.
    """
    ones = [1 << k for k in range(MINIMA)]
    rows = nodes.select("node", "fp", "minima", F.explode(F.array(*map(F.lit, ones))).alias("mask"))
    rows, size = rows.withColumn("value", _agreeing(F.col("mask"))), F.lit(1).cast("long")
    for deal in range(deals + 1):
        counts = rows.groupBy("mask", "value").agg(F.count("*").alias("size"))
        large = stage(counts.filter(F.col("size") > shard_size), "large-shards")
        if large.isEmpty():
            break
        rows = rows.join(large, ["mask", "value"], "left")
        if deal == deals:
            size = F.coalesce(F.col("size"), F.lit(1))
            break
        again = F.filter(F.transform(F.array(*map(F.lit, ones)), lambda m: m.bitwiseOR(F.col("mask"))), lambda m: m != F.col("mask"))
        dealt = F.when(F.col("size").isNotNull(), again).otherwise(F.array("mask"))
        rows = rows.select("node", "fp", "minima", F.explode(dealt).alias("mask"))
        rows = stage(rows.withColumn("value", _agreeing(F.col("mask"))).distinct(), "dealt-shards")
    return rows.select("mask", "value", F.explode(_cells(size / shard_size)).alias("cell"), "node", "fp")


def _cells(share: Column) -> Column:
    """The cells that a member of a group goes to; ``share`` is the group's size in tasks.

    A group of one task or less is one cell. A larger one is cut into blocks of
    half a task, by hash of the fingerprint, and a cell is two of them: a member
    is in one cell with each other block, and any two members share one.
    """
    blocks = F.when(share > 1, F.ceil(share * 2)).otherwise(1).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: other != own)
    cells = F.transform(others, lambda other: F.least(own, other) * blocks + F.greatest(own, other))
    return F.when(blocks > 1, cells).otherwise(F.array(F.lit(0).cast("long")))


def candidates(nodes: DataFrame, radius: int, shard_size: int = WIDE_SHARD, deals: int = WIDE_DEALS) -> DataFrame:
    """Links ``u, v`` of ``nodes (node, fp, minima)`` whose fingerprints are within the radius."""
    keys, columns = ["mask", "value", "cell"], ["node", "fp"]
    search = _by_shard(keys, columns, lambda _, fps: forest(_wide(fps), radius))
    rows = shards_by_minima(nodes, shard_size, deals)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(search, "u long, v long")


def _wide(fps: np.ndarray) -> list[int]:
    return [int.from_bytes(fp, "little") for fp in fps]


def similar_links(nodes: DataFrame, shingles: DataFrame, similarity: float, shard_size: int = WIDE_SHARD, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Links ``u, v`` of texts that are similar, which joins up all chains of them.

    ``nodes`` has ``node, fp, minima, row``, ``shingles`` the sets by ``row``.
    Chains of candidates are the groups; in each group a BK-tree finds near
    fingerprints again and the sets decide. A group of more than ``shard_size``
    members or ``cell_bytes`` of shingles is searched in cells of two blocks.
    """
    radius = radius_of(similarity)
    roots = stage(components(candidates(nodes, radius, shard_size)), "candidate-groups")
    ends = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    chained = nodes.select("node", "fp", "row").join(ends, "node")
    members = stage(chained.join(shingles.select("row", F.octet_length("shingles").alias("bytes")), "row"), "candidate-members")
    share = F.greatest(F.count("*") / shard_size, F.sum("bytes") / cell_bytes)
    sizes = members.groupBy("root").agg(share.alias("share"))
    dealt = members.join(sizes, "root").select("root", F.explode(_cells(F.col("share"))).alias("cell"), "fp", "node", "row")
    own = shingles.join(members.select("row"), "row", "left_semi")  # row numbers alone are few enough to broadcast for longer
    rows = own.join(dealt, "row").select("root", "cell", "node", "fp", "shingles")

    def near(_, fps, packed):
        sets = [np.frombuffer(p, "<u4") for p in packed]
        return forest(_wide(fps), radius, lambda a, b: jaccard(sets[a], sets[b]) >= similarity)

    keys, columns = ["root", "cell"], ["node", "fp", "shingles"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_by_shard(keys, columns, near), "u long, v long")


def representatives(docs: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY, shard_size: int = WIDE_SHARD, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row of ``docs``, all columns, for each group of near copies: one with its smallest id.

    Rows of a group that share that id, or a group without ids, are decided by
    the hash of the text and then by their place in the table. Texts without
    words are one group; repeated rows are copies; rows of one id, or of none,
    with different texts are judged by their texts. Whole texts count, however
    long. Columns may have any names; an empty table stays empty.
    """
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = stage(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "rows")
    prints = stage(wide_fingerprints(rows.select("row", doc_id.alias("doc_id"), text.alias("text")), words), "wide-fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    nodes = prints.groupBy("fp").agg(F.first("minima").alias("minima"), F.min(first).alias("least"))
    nodes = stage(nodes.withColumns({"node": F.monotonically_increasing_id(), "row": F.col("least.row")}), "nodes")
    roots = components(similar_links(nodes, prints.select("row", "shingles"), similarity, shard_size, cell_bytes))
    rooted = nodes.select("node", "least").join(roots, "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    dropped = stage(prints.select("row").join(kept, "row", "left_anti"), "dropped")
    return rows.join(dropped, "row", "left_anti").select(*own).toDF(*docs.columns)
