"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles. The
sketch of a union is the k smallest of the sketches' hashes, so sketches of parts
merge in any order and grouping. Two sketches estimate resemblance (the share of
the union's smallest hashes that both have), containment and distinct counts; a
text of at most k shingles is held exactly.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.staging import bounded_batches

K = 128
SHINGLE_WORDS = 5
BATCH_DOCS = 200
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
FLUSH_SKETCHES = 2000

# Odd multipliers for the places in a shingle, from powers of the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15
_EMPTY = np.zeros(0, np.uint64)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of ``words`` words (A-Z lowered, parted by ASCII space).

    A text of fewer words is one shingle, one without words none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return _EMPTY
    own = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(0)), np.uint64, len(found))
    width = min(words, len(found))
    sums = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        sums += own[k : len(found) - width + 1 + k] * np.uint64(pow(GOLDEN, k + 1, 1 << 64) | 1)
    return mix(sums)


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 8 * k:  # sort only what can matter, and all of it if repeats are many
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, words: int = SHINGLE_WORDS) -> np.ndarray:
    return bottom_k(shingle_hashes(text, words), k)


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else _EMPTY


def distinct(one: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(one)) if len(one) < k else (k - 1) / (float(one[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard resemblance; 1 for two empty sketches."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k=k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k=k), k) / distinct(a, k))


def encode(one: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(one, "<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketch_documents(docs: DataFrame, k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, distinct_shingles`` for every row; null text is empty."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                made = [sketch(t, k, words) for t in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array([encode(s) for s in made], pa.string()), pa.array([distinct(s, k) for s in made], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "distinct_shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merge_by(sketches: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch for each value of ``key``, of a table with ``fingerprint``.

    Each task merges what it reads before the shuffle, so a group meets as a few
    sketches from each task, however many rows it has.
    """

    def part(batches):
        held: dict = {}
        for batch in batches:
            for value, text in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                own = decode(text or "")
                held[value] = merge(held[value], own, k=k) if value in held else own
            if len(held) > FLUSH_SKETCHES:
                yield _keyed(held)
                held = {}
        yield _keyed(held)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = merge(*map(decode, pdf["fingerprint"]), k=k)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "fingerprint": [encode(whole)], "distinct_shingles": [distinct(whole, k)]})

    rows = sketches.select(F.col(key).cast("string").alias("key"), "fingerprint").mapInArrow(part, "key string, fingerprint string")
    merged = rows.groupBy("key").applyInPandas(final, "key string, fingerprint string, distinct_shingles double")
    return merged.withColumnRenamed("key", key)


def _keyed(held: dict) -> pa.RecordBatch:
    texts = [encode(s) for s in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], ["key", "fingerprint"])


# --- documents beside an edited copy of themselves -------------------------------


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of ``following``'s first."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _parts(rows: DataFrame) -> int:
    """Tasks of about ``PART_BYTES`` of text, and enough for all cores; beyond
    ``MOST_PARTS`` they grow, which costs a task time but no memory."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    return max(min(-(-total // PART_BYTES), MOST_PARTS), 2 * rows.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Ranges:
    """Consecutive ranges of the order (id, text hash); a null id is the least.

    ``ids`` and ``hashes`` are the first keys of the ranges, one row for each.
    """

    ids: np.ndarray
    hashes: np.ndarray

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        at = hi - 1
        inside = np.flatnonzero(hi > lo)  # ids that ranges begin with
        for start in np.unique(lo[inside]).tolist():
            own = inside[lo[inside] == start]
            at[own] = start - 1 + np.searchsorted(self.hashes[start : hi[own[0]]], hashes[own], side="right")
        return np.maximum(at, 0)


def _ranges(keys: DataFrame, parts: int) -> Ranges:
    """Ranges of near-equal numbers of rows: the first key of each part of a
    range partitioning of ids and hashes alone."""
    sorted_keys = keys.repartitionByRange(parts, "id", "hash").select(F.spark_partition_id().alias("part"), F.struct("id", "hash").alias("key"))
    firsts = sorted(tuple(r.first) for r in sorted_keys.groupBy("part").agg(F.min("key").alias("first")).collect())
    return Ranges(np.array([i for i, _ in firsts], np.int64), np.array([h for _, h in firsts], np.int64))


def _targets(ranges: Ranges):
    """The part that a row is in and, for the first of a range, the one before it:
    twice its number, and one more for what only follows there."""
    first = set(zip(ranges.ids.tolist(), ranges.hashes.tolist(), strict=True))

    @F.pandas_udf("array<int>")
    def to(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = ranges.of(ids.to_numpy("int64"), hashes.to_numpy("int64"))
        return pd.Series([
            [2 * a, 2 * ((a - 1) % len(ranges.ids)) + 1] if (i, h) in first else [2 * a] for i, h, a in zip(ids, hashes, at.tolist(), strict=True)
        ])

    return to


EDITED_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def beside_edited(docs: DataFrame, k: int = K, words: int = SHINGLE_WORDS, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The next document is the one after in ascending ``doc_id`` (null ids first,
    equal ids by hash of the text), after the last the first. Texts move once, to
    ranges of that order whose number follows from the bytes of the texts; the
    first document of a range also goes to the range before, so that each task
    sees its own documents and the one that follows them. Null texts are empty,
    texts of any length whole; repeated rows stay; other columns are not read; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    least = F.coalesce(doc_id, F.lit(-(2**63)))
    rows = bounded_batches(docs).select(doc_id.alias("doc_id"), text.alias("text"), least.alias("id"), F.xxhash64(text).alias("hash"))
    parts = parts or _parts(rows)
    ranges = _ranges(rows.select("id", "hash"), parts)
    dealt = rows.withColumn("to", F.explode(_targets(ranges)("id", "hash")))
    dealt = dealt.withColumns({"part": F.expr("to div 2").cast("int"), "after": F.col("to") % 2})
    dealt = dealt.repartitionById(max(1, len(ranges.ids)), "part").sortWithinPartitions("after", "id", "hash").select("after", "doc_id", "text")

    def run(batches):
        pending, rows = None, []  # the row whose follower is not seen yet
        for whole in batches:
            columns = (whole.column(c).to_pylist() for c in ("after", "doc_id", "text"))
            for after, doc, text in zip(*columns, strict=True):
                if after and pending is None:
                    continue  # a tie of the first follower
                own = sketch(text, k, words)
                if pending is not None:
                    rows.append(compare(pending, text, own))
                pending = None if after else (doc, text, own)
                if len(rows) >= BATCH_DOCS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    def compare(one, following, its_sketch):
        doc, text, own = one
        new = edited(text, following)
        other = sketch(new, k, words)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), digest, encode(own), encode(other), resemblance(own, other, k), resemblance(own, its_sketch, k)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [part.split()[0] for part in EDITED_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, EDITED_SCHEMA)
