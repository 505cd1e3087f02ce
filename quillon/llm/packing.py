"""Best-fit packing of token pieces into fixed-length sequences.

Method: minimum bin slack. For each bin a subset-sum dynamic program over the
lengths that are still available, held as the bits of one integer, finds the
fullest feasible combination; those pieces are removed and the next bin begins.

Only the histogram of lengths is planned on the driver: it has at most
``capacity`` entries however large the corpus is, and a combination is applied
as often as its scarcest length allows, which is what filling bin after bin
would do. Each application uses up a length, so there are at most ``capacity``
patterns of at most ``sqrt(2 * capacity)`` distinct lengths: the plan that is
broadcast has a proven size bound (15 MB at 4,096).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.encoding import encoder
from quillon.plans.staging import bounded_batches, stage

CAPACITY = 4096
END_ID = 1
BATCH_DOCS = 500
RANK_BITS = 44  # of a piece's rank among equal lengths

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


@dataclass(frozen=True)
class PackPlan:
    """Where the pieces of a length go, by their rank among equal lengths.

    Row i serves ranks ``lo[i]`` on of ``length[i]``, ``per_bin[i]`` to each of
    the bins from ``first_bin[i]``, at ``offset[i]`` in them.
    """

    length: np.ndarray
    lo: np.ndarray
    per_bin: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    bins: int


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Multiset of ``lengths`` (descending) with the largest sum of at most ``room``."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, part = min(counts[length], room // length) if length <= room else 0, 1
        while left:
            take = min(part, left)
            grown = (reach | reach << (length * take)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    rest, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + take
            rest -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> PackPlan:
    """Minimum-bin-slack plan for a histogram of lengths of 1 to ``capacity``."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("piece lengths must be 1 to the capacity")
    lengths, used, rows, bins = sorted(counts, reverse=True), dict.fromkeys(counts, 0), [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        chosen = fullest(counts, lengths, capacity - top)
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(counts[n] // m for n, m in chosen.items())
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used[n], chosen[n], bins, offset))
            offset += n * chosen[n]
            used[n] += chosen[n] * times
            counts[n] -= chosen[n] * times
        bins += times
        lengths = [n for n in lengths if counts[n]]
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return PackPlan(*(table[:, k] for k in range(5)), bins)


def place(plan: PackPlan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, by length and rank among equal lengths."""
    at = np.searchsorted((plan.length << RANK_BITS) + plan.lo, (length << RANK_BITS) + rank, side="right") - 1
    behind = rank - plan.lo[at]
    per = plan.per_bin[at]
    return plan.first_bin[at] + behind // per, plan.offset[at] + behind % per * length


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document's ids with the end id.

    Null texts are empty (one piece, the end id alone). Rows carry the task and
    the rank among the task's pieces of equal length, from which ranks over the
    whole corpus follow without gathering a length in one task.
    """

    def cut(batches):
        enc, part, ranks = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                flat, counts = enc.encode(batch.column("text").to_pylist())
                out, ids, pos = [], [], 0
                for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    own = np.append(flat[pos : pos + n], np.uint32(end_id)).astype("<u4")
                    pos += n
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part_ids = own[start : start + capacity]
                        out.append((doc, k, start, len(part_ids), zlib.crc32(part_ids.tobytes()), part, int(ranks[len(part_ids)])))
                        ranks[len(part_ids)] += 1
                        if keep_ids:
                            ids.append(part_ids)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                if keep_ids:
                    columns.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a staged table of ``pieces``).

    An empty table packs into no sequence. Repeated rows are pieces of their own.
    """
    spark = cut.sparkSession
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    histogram = {r.length: r.pieces for r in by_task.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    kept = [c for c in cut.columns if c not in ("part", "local_rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                seq, offset = place(plan.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                columns = [batch.column(c) for c in kept] + [pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(put, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Encode, cut and pack whole documents; the encoding runs once and is staged.

    Null and empty texts are one piece, the end id; texts of any length are cut
    into pieces, none of which is dropped; repeated rows are packed each; null ids
    stay null; columns other than ``doc_id`` and ``text`` are not read, whatever
    their names; an empty table gives no rows.
    """
    return pack(stage(pieces(docs, tokenizer_path, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids`` from pieces with ids.

    A sequence has at most ``capacity`` ids, so gathering one is bounded; no
    pieces give no sequences.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return rows.select("sequence_id", F.size(ids).alias("length"), ids.alias("ids"))
