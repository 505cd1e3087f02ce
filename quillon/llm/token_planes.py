"""Token-id files: bit- or byte-plane shuffled blocks behind a chunk index.

A shard file holds the ids of a range of documents in ascending ``doc_id``.
Blocks of a fixed number of ids are transposed into planes (4 byte planes or 32
bit planes), each compressed with zstandard, so that the near-empty high planes
cost almost nothing. An index at the end gives the place, size and checksum of
every block, and a document table the bounds of every document; a reader fetches
only the blocks that it needs.

Layout: magic, blocks, document table, index, then a fixed footer. Every attempt
at a task writes a file of its own name and nothing is renamed or written over;
the manifest names the files of the attempts that counted, and what lost
executors left behind is deleted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.encoding import encoder
from quillon.plans.staging import bounded_batches, shared_path

MAGIC = b"QPLANES1"
FOOTER = struct.Struct("<QQQQQBB6s8s")  # docs at, index at, blocks, documents, ids, planes, unused, pad, magic
BLOCK_IDS = 1 << 16
LEVEL = 3
BATCH_DOCS = 500
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class ShardWriter:
    """Appends documents to one file; holds a block and the document table."""

    def __init__(self, out, planes: int, block_ids: int, level: int) -> None:
        self.out, self.planes, self.block_ids = out, planes, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.docs, self.held, self.n_held, self.n_ids = 0, [], [], [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, at = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32), 0
        while len(ids) - at >= self.block_ids or last and at < len(ids):
            block = ids[at : at + self.block_ids]
            packed = [self.zip.compress(p) for p in to_planes(block, self.planes)]
            crc = zlib.crc32(np.ascontiguousarray(block, "<u4").tobytes())
            self.index.append(np.array([self.at, len(block), crc, *map(len, packed)], "<u8"))
            for data in packed:
                self._put(data)
            at += len(block)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        table = np.zeros((len(self.docs), 3), "<i8")
        table[:, 0] = [d or 0 for d, _ in self.docs]
        table[:, 1] = [d is None for d, _ in self.docs]
        table[:, 2] = [n for _, n in self.docs]
        table[:, 0] = np.diff(table[:, 0], prepend=0)
        self._put(self.zip.compress(np.ascontiguousarray(table.T).tobytes()))
        index_at = self.at
        self._put(self.zip.compress(np.array(self.index, "<u8").tobytes()))
        self._put(FOOTER.pack(docs_at, index_at, len(self.index), len(self.docs), self.n_ids, self.planes, 0, b"", MAGIC))


class ShardReader:
    """Random access to one file by document."""

    def __init__(self, source) -> None:
        self.source, size, self.unzip = source, source.size(), zstandard.ZstdDecompressor()
        *places, planes, _, _, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token-plane file")
        docs_at, index_at, blocks, docs, self.n_ids = places
        self.planes = planes
        table = np.frombuffer(self.unzip.decompress(self._get(docs_at, index_at - docs_at)), "<i8").reshape(3, docs)
        self.doc_ids, self.is_null, self.lengths = np.cumsum(table[0]), table[1].astype(bool), table[2]
        raw = self.unzip.decompress(self._get(index_at, size - FOOTER.size - index_at))
        self.index = np.frombuffer(raw, "<u8").reshape(blocks, 3 + planes).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.index[:, 1])])
        self._block: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        if self._block[0] != k:
            at, n, crc, *sizes = self.index[k].tolist()
            data, parts, pos = self._get(at, sum(sizes)), [], 0
            for size in sizes:
                parts.append(self.unzip.decompress(data[pos : pos + size]))
                pos += size
            ids = from_planes(parts, n)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block {k} is damaged")
            self._block = (k, ids)
        return self._block[1]

    def slice(self, start: int, stop: int) -> np.ndarray:
        parts, k = [np.zeros(0, np.uint32)], int(np.searchsorted(self.bounds, start, side="right")) - 1
        while start < stop:
            end = min(stop, int(self.bounds[k + 1]))
            parts.append(self.block(k)[start - self.bounds[k] : end - self.bounds[k]])
            start, k = end, k + 1
        return np.concatenate(parts)

    def documents(self):
        """(doc_id, place in the shard, ids) in the order of the file."""
        start = 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.is_null.tolist(), self.lengths.tolist(), strict=True):
            yield None if null else doc, start, self.slice(start, start + n)
            start += n


@dataclass(frozen=True)
class Shard:
    path: str
    documents: int
    start: int
    ids: int
    bytes: int


def write_planes(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    out_dir: str | None = None,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    level: int = LEVEL,
) -> list[Shard]:
    """Encode whole texts (null: empty), append ``end_id`` and write shard files.

    The rows are range-partitioned by ``doc_id`` before they are encoded, so each
    task writes one file and the files in order hold ascending ids (null ids
    first). Equal ids are ordered by the text's hash and then by row, so that
    ranges part an id that many rows have. Texts are encoded whole, however long;
    repeated rows stay; columns with other names are not read. The manifest has a
    row per file. An empty table writes none.
    """
    spark = docs.sparkSession
    out_dir, kinds, run = (out_dir or shared_path(spark, "token-planes")).rstrip("/"), PLANES[planes], uuid.uuid4().hex[:12]

    def write(batches):
        part, enc, writer, name = TaskContext.get().partitionId(), encoder(tokenizer_path), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                if writer is None:
                    fs, root = pafs.FileSystem.from_uri(out_dir)
                    fs.create_dir(root, recursive=True)
                    name = f"{run}-{part:06d}-{uuid.uuid4().hex[:12]}.qpl"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(sink, kinds, block_ids, level)
                flat, counts = enc.encode(batch.column("text").to_pylist())
                pos = 0
                for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    writer.add(doc, np.append(flat[pos : pos + n], np.uint32(end_id)))
                    pos += n
        if writer is not None:
            writer.close()
            sink.close()
            row = [[part], [f"{out_dir}/{name}"], [len(writer.docs)], [writer.n_ids], [writer.at]]
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in row], ["part", "path", "documents", "ids", "bytes"])

    text = F.col("text").cast("string")
    columns = bounded_batches(docs).select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    ordered = columns.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = ordered.mapInArrow(write, "part long, path string, documents long, ids long, bytes long").collect()
    shards, start = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        shards.append(Shard(r.path, r.documents, start, r.ids, r.bytes))
        start += r.ids
    _drop_strays(spark, out_dir, run, {s.path.rsplit("/", 1)[1] for s in shards})
    return shards


def _drop_strays(spark: SparkSession, out_dir: str, run: str, counted: set[str]) -> None:
    """Delete the files of this run whose attempt did not count."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(jpath) if counted else []:
        name = status.getPath().getName()
        if name.startswith(run) and name not in counted:
            fs.delete(status.getPath(), False)


def read_planes(spark: SparkSession, shards: list[Shard], with_ids: bool = False) -> DataFrame:
    """Documents read back: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``)."""

    def read(batches):
        for todo in batches:
            for path, base in zip(todo.column("path").to_pylist(), todo.column("start").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    rows = []
                    for doc, start, ids in ShardReader(source).documents():
                        own = (doc, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
                        rows.append(own + ((ids.tolist(),) if with_ids else ()))
                        if len(rows) == 10 * BATCH_DOCS:
                            yield _rows(rows, with_ids)
                            rows = []
                    if rows:
                        yield _rows(rows, with_ids)

    todo = spark.createDataFrame([(s.path, s.start) for s in shards], "path string, start long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return todo.repartition(max(1, len(shards))).mapInArrow(read, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
