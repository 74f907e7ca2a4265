"""Token ids in fixed-width bit packing.

A table of *segments* is written: each holds whole documents, at least ``SEGMENT_IDS`` ids where
there are so many, as one self-contained binary value (little-endian throughout)::

    magic "TPK1" | u8 bits | u32 ids a block | u64 ids | u64 documents
    per document: i64 doc_id (null: flag below), u8 null flag, u64 end of its ids in the segment
    per block, and once more for the end: u64 byte offset from the first block
    blocks: ids of ``bits`` bits, lowest bit first, each block from a new byte

``bits`` is the least number that holds the vocabulary. Spark's own writer and committer place the segments, so the files
can be in any store that Spark writes to, and a lost executor costs the tasks that it ran.

Random access goes in three steps, none of which reads the rest: the shards' sizes (columns without ids) tell which places of
which shard are asked for; ``ids_before`` and ``ids_after`` are pushed into the scan, which skips row groups and pages by their
bounds; in a segment only the blocks that hold the range are unpacked, at their offsets (:func:`read_ids`). Values are written
uncompressed (packed ids hardly shrink), so a segment's bytes stand in its file as they are.

Null text counts as empty (the end id alone); repeated rows are kept, ordered by doc_id, then by
their text; null doc_ids come first; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, text_of, tidy
from .tokens import encoder

SEGMENT_IDS = 1 << 16
BLOCK_IDS = 1 << 12
_HEAD = struct.Struct("<4sBIQQ")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u8")])
SEGMENT_SCHEMA = "shard int, segment int, ids_before long, ids_after long, n_ids long, first_id long, first_hash long, data binary"


def id_bits(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    rows = np.zeros((n, 32), dtype=np.uint8)
    rows[:, :bits] = flat
    return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_segment(docs: list[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK_IDS) -> bytes:
    index = np.zeros(len(docs), dtype=_DOC)
    for i, (doc_id, _) in enumerate(docs):
        index[i]["doc_id"], index[i]["null"] = doc_id or 0, doc_id is None
    index["end"] = np.cumsum([len(a) for _, a in docs])
    ids = np.concatenate([a for _, a in docs]) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([_HEAD.pack(b"TPK1", bits, block, len(ids), len(docs)), index.tobytes(), offsets.tobytes(), *blocks])


def read_index(data: bytes) -> tuple[np.ndarray, int]:
    """Documents of a segment, and where its block offsets begin."""
    magic, _, _, _, n_docs = _HEAD.unpack_from(data)
    if magic != b"TPK1":
        raise ValueError("not a segment of packed ids")
    return np.frombuffer(data, _DOC, n_docs, _HEAD.size), _HEAD.size + n_docs * _DOC.itemsize


def read_ids(data: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids start to end of a segment; only the blocks that hold them are unpacked."""
    _, bits, block, n_ids, _ = _HEAD.unpack_from(data)
    end = n_ids if end is None else min(end, n_ids)
    if start >= end:
        return np.zeros(0, np.uint32)
    _, at = read_index(data)
    offsets = np.frombuffer(data, "<u8", -(-n_ids // block) + 1, at)
    at += offsets.nbytes
    first, last = start // block, (end - 1) // block
    view = memoryview(data)
    parts = [unpack(view[at + int(offsets[b]) : at + int(offsets[b + 1])], min(block, n_ids - b * block), bits) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : end - first * block]


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes docs (doc_id, text) and writes the segments in ascending doc_id order below path."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        bits = id_bits(max(enc.size, end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        count, first = 0, (None, None)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "ids_before": pa.array([before], pa.int64()), "ids_after": pa.array([before + count], pa.int64()), "n_ids": pa.array([count], pa.int64()), "first_id": pa.array([first[0]], pa.int64()), "first_hash": pa.array([first[1]], pa.int64()), "data": pa.array([write_segment(held, bits)], pa.binary())})

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, ids in zip(keys, enc.ids(batch.column(2).to_pylist()), strict=True):
                if not held:
                    first = key
                held.append((key[0], np.frombuffer(ids + end, dtype="<u4")))
                count += len(held[-1][1])
                if count >= segment_ids:
                    yield row()
                    number, before, count, held = number + 1, before + count, 0, []
        if held:
            yield row()
        enc.release()

    text = text_of()
    ordered = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    with tidy(docs.sparkSession):
        ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def shard_bases(stored: DataFrame) -> DataFrame:
    """shard, base (ids of the shards before it), n: a row for each partition of the writing job, so a small table; no ids are read."""
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min(F.struct("first_id", "first_hash")).alias("first"))
    before = Window.orderBy("first", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """at, ids (little-endian unsigned 32-bit): the ids at places start to end of all, a row for each segment that has some."""
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    asked = [(r.shard, start - r.base, end - r.base, r.base) for r in shard_bases(stored).filter((F.col("base") < end) & (F.col("base") + F.col("n") > start)).collect()]
    wanted, base = F.lit(False), F.lit(None).cast("long")
    for shard, lo, hi, b in asked:
        wanted = wanted | ((F.col("shard") == shard) & (F.col("ids_before") < hi) & (F.col("ids_after") > lo))
        base = F.when(F.col("shard") == shard, F.lit(b)).otherwise(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = read_ids(data.as_buffer(), max(0, start - first), end - first)
                yield pa.RecordBatch.from_pydict({"at": pa.array([max(start, first)], pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    return stored.filter(wanted).select((base + F.col("ids_before")).alias("first"), "data").mapInArrow(cut, "at long, ids binary")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    base = shard_bases(stored).drop("n")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                index, _ = read_index(data)
                ids = read_ids(data).astype("<u4", copy=False)
                ends = index["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(index["doc_id"].copy(), pa.int64(), mask=index["null"].astype(bool)), "start": pa.array(start + starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return (
        stored.join(F.broadcast(base), "shard")
        .select((F.col("base") + F.col("ids_before")).alias("start"), "data")
        .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs to the shared folder and gives what is read back from the files."""
    path = scratch_path(docs.sparkSession, "packed")
    write_packed(docs, path, tokenizer, end_id)
    return read_packed(docs.sparkSession, path)
