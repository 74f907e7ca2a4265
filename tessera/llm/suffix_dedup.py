"""Repeated byte strings by a distributed difference-cover algorithm.

A byte goes if a string of ``LENGTH`` bytes over it starts anywhere else too. As in a difference-cover
suffix array, positions (counted from their document's start) are sampled where they are in a
difference cover ``COVER`` modulo ``PERIOD``: for any two positions some shift below ``PERIOD`` brings
both into the sample. Names of strings are built by recursion on triples: 3 bytes, 3 names of 3 bytes,
and so on to 81 bytes; longer strings are named by names that overlap.

1. Sampled positions are sorted by the name of a string that every ``LENGTH``-byte string over the
   next ``PERIOD`` starts holds; neighbours in that order are compared. One that has no equal rules those starts out.
2. Of the others, the name of a longer string, which holds all ``PERIOD`` starts, is sorted
   and compared: where it is repeated, all of them are repeated, by one name.
3. The remaining starts are merged in: they are sorted by the name of their ``LENGTH`` bytes, against
   themselves and one occurrence of each longer string that 2. found (its first one), and neighbours are compared.

4. With ``confirm``, neighbours of equal names are compared byte by byte: each chunk sends the bytes of its repeated strings, overlapping ones as one
   run, to the chunk that precedes it in the order of the name, which looks the names up in its own text. Should two different
   strings ever share a name, all is done again with other names; so what is removed is repeated for certain.

Only names are sorted, never whole suffixes: an order of suffixes isn't needed to find equal prefixes of a fixed length,
and it would take many times the disk. Names are 64-bit hashes, and sorted in parts of about
``PART_NAMES``; a task sends each name once, so a string that a third of all documents hold costs no
more than others. Documents are kept in chunks, in a table bucketed by chunk, so answers come
back to their text without a shuffle of it. A very long document is a chunk by itself; a task holds one chunk at a time, with about 40 bytes
for each of its bytes, and a document may have up to 2^31 bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, text_of, tidy, written

LENGTH = 200
#: A perfect difference set: each difference modulo 57 is that of one pair.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
WEAK, STRONG = LENGTH - PERIOD + 1, LENGTH + PERIOD - 1
CHUNK_BYTES = 4 << 20
PART_NAMES = 4_000_000
SLICE = 1 << 15

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finisher of splitmix64 (fixed constants), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _triple(h: np.ndarray, step: int) -> np.ndarray:
    """Names of triples of names, step apart."""
    n = len(h) - 2 * step
    out = h[:n] * _A
    out += h[step : step + n] * _B
    out += h[2 * step : 2 * step + n] * _C
    return _mix(out)


def names81(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """The name of the 81 bytes from each position (0 where fewer are left)."""
    first = np.uint64((1 + seed * 0x9E3779B97F4A7C15) % (1 << 64))
    out = np.zeros(len(data), np.uint64)
    for at in range(0, max(0, len(data) - 80), SLICE):
        h = data[at : at + SLICE + 80].astype(np.uint64)
        h += first
        for step in (1, 3, 9, 27):
            h = _triple(h, step)
        out[at : at + len(h)] = h
    return out


def joined(*names: np.ndarray) -> np.ndarray:
    out = names[0] * _A
    for k, x in enumerate(names[1:], 1):
        out = _mix(out + x * _B + np.uint64(k))
    return out


@dataclass
class Chunk:
    """Some whole documents, one after another."""

    data: bytes
    sizes: np.ndarray
    seed: int = 0

    def __post_init__(self) -> None:
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        n = len(self.data)
        self.names = names81(np.frombuffer(self.data, np.uint8), self.seed)
        self.left = np.repeat(ends.astype(np.int32), self.sizes)
        self.left -= np.arange(n, dtype=np.int32)
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        pattern = np.tile(inside, int(self.sizes.max(initial=0)) // PERIOD + 1)
        sampled = np.concatenate([pattern[:k] for k in self.sizes.tolist()]) if len(self.sizes) else pattern[:0]
        self.sample = np.flatnonzero(sampled & (self.left >= WEAK))

    def weak(self) -> np.ndarray:
        return joined(self.names[self.sample], self.names[self.sample + WEAK - 81])

    def strong(self, at: np.ndarray) -> np.ndarray:
        """Names of the STRONG bytes from at, or of those to the document's end."""
        size = np.minimum(self.left[at], STRONG)
        return joined(self.names[at], self.names[at + 81], self.names[at + np.minimum(162, size - 81)], self.names[at + size - 81], size.astype(np.uint64))

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Names of the LENGTH bytes from at."""
        return joined(self.names[at], self.names[at + 81], self.names[at + LENGTH - 81])

    def over(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many of the intervals [at, ends) each position is in."""
        n = len(self.data) + 1
        turn = np.bincount(at, minlength=n) - np.bincount(ends, minlength=n)
        return np.cumsum(turn[:-1])


@dataclass
class Names:
    """The distinct names of a chunk, as they are sent: by part, sorted."""

    names: np.ndarray
    parts: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.names)
        ordered = self.names[self.order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
        self.distinct, self.starts = ordered[starts], starts
        self.count = np.diff(starts, append=len(ordered))
        # they are sorted by the whole name and the part is taken from its high bits, so parts lie one after another
        part = ((self.distinct >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        self.edges = np.searchsorted(part, np.arange(self.parts + 1, dtype=np.uint64))

    def rows(self, short: bool) -> Iterator[tuple[int, bytes]]:
        kind = np.uint32 if short else np.uint64
        for p in range(self.parts):
            a, b = self.edges[p], self.edges[p + 1]
            if a < b:
                yield p, self.distinct[a:b].astype(kind).tobytes()

    def answers(self, got: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """For each name: whether it is repeated, and whether this is its first place of all. After it, ``before`` has the chunk that
        precedes this one in the order of each distinct name (-1: none)."""
        repeated, earliest = np.zeros(len(self.distinct), bool), np.ones(len(self.distinct), bool)
        self.before = np.full(len(self.distinct), -1, np.int64)
        for row in got or ():
            a, b = self.edges[row["part"]], self.edges[row["part"] + 1]
            bits = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=2 * (b - a)).astype(bool)
            repeated[a:b], earliest[a:b] = bits[: b - a], bits[b - a :]
            self.before[a:b][~earliest[a:b]] = np.frombuffer(row["before"], np.int64)
        repeated |= self.count > 1
        first = np.zeros(len(self.names), bool)
        if len(self.names):
            first[np.minimum.reduceat(self.order, self.starts)] = True
        which = np.empty(len(self.names), np.int64)
        which[self.order] = np.repeat(np.arange(len(self.distinct)), self.count)
        self.which = which
        return repeated[which], earliest[which] & first

    def places(self, name: np.uint64) -> np.ndarray:
        """Where in the list of names this one stands."""
        k = int(np.searchsorted(self.distinct, name))
        if k == len(self.distinct) or self.distinct[k] != name:
            return self.order[:0]
        return self.order[self.starts[k] : self.starts[k] + self.count[k]]


def compare(sent: DataFrame, short: bool) -> DataFrame:
    """chunk, got (part, flags): for rows (part, chunk, names), which names other chunks have too, and in which chunk they are first."""

    def compared(table: pa.Table) -> pa.Table:
        part, chunks = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        names = [np.frombuffer(x.as_py(), np.uint32 if short else np.uint64) for x in table.column("names")]
        sizes = [len(x) for x in names]
        together = np.concatenate(names)
        ids = np.array(chunks, np.int64)
        owner = np.repeat(np.argsort(np.argsort(ids, kind="stable"), kind="stable"), sizes)
        ids.sort()
        order = np.lexsort((owner, together))
        ordered = together[order]
        same = ordered[1:] == ordered[:-1]
        repeated, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        later[order[1:][same]] = True
        preceding = np.empty(len(order), np.int32)
        preceding[order[1:][same]] = owner[order[:-1][same]]
        flags, before, at = [], [], 0
        for n in sizes:
            flags.append(np.packbits(np.concatenate([repeated[at : at + n], ~later[at : at + n]])).tobytes())
            before.append(ids[preceding[at : at + n][later[at : at + n]]].tobytes())
            at += n
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(chunks), pa.int32()), "flags": pa.array(flags, pa.binary()), "before": pa.array(before, pa.binary())})

    found = sent.groupBy("part").applyInArrow(compared, "chunk long, part int, flags binary, before binary")
    return written(found, "answers").groupBy("chunk").agg(F.collect_list(F.struct("part", "flags", "before")).alias("got"))


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """chunk, ids, sizes, data: whole documents of about size bytes a chunk, in a table bucketed by chunk in the shared folder."""
    spark = docs.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "data": pa.array([b"".join(texts)], pa.binary())})

        for batch in batches:
            column = batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                total += len(text)
                if total >= size:
                    yield row()
                    number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield row()

    table = f"tessera_chunks_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(gather, "chunk long, ids array<bigint>, sizes array<bigint>, data binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        rows.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).option("compression", "zstd").saveAsTable(table)
    chunks = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets it; the files, in the shared folder, stay for chunks
    return chunks


def _passes(chunk: Chunk, parts: int, upto: int, got: list) -> tuple:
    """What follows from the answers so far. upto 1: weak names; 2: strong names; 3: whole names; 4: repeated starts; 5: the strong and the
    whole names with their positions, lengths and repeats."""
    one = Names(chunk.weak(), parts)
    if upto == 1:
        return (one,)
    repeated, _ = one.answers(got[0])
    maybe = chunk.sample[repeated]
    long = maybe[chunk.left[maybe] >= LENGTH]
    two = Names(chunk.strong(long), parts)
    if upto == 2:
        return (two,)
    again, first = two.answers(got[1])
    n = len(chunk.data)
    open_ = chunk.left >= LENGTH
    # starts up to PERIOD - 1 before a sampled position whose weak string is repeated
    before = np.maximum(maybe - PERIOD + 1, chunk.starts[np.searchsorted(chunk.starts, maybe, side="right") - 1] if len(maybe) else maybe)
    candidate = open_ & (chunk.over(before, maybe + 1) > 0)
    ends = np.minimum(long + PERIOD, long + chunk.left[long] - LENGTH + 1)
    known = chunk.over(long[again], ends[again]) > 0
    later = again & ~first
    copied = chunk.over(long[later], ends[later]) > 0
    at = np.flatnonzero(candidate & (~known | ~copied))
    three = Names(chunk.whole(at), parts)
    if upto == 3:
        return (three,)
    repeated, _ = three.answers(got[2])
    if upto == 5:
        return (two, long, np.minimum(chunk.left[long], STRONG), again), (three, at, np.full(len(at), LENGTH), repeated)
    starts = known.copy()
    starts[at[repeated]] = True
    return (np.flatnonzero(starts & open_), n)


CLAIM = "to long, kind int, offsets array<bigint>, sizes array<bigint>, names binary, bytes binary"


def _runs(at: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of at (in order) cut where the group changes or a string doesn't reach the next one."""
    if len(at):
        yield from np.split(np.arange(len(at)), np.flatnonzero((group[1:] != group[:-1]) | (at[1:] > ends[:-1])) + 1)


def _claims(chunk: Chunk, parts: int, got: list) -> tuple[list[tuple], bool]:
    """Rows of CLAIM: the repeated strings of a chunk that the chunk before it, in the order of their names, has too; and whether its repeats within itself
    are equal."""
    rows, data, equal = [], memoryview(chunk.data), True
    for kind, (names, at, sizes, repeated) in enumerate(_passes(chunk, parts, 5, got)):
        ends = at + sizes
        before = names.before[names.which] if len(at) else np.zeros(0, np.int64)
        # the first place of a name is sent; the others in this chunk are compared with it here
        first = np.minimum.reduceat(names.order, names.starts)[names.which] if len(at) else np.zeros(0, np.int64)
        sent = np.flatnonzero(repeated & (before >= 0) & (first == np.arange(len(at))))
        sent = sent[np.lexsort((at[sent], before[sent]))]
        for run in _runs(at[sent], ends[sent], before[sent]):
            k = sent[run]
            a, b = int(at[k[0]]), int(ends[k].max())
            rows.append((int(before[k[0]]), kind, (at[k] - a).tolist(), sizes[k].tolist(), names.names[k].tobytes(), chunk.data[a:b]))
        # within the chunk: each place but the first of a name against the first, as long as both go on together
        own = np.flatnonzero(first != np.arange(len(at)))
        for run in _runs(at[own], ends[own], at[own] - at[first[own]]):
            k = own[run]
            a, b, c = int(at[k[0]]), int(ends[k].max()), int(at[first[k[0]]])
            equal &= data[a:b] == data[c : c + b - a]
    return rows, bool(equal)


def _holds(chunk: Chunk, found: tuple, offsets: list[int], sizes: list[int], names: np.ndarray, text: bytes) -> bool:
    """Whether the chunk has each of the strings, which lie in text at offsets, at a place of their name."""
    listed, at, *_ = found
    data = memoryview(chunk.data)
    for p in at[listed.places(names[0])].tolist():
        if data[p : p + len(text)] == text:  # the whole run at once
            return True
    view = memoryview(text)
    return all(any(data[p : p + n] == view[o : o + n] for p in at[listed.places(name)].tolist()) for o, n, name in zip(offsets, sizes, names, strict=True))


def _confirmed(chunks: DataFrame, answers: list[DataFrame], parts: int, seed: int) -> bool:
    """Whether all strings of equal names are equal byte by byte, each with that before it in the order of the name."""

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, data, *got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, equal = _claims(Chunk(data, np.array(sizes, np.int64), seed), parts, got)
                rows += [] if equal else [(-1, 0, [], [], b"", b"")]
                for k in range(0, len(rows), 2000):
                    columns = list(zip(*rows[k : k + 2000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.binary())], ["to", "kind", "offsets", "sizes", "names", "bytes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = 0
            for sizes, data, claims, *got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(data, np.array(sizes, np.int64), seed)
                found = _passes(chunk, parts, 5, got)
                bad += sum(not _holds(chunk, found[c["kind"]], c["offsets"], c["sizes"], np.frombuffer(c["names"], np.uint64), c["bytes"]) for c in claims)
            yield pa.RecordBatch.from_pydict({"bad": pa.array([bad], pa.int64())})

    rows, columns = _with_answers(chunks, answers)
    claims = written(rows.select("sizes", "data", *columns).mapInArrow(claim, CLAIM), "claims")
    if claims.filter("to < 0").head(1):
        return False
    # claims are dealt in pieces of about a chunk's size, so a chunk that many others follow gets several rows
    piece = F.floor(F.sum(F.octet_length("bytes") + 64).over(Window.partitionBy("to").orderBy("kind", "names").rowsBetween(Window.unboundedPreceding, 0)) / F.lit(CHUNK_BYTES))
    grouped = claims.withColumn("piece", piece).groupBy("to", "piece").agg(F.collect_list(F.struct("kind", "offsets", "sizes", "names", "bytes")).alias("claims"))
    work = rows.join(grouped.withColumnRenamed("to", "chunk").hint("shuffle_hash"), "chunk").select("sizes", "data", "claims", *columns)
    return not (work.mapInArrow(check, "bad long").agg(F.sum("bad").alias("bad")).first().bad or 0)


def _sent(chunks: DataFrame, answers: list[DataFrame], parts: int, upto: int, seed: int) -> DataFrame:
    """part, chunk, names of a pass."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, data, *got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (names,) = _passes(Chunk(data, np.array(sizes, np.int64), seed), parts, upto, got)
                rows = list(names.rows(upto == 1))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "names": pa.array([x for _, x in rows], pa.binary())})

    rows, columns = _with_answers(chunks, answers)
    return rows.select("chunk", "sizes", "data", *columns).mapInArrow(send, "part int, chunk long, names binary")


def _with_answers(chunks: DataFrame, answers: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    columns = []
    for k, found in enumerate(answers):
        columns.append(f"got{k}")
        # on the chunk, by which the texts are bucketed: answers move, texts don't
        chunks = chunks.join(found.withColumnRenamed("got", f"got{k}").hint("shuffle_hash"), "chunk", "left")
    return chunks, columns


def repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_names: int = PART_NAMES, confirm: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans removed (begins, ends; byte offsets).

    Null text is empty; repeated rows remove each other where they are long enough; null doc_ids stay; an
    empty table gives no rows; other columns are ignored; a text of any length up to 2^31 bytes is taken whole.
    """
    chunks = chunked(docs, chunk_bytes)
    total = docs.select(F.sum(F.octet_length(text_of())).alias("n")).first().n or 0
    parts = max(1, -(-total * len(COVER) // (PERIOD * part_names)))
    seed = 0
    while True:
        answers: list[DataFrame] = []
        for upto in (1, 2, 3):
            answers.append(compare(_sent(chunks, answers, parts, upto, seed), upto == 1))
        if not confirm or _confirmed(chunks, answers, parts, seed):
            break
        seed += 1

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, data, *got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(data, np.array(sizes, np.int64), seed)
                at, _ = _passes(chunk, parts, 4, got)
                gone = (chunk.over(at, at + LENGTH) > 0).astype(np.int8)
                out: list[tuple] = []
                for doc_id, start, size in zip(ids, chunk.starts.tolist(), sizes, strict=True):
                    edge = np.flatnonzero(np.diff(gone[start : start + size], prepend=0, append=0))
                    begins, ends = edge[::2], edge[1::2]
                    kept = hashlib.sha256()
                    last = 0
                    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                        kept.update(data[start + last : start + b])
                        last = e
                    kept.update(data[start + last : start + size])
                    out.append((doc_id, size, int((ends - begins).sum()), len(begins), kept.hexdigest(), begins, ends))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string()), *(pa.array(list(c), pa.list_(pa.int64())) for c in columns[5:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"])

    rows, columns = _with_answers(chunks, answers)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<bigint>, ends array<bigint>"
    return rows.select("ids", "sizes", "data", *columns).mapInArrow(removed, schema)
