"""Vector bin packing of examples into training sequences.

Each piece of an example is a vector (tokens, segments, loss-bearing tokens); a sequence has a
capacity in each. A sequence is filled by the dot-product heuristic: of the pieces that still fit,
the one with the largest dot product of its vector (over the capacities) and what is left (over the
capacities, squared weight of scarce dimensions) goes in next. Pieces of equal vectors form a class,
so a step looks at classes, not at pieces, and takes as many pieces of a class as it stays the best one. When
none fits and there is room, the piece of the best class is cut to the room; its rest stays in the pool.

Tasks pack their own partition, with no shuffle. A pool holds ``POOL_TOKENS`` tokens at most; beyond that the
task closes sequences, so memory doesn't grow with the partition (nothing is dropped). Only the last sequence of a task
has padding, unless segments or loss-bearing tokens run out first. A very long text is one document: its ids
(4 bytes each) are held once, its pieces are places in them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, text_of, written
from .tokens import encoder

POOL_TOKENS = 4_000_000
#: Sequence ids: the task's number times this, and the sequence's number in the task.
TASK_IDS = 1 << 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Pool:
    """Pieces waiting for a sequence: (tokens, loss-bearing tokens) -> list of payloads."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.cap = np.array([tokens, segments, loss], dtype=np.float64)
        self.waiting: dict[tuple[int, int], list] = defaultdict(list)
        self.vectors = np.zeros((0, 3))
        self.keys: list[tuple[int, int]] = []
        self.live = np.zeros(0, dtype=bool)
        self.place: dict[tuple[int, int], int] = {}
        self.tokens = 0

    def add(self, tokens: int, loss: int, payload: object) -> None:
        key = (tokens, loss)
        if key not in self.place:
            self.place[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) > len(self.vectors):
                more = max(256, len(self.vectors))
                self.vectors = np.vstack([self.vectors, np.zeros((more, 3))])
                self.live = np.concatenate([self.live, np.zeros(more, dtype=bool)])
            self.vectors[self.place[key]] = (tokens, 1, loss)
        self.live[self.place[key]] = True
        self.waiting[key].append(payload)
        self.tokens += tokens

    def take(self, i: int) -> object:
        key = self.keys[i]
        payload = self.waiting[key].pop()
        self.tokens -= key[0]
        if not self.waiting[key]:
            self.live[i] = False
        return payload

    def times(self, i: int, left: np.ndarray) -> int:
        """How many pieces of class i go in, one after another, before another class is better, or it doesn't fit or is used up."""
        n, own = len(self.keys), self.vectors[i]
        most = min(len(self.waiting[self.keys[i]]), *(int(a // b) for a, b in zip(left, own, strict=True) if b > 0))
        if most < 2:
            return most
        ahead = (own - self.vectors[:n][self.live[:n]]) / (self.cap * self.cap)
        lead, loss = ahead @ left, ahead @ own  # another class catches up where lead - t * loss turns negative
        falling = loss > 0
        return max(1, min(most, int((lead[falling] / loss[falling]).min(initial=most))))

    def best(self, left: np.ndarray, whole: bool) -> int:
        """The class with the largest dot product; those that fit, or (not whole) any."""
        n = len(self.keys)
        ok = self.live[:n]
        if whole:
            ok = ok & (self.vectors[:n] <= left).all(axis=1)
        score = self.vectors[:n] @ (left / (self.cap * self.cap))
        score[~ok] = -1
        i = int(score.argmax()) if n else -1
        return i if i >= 0 and score[i] > 0 else -1

    def sequence(self, cut) -> list:
        """Fills one sequence. cut(payload, tokens) gives ((loss, payload), (tokens, loss, payload)): its first tokens, and the rest."""
        left, out = self.cap.copy(), []
        while left[0] >= 1 and left[1] >= 1:
            i = self.best(left, True)
            if i >= 0:
                n = self.times(i, left)
                out += [(self.keys[i][0], self.take(i)) for _ in range(n)]
                left -= n * self.vectors[i]
                continue
            i = self.best(left, False)
            room = int(min(left[0], left[2])) if i >= 0 else 0
            if room < 1 or self.keys[i][0] <= room:
                break
            (loss, head), rest = cut(self.take(i), room)
            out.append((room, head))
            left -= (room, 1, loss)
            self.add(*rest)
        return out


def pack_rows(rows: Iterator[tuple[int | None, np.ndarray, np.ndarray | None]], tokens: int, segments: int, loss: int, first: int) -> Iterator[tuple]:
    """rows: (id, token ids, loss mask or None if all bear loss). Yields rows of PIECES."""
    pool, number = Pool(tokens, segments, loss), first

    def weigh(mask: np.ndarray | None, start: int, n: int) -> int:
        return n if mask is None else int(mask[start : start + n].sum())

    def cut(payload, n: int):
        doc, ids, mask, start, length, total = payload
        a, b = weigh(mask, start, n), weigh(mask, start + n, length - n)
        return (a, (doc, ids, mask, start, n, total)), (length - n, b, (doc, ids, mask, start + n, length - n, total))

    def close() -> Iterator[tuple]:
        nonlocal number
        at = 0
        for n, (doc, ids, mask, start, length, total) in pool.sequence(cut):
            yield doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), total, number, at, weigh(mask, start, n)
            at += n
        number += 1

    most = min(tokens, loss)
    for doc, ids, mask in rows:
        total = len(ids)
        for start in range(0, total, most):
            n = min(most, total - start)
            pool.add(n, weigh(mask, start, n), (doc, ids, mask, start, n, total))
        if pool.tokens > POOL_TOKENS:
            while pool.tokens > POOL_TOKENS // 2:
                yield from close()
    while pool.tokens:
        yield from close()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, segments: int | None = None, loss: int | None = None) -> DataFrame:
    """Packs docs (doc_id, text) into sequences; a row for each piece (columns: PIECES).

    Every id of a document, its end id included, is in exactly one piece. Null text is empty and
    gives a piece with the end id alone; repeated rows are packed as often as they come; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored; a text of any length is packed whole. In plain text
    every token bears loss, so the loss capacity is the token capacity unless it is given; ``segments``: pieces a sequence, if
    there is a limit.
    """

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist()), strict=True):
                    yield doc, np.frombuffer(ids + end, dtype="<u4"), None

        yield from _rows_to_batches(pack_rows(rows(), tokens, segments or tokens, loss or tokens, TaskContext.get().partitionId() * TASK_IDS))
        enc.release()

    return dealt(docs.select("doc_id", text_of().alias("text"))).mapInArrow(pack_batches, PIECES)


def _rows_to_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of rows of PIECES, or of PIECES behind a shard."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(row) > len(names):
            names = ["shard", *names]
        if len(held) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int, loss_role: str = "assistant", tokens: int = 2048, segments: int = 16, loss: int = 1536) -> DataFrame:
    """Packs instruction data (conv_id, turn, role, text): a conversation is one example, its turns in order, of which only
    those by ``loss_role`` bear loss. Columns as :func:`pack_documents`, with doc_id for conv_id; start and doc_tokens count
    the whole conversation's ids.

    Turns are dealt by ranges of (conv_id, turn), so a conversation of any size is spread over tasks: a task packs its run of
    the conversation, and its place in the whole follows from the sizes of the runs before it (one row for each end of a range).
    Null text is empty, a null role bears no loss, rows of null conv_id are one conversation; repeated turns are packed as often
    as they come; an empty table gives no rows; other columns are ignored.
    """

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()

        def examples() -> Iterator[tuple]:
            key, ids, masks = None, [], []
            for batch in batches:
                convs, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for conv, role, x in zip(convs, roles, enc.ids(batch.column(2).to_pylist()), strict=True):
                    if ids and key != (shard, conv):
                        yield key, np.concatenate(ids), np.concatenate(masks)
                        ids, masks = [], []
                    key = (shard, conv)
                    ids.append(np.frombuffer(x + end, dtype="<u4"))
                    masks.append(np.full(len(ids[-1]), role == loss_role))
            if ids:
                yield key, np.concatenate(ids), np.concatenate(masks)

        yield from _rows_to_batches((*key, *rest) for key, *rest in pack_rows(examples(), tokens, segments, loss, shard * TASK_IDS))
        enc.release()

    text = text_of()
    ordered = turns.select("conv_id", "role", text.alias("text"), F.col("turn").alias("_t"), F.xxhash64("role", text).alias("_h")).repartitionByRange("conv_id", "_t", "_h").sortWithinPartitions("conv_id", "_t", "_h", "role", "text")
    packed = written(ordered.select("conv_id", "role", "text").mapInArrow(pack_batches, "shard long, " + PIECES), "pieces")
    runs = packed.groupBy("shard", "doc_id").agg(F.sum("length").alias("n"))
    # only a shard's first and last conversation can go on in another: two rows a shard
    run = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "n")
    ends = runs.groupBy("shard").agg(F.min(run).alias("lo"), F.max(run).alias("hi"))
    ends = ends.select("shard", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("shard", "e.doc_id", "e.n")
    by = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("n").over(by.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("shard").alias("_s"), F.col("doc_id").alias("_c"), before.alias("_before"), F.sum("n").over(by).alias("_total"))
    # two rows a shard: small beside any executor
    whole = packed.join(F.broadcast(ends), (F.col("shard") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_c")), "left")
    whole = whole.withColumn("start", F.col("start") + F.coalesce("_before", F.lit(0))).withColumn("doc_tokens", F.coalesce("_total", "doc_tokens"))
    return whole.select(*(x.split()[0] for x in PIECES.split(", ")))
