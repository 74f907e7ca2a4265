"""Hard negatives by bit-sliced integer products.

Vectors are turned to integers, and a candidate's components are kept as bit-planes in two's complement, the sign first. The product of
an anchor with the planes so far, and the sums of its negative and of its positive components times what the planes below can still
add, bound the score from both sides; each plane halves that interval. A candidate is dropped once its interval
can't qualify: for positives, below the fifth lower bound found so far; for negatives, outside of every positive's range
of scores, or below the fifth score found in it. Those that outlast the last plane have their exact scores.

Planes are taken for a whole tile of anchors and candidates while many pairs are alive (a matrix product), then for the
live pairs only.

Every row is a candidate, packed in blocks of ``BLOCK_ROWS``; anchors are the stated rows, in parts of ``PART_ROWS``. A part and a stripe of blocks
make a unit of work: its task reads the part once, then block by block, and keeps the best so far, which bound later blocks. So
a unit sends on a few rows an anchor, however many blocks it has seen. Labels are no key of any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

SCALE = 256
BLOCK_ROWS = 4096
PART_ROWS = 4096
STRIPE_BLOCKS = 16
TILE_ANCHORS = 128
POSITIVES = NEGATIVES = 5
LOW, HIGH, OF = 80, 100, 100
#: Pairs are taken one by one once fewer than this share of a tile is alive.
SPARSE = 1 / 16

_LEAST = np.iinfo(np.int64).min


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, v: the rows that take part, as integers, written to the shared folder with a number of the row.

    Null ids, labels or vectors and null or non-finite components leave a row out. A row whose id is divisible by 7 has the next label (of 10).
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding").dropna().filter(finite)
    moved = F.when(F.pmod("id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform(v, lambda x: F.floor(x * scale))
    largest = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x * scale))), F.lit(0.0))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", moved.alias("label"), scaled.alias("v"), largest.alias("largest")), "integers")


class Planes:
    """A block of candidates as bit-planes of the components, the sign first."""

    def __init__(self, row: dict, width: int, dims: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        packed = np.frombuffer(row["planes"], np.uint8).reshape(width, n, -1)
        self.bits = [np.unpackbits(p, axis=1, count=dims) for p in packed]
        self.weights = [-(1 << (width - 1)), *(1 << b for b in range(width - 2, -1, -1))]


def pack(values: np.ndarray, width: int) -> bytes:
    """Bit-planes of whole numbers in two's complement of ``width`` bits, each packed row by row."""
    unsigned = values & ((1 << width) - 1)
    return b"".join(np.packbits((unsigned >> b & 1).astype(np.uint8), axis=1).tobytes() for b in range(width - 1, -1, -1))


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; the least number where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), _LEAST)


def narrowed(anchors: np.ndarray, block: Planes, alive: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and candidate numbers of the live pairs whose score is between the anchor's floor and ceiling, and the scores.

    k: if not 0, a pair must also reach the k-th lower bound among the anchor's live pairs.
    """
    below, above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    floor = floor.copy()
    # products with bits are exact in floating point, which is far faster, as long as no sum passes 2^53
    kind = np.float64 if np.abs(anchors).sum(axis=1).max(initial=0) < 1 << 52 else np.int64
    wide = anchors.astype(kind)
    score = np.zeros(alive.shape, np.int64)
    a = c = partial = None
    for bits, weight in zip(block.bits, block.weights, strict=True):
        left = abs(weight) - 1
        if a is None:
            score += (wide @ bits.T.astype(kind)).astype(np.int64) * weight
            low, high = score + (below * left)[:, None], score + (above * left)[:, None]
            if k:
                floor = np.maximum(floor, _kth(np.where(alive, low, _LEAST), k))
            alive &= (high >= floor[:, None]) & (low <= ceiling[:, None])
            if np.count_nonzero(alive) <= SPARSE * alive.size:
                a, c = np.nonzero(alive)
                partial = score[a, c]
        else:
            partial = partial + (anchors[a] * bits[c]).sum(axis=1) * weight
            keep = (partial + above[a] * left >= floor[a]) & (partial + below[a] * left <= ceiling[a])
            a, c, partial = a[keep], c[keep], partial[keep]
    if a is None:
        a, c = np.nonzero(alive)
        partial = score[a, c]
    return a, c, partial


class Best:
    """The first k candidates of each slot by score and id, as blocks go by."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, _LEAST)

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - slot.searchsorted(slot)
        keep = place < self.k
        self.slot, self.id, self.score = slot[keep], ids[keep], score[keep]
        full = place[keep] == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


def _positives(part: dict, block: Planes, best: Best, dims: int) -> None:
    ids, labels = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["labels"], np.int64)
    anchors = np.frombuffer(part["data"], np.int64).reshape(-1, dims)
    for at in range(0, len(ids), TILE_ANCHORS):
        to = slice(at, at + TILE_ANCHORS)
        alive = (labels[to, None] == block.labels) & (ids[to, None] != block.ids)
        a, c, score = narrowed(anchors[to], block, alive, best.floor[to], np.full(len(ids[to]), np.iinfo(np.int64).max), best.k)
        best.add(a + at, block.ids[c], score)


def _negatives(part: dict, block: Planes, best: Best, dims: int) -> None:
    """Slots are the places of positives: an anchor's number times POSITIVES, and the rank."""
    ids, labels = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["labels"], np.int64)
    anchors = np.frombuffer(part["data"], np.int64).reshape(-1, dims)
    top = np.frombuffer(part["tops"], np.int64).reshape(len(ids), -1)  # scores of positives, the least number where there are fewer
    there = top != _LEAST
    least = np.where(there, -((-LOW * np.where(there, top, 0)) // OF), np.iinfo(np.int64).max)
    for at in range(0, len(ids), TILE_ANCHORS):
        to = slice(at, at + TILE_ANCHORS)
        floors = np.maximum(least[to], best.floor.reshape(top.shape)[to])
        alive = (labels[to, None] != block.labels) & (ids[to, None] != block.ids)
        a, c, score = narrowed(anchors[to], block, alive, floors.min(axis=1), np.where(there[to], top[to] * HIGH // OF, _LEAST).max(axis=1), 0)
        for j in range(top.shape[1]):
            keep = (score >= floors[a, j]) & (OF * score <= HIGH * top[to][a, j]) & there[to][a, j]
            best.add((a[keep] + at) * top.shape[1] + j, block.ids[c[keep]], score[keep])


def _swept(parts: DataFrame, blocks: DataFrame, n_blocks: int, n_parts: int, width: int, dims: int, negatives: bool, name: str) -> DataFrame:
    """part, slot, id, score: each unit's best, written to the shared folder."""
    stripes = max(1, -(-n_blocks // STRIPE_BLOCKS))
    empty = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = parts.select("part", every(stripes).alias("stripe"), F.lit(-1).alias("block"), "ids", "labels", "data", "tops")
    held = blocks.select(every(n_parts).alias("part"), F.pmod("block", F.lit(stripes)).alias("stripe"), "block", "ids", "labels", F.col("planes").alias("data"), empty("binary").alias("tops"))
    work = asked.unionByName(held).repartition(n_parts * stripes, "part", "stripe").sortWithinPartitions("part", "stripe", "block")

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict | None = None
        best: Best | None = None

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(best.slot), part["part"]), pa.int32()), "slot": pa.array(best.slot, pa.int64()), "id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if row["block"] < 0:
                    if best is not None:
                        yield sent()
                    part = row
                    n = len(row["ids"]) // 8
                    best = Best(n * (len(row["tops"]) // 8 // n if negatives else 1), NEGATIVES if negatives else POSITIVES)
                    continue
                if part is None or (row["part"], row["stripe"]) != (part["part"], part["stripe"]):
                    continue  # a part without anchors
                block = Planes({"ids": row["ids"], "labels": row["labels"], "planes": row["data"]}, width, dims)
                (_negatives if negatives else _positives)(part, block, best, dims)
        if best is not None:
            yield sent()

    return written(work.mapInArrow(best_of, "part int, slot long, id long, score long"), name)


def hard_negatives(vectors: DataFrame, every: int = 100, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row (vec_id, embedding, label) whose id is divisible by
    ``every`` and each of its five best rows of its label, the five best rows of other labels that score 80 to 100 % of that.

    Ties go to the smaller id. Rows with the anchor's own id are neither positives nor negatives of it; repeated anchors have results
    each, other repeated rows are rows each. Missing components of shorter vectors count as zero; an empty vector scores zero. A positive of a score
    below zero has no negatives. Rows left out: see ``integers``. An empty table gives no rows; other columns are ignored. Components so large that
    a hundred times a score may pass 64 bits raise ArithmeticError.
    """
    rows = integers(vectors)
    size = rows.agg(F.count("*").alias("n"), F.max("largest").alias("largest"), F.max(F.size("v")).alias("dims")).first()
    n, dims = size.n, max(1, size.dims or 1)
    reach = int(size.largest or 0) + 1
    if dims * reach * reach * OF >= 1 << 62:
        raise ArithmeticError(f"components up to {reach} in {dims} dimensions: scores don't fit in 64 bits")
    width = reach.bit_length() + 1
    n_blocks, n_parts = max(1, -(-n // block_rows)), 1

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("v").combine_chunks()
        lengths = np.asarray(column.value_lengths(), np.int64)
        out = np.zeros((len(lengths), dims), np.int64)
        out[np.arange(dims) < lengths[:, None]] = np.asarray(column.flatten(), np.int64)
        return out

    def longs(table: pa.Table, name: str) -> bytes:
        return np.asarray(table.column(name).combine_chunks(), np.int64).tobytes()

    def sliced(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([longs(table, "id")], pa.binary()), "labels": pa.array([longs(table, "label")], pa.binary()), "planes": pa.array([pack(matrix(table), width)], pa.binary())})

    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    blocks = written(dealt(rows, n_blocks, "block").groupBy("block").applyInArrow(sliced, "block int, ids binary, labels binary, planes binary"), "planes")
    anchors = rows.filter(F.pmod("id", F.lit(every)) == 0)
    n_parts = max(1, -(-anchors.count() // part_rows))
    anchors = dealt(anchors, n_parts, "part")

    def gathered(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        tops = b""
        if "tops" in table.column_names:
            tops = np.array([(t + [_LEAST] * POSITIVES)[:POSITIVES] for t in table.column("tops").to_pylist()], np.int64).tobytes()
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "rows": pa.array([longs(table, "row")], pa.binary()), "ids": pa.array([longs(table, "id")], pa.binary()), "labels": pa.array([longs(table, "label")], pa.binary()), "data": pa.array([matrix(table).tobytes()], pa.binary()), "tops": pa.array([tops], pa.binary())})

    kind = "part int, rows binary, ids binary, labels binary, data binary, tops binary"
    #: a part's anchors stand in order of their row, so a slot's number names its anchor
    place = F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    named = written(anchors.select("part", "row", "id", "label", "v", place.cast("long").alias("slot")), "anchors")
    parts = named.drop("slot").groupBy("part").applyInArrow(gathered, kind)
    found = _swept(parts, blocks, n_blocks, n_parts, width, dims, False, "positives")
    rank = F.row_number().over(Window.partitionBy("part", "slot").orderBy(F.col("score").desc(), "id"))
    positives = written(found.withColumn("place", rank - 1).filter(F.col("place") < POSITIVES), "positives")
    tops = positives.groupBy("part", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x.score).alias("tops"))
    asked = named.join(tops, ["part", "slot"], "left").select("part", "row", "id", "label", "v", F.coalesce("tops", F.array().cast("array<bigint>")).alias("tops"))
    found = _swept(asked.groupBy("part").applyInArrow(gathered, kind), blocks, n_blocks, n_parts, width, dims, True, "negatives")
    discard(blocks)
    negatives = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    negatives = negatives.select("part", F.floor(F.col("slot") / POSITIVES).alias("slot"), (F.col("slot") % POSITIVES).cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    best = positives.select("part", "slot", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(best, ["part", "slot", "place"]).join(named.select("part", "slot", F.col("id").alias("anchor_id")), ["part", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
