"""Approximate nearest neighbours by collision counting, for the largest inner product.

Vectors get one more component that makes all norms equal, so a large inner product is a small distance.
The index is made of blocks of about ``BLOCK_ROWS`` vectors; a block keeps, for each of ``PROJECTIONS``
random directions, its vectors' projections as one sorted array. A search opens a window around
the query's projection in every array and widens them all together by ``WIDEN`` (virtual rehashing: no
array is built anew). A vector collides in an array once the window reaches it; one that collides in
``THRESHOLD`` of the arrays is verified by its exact inner product. A search of a block ends once
ten times ``k`` and a ``VERIFY`` share of it are verified, or it has no more.

Every row is indexed. Queries are a stated set, sent in blocks to every index block; each pair of blocks
is one row of work with bounded memory, dealt by both numbers, and returns at most k rows a query. A search
begins with windows a step narrower than those at which the one before it ended.

Arrays are sorted within a block, not over the whole table: windows of a whole array would have to send each collision as a row
(at a width that finds nine tenths of the neighbours, a window holds about a fifth of each array: for 51,282 vectors and 2,565
queries 10^9 rows), while in a block they are counted in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
PROJECTIONS = 48
THRESHOLD = 0.7
WIDEN = 1.3
VERIFY = 0.16
SEED = 20


def usable(vectors: DataFrame) -> DataFrame:
    """id, v: rows that take part. Null, zero or non-finite vectors, those with null components, null ids
    and vectors of another length than most don't."""
    v = F.col("embedding").cast("array<double>")
    zero = F.forall(v, lambda x: x == 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").alias("id"), "embedding").filter(F.col("id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & ~zero)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.filter(F.size("embedding") == (length.n if length else 0)).select("id", F.col("embedding").cast("array<double>").alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64, copy=False)


def _directions(dims: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims + 1, projections))


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radius: float, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        rest = np.sqrt(np.maximum(radius * radius - (vectors * vectors).sum(axis=1), 0.0))
        projected = np.column_stack([vectors, rest]) @ directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(projected, self.order.T, axis=0).T.copy()

    def search(self, query: np.ndarray, own: int, k: int, width: float, at: np.ndarray, threshold: float, verify: float) -> tuple[np.ndarray, np.ndarray, float]:
        """ids and scores of the best k verified, and the last width. at: the query's projections."""
        n, m = len(self.ids), len(self.order)
        least, enough = max(1, int(np.ceil(threshold * m))), min(n, 10 * k + int(np.ceil(verify * n)))
        counts = np.zeros(n, dtype=np.int64)
        low = high = None
        while True:
            lo = np.array([s.searchsorted(a - width, "left") for s, a in zip(self.values, at, strict=True)])
            hi = np.array([s.searchsorted(a + width, "right") for s, a in zip(self.values, at, strict=True)])
            if low is None:
                new = [o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]
            else:
                new = [x for o, a, b, c, d in zip(self.order, lo, low, high, hi, strict=True) for x in (o[a:b], o[c:d])]
            counts += np.bincount(np.concatenate(new), minlength=n)
            low, high = lo, hi
            found = counts >= least
            if found.sum() >= enough or (hi - lo).min() == n:
                break
            width *= WIDEN
        found &= self.ids != own
        rows = np.flatnonzero(found)
        near = self.vectors[rows] @ query
        if len(rows) > k:
            cut = np.partition(near, len(near) - k)[len(near) - k]
            rows = rows[near >= cut - 1e-9 * max(1.0, abs(cut))]
        exact = (self.vectors[rows] * query).sum(axis=1)  # the same sum for equal vectors, whatever stands beside them
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best], width


def search(vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int = BLOCK_ROWS, projections: int = PROJECTIONS, threshold: float = THRESHOLD, verify: float = VERIFY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose id is divisible by
    ``every``, the k nearest found; ties go to the smaller id. Rows with the query's own id are no candidates;
    repeated rows are candidates each, and queries each (a repeated id has the k nearest of each of its rows, ranked
    together); an empty table gives no rows; other columns are ignored."""
    rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(norm2)).alias("radius"), F.max(F.size("v")).alias("dims")).first()
    n, radius, dims = size.n, size.radius or 0.0, size.dims or 0
    blocks = max(1, -(-n // block_rows))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def gathered(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        ids = np.asarray(table.column("id").combine_chunks(), dtype=np.int64)
        places = np.asarray(table.column("row").combine_chunks(), dtype=np.int64)
        return pa.table({"block": pa.array([number], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "places": pa.array([places.tobytes()], pa.binary()), "data": pa.array([_matrix(table.column("v")).tobytes()], pa.binary())})

    kind = "block int, ids binary, places binary, data binary"
    index = numbered.groupBy("block").applyInArrow(gathered, kind)
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).groupBy("block").applyInArrow(gathered, kind)
    asked = asked.select(F.col("ids").alias("query_ids"), F.col("places").alias("query_places"), F.col("data").alias("query_data"), F.col("block").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions(dims, projections)
        held, block = None, None
        for batch in batches:
            for number, ids, data, query_ids, places, queries in zip(*(batch.column(i) for i in range(6)), strict=True):
                if held != number.as_py():
                    held = number.as_py()
                    block = Block(np.frombuffer(ids.as_py(), np.int64), np.frombuffer(data.as_py(), np.float64).reshape(-1, dims), radius, directions)
                query_ids, places = np.frombuffer(query_ids.as_py(), np.int64), np.frombuffer(places.as_py(), np.int64)
                queries = np.frombuffer(queries.as_py(), np.float64).reshape(-1, dims)
                # as long as the vectors, so that distances are small where inner products are large
                scaled = queries * (radius / np.sqrt((queries * queries).sum(axis=1)))[:, None]
                at = scaled @ directions[:-1]
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                width = 0.4 * radius
                for i, q in enumerate(query_ids):  # the next search begins a step narrower than this one ended
                    found, scores, width = block.search(queries[i], q, k, width / WIDEN, at[i], threshold, verify)
                    out.append((np.full(len(found), places[i]), np.full(len(found), q), found, scores))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_pydict({"query_row": pa.array(columns[0], pa.int64()), "query_id": pa.array(columns[1], pa.int64()), "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

    # a row of work is a pair of blocks, so it is dealt by both: no task has all queries of a block
    work = index.join(asked, "block").repartition(blocks * parts, "block", "part").sortWithinPartitions("block")
    work = work.select("block", "ids", "data", "query_ids", "query_places", "query_data")
    found = work.mapInArrow(searched, "query_row long, query_id long, vec_id long, score double")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("place", rank("query_id", "query_row")).filter(F.col("place") <= k)
    return best.withColumn("rank", rank("query_id")).select("query_id", "rank", "vec_id", "score")
