"""Nearest neighbours through randomised k-d trees that are split over partitions.

A tree's splits are fitted on a bounded sample (``SAMPLE`` rows): a node is split at the mean of one of its most varying dimensions, drawn at random, so
that trees differ. The tree is a small table; every row of the targets is then sent to its leaf in each tree, and a
query to the leaves that a best-bin-first walk opens first: it goes down the tree keeping the ``beam`` nodes whose cells are nearest, where a cell's
distance grows by the gap of each split that is crossed. So work is queries times beam times depth for the walk, and
queries times beam times leaf size for distances: it grows as n log n, as long as leaves keep their size. Leaves that hold many rows (copies can't be
split) are dealt into blocks, and their queries meet each block. A leaf and its queries are compared by matrix products of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SAMPLE = 100_000
LEAF_ROWS = 256
BLOCK = 4096
#: Numbers of distances, or of differences of vectors, that a worker holds at once.
HELD = 1 << 18
#: Rows of the cells that the exact walk opens: a query is sent once a cell, so small ones would copy it to nearly every leaf where dimensions are many.
CELL_ROWS = 1024
#: Cells that the walk before it opens, only to learn how far a query has to look.
FIRST_BEAM = 2
TREES, BEAM = 4, 8
#: A split's dimension is drawn among this many of the most varying ones.
VARYING = 5


class Tree:
    """Splits as arrays; node 0 is the root, a leaf has dimension -1."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim, self.at, self.left, self.right, self.size = [-1], [0.0], [0], [0], [len(sample)]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            spread = sample[rows].var(axis=0)
            most = np.argsort(-spread, kind="stable")[:VARYING]
            most = most[spread[most] > 0]
            if not len(most):
                continue
            dim = int(rng.choice(most))
            at = float(sample[rows, dim].mean())
            low = sample[rows, dim] < at
            if low.all() or not low.any():
                continue
            self.dim[node], self.at[node] = dim, at
            for side, kept in (("left", rows[low]), ("right", rows[~low])):
                getattr(self, side)[node] = len(self.dim)
                todo.append((len(self.dim), kept))
                self.dim.append(-1)
                self.at.append(0.0)
                self.left.append(0)
                self.right.append(0)
                self.size.append(len(kept))
        self.dim, self.at, self.left, self.right, self.size = (np.array(x) for x in (self.dim, self.at, self.left, self.right, self.size))
        self.share = 1.0  # of all rows, in the sample

    def coarser(self, rows: int) -> Tree:
        """The tree down to nodes of at most that many of all rows."""
        out = copy(self)
        out.dim = np.where(self.size <= rows * self.share, -1, self.dim)
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return node
            here = node[inner]
            below = x[inner, self.dim[here]] < self.at[here]
            node[inner] = np.where(below, self.left[here], self.right[here])

    def opened(self, x: np.ndarray, beam: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves that each row's walk opens: the ``beam`` nearest cells on the way down; with reach (a squared distance
        a row) every cell within it. A cell's distance is the sum over its dimensions of the largest gap crossed, squared."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        gaps = np.zeros(x.shape)  # per open cell, the gap in each dimension
        while True:
            inner = self.dim[node] >= 0
            if not inner.any():
                return row, node
            r, n, g = row[inner], node[inner], gaps[inner]
            gap = x[r, self.dim[n]] - self.at[n]
            near, far = np.where(gap < 0, self.left[n], self.right[n]), np.where(gap < 0, self.right[n], self.left[n])
            over = g.copy()
            k = np.arange(len(n))
            over[k, self.dim[n]] = np.maximum(over[k, self.dim[n]], np.abs(gap))
            row, node, gaps = np.concatenate([row[~inner], r, r]), np.concatenate([node[~inner], near, far]), np.concatenate([gaps[~inner], g, over])
            distance = (gaps * gaps).sum(axis=1)
            if reach is None:
                order = np.lexsort((node, distance, row))
                kept = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < beam]
            else:
                kept = np.flatnonzero(distance <= reach[row])
            row, node, gaps = row[kept], node[kept], gaps[kept]


def grown(targets: DataFrame, trees: int = TREES, leaf: int = LEAF_ROWS, seed: int = 1, sample: int = SAMPLE) -> list[Tree]:
    """Trees over a sample of at most ``sample`` rows (id, v), chosen by a hash of the id; leaves hold about ``leaf`` of all rows."""
    n = targets.count()
    share = min(1.0, sample / max(n, 1))
    some = targets if share == 1 else targets.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = some.orderBy("id").limit(2 * sample).select("v").toPandas()["v"]
    x = np.array([np.asarray(v, np.float64) for v in rows]) if len(rows) else np.zeros((0, 1))
    out = [Tree(x, max(1, int(leaf * len(x) / max(n, 1))), seed + t) for t in range(trees)]
    for tree in out:
        tree.share = len(x) / max(n, 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _dealt(rows: DataFrame, trees: list[Tree], beam: int, reach: str | None = None) -> DataFrame:
    """tree, leaf, id, v (and the column reach): each row once for each leaf that it opens; beam 0: its own leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded: twice SAMPLE nodes a tree
    kind = dict(rows.dtypes)["id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch.column("v"))
                most = np.asarray(batch.column(reach), np.float64) if reach else None
                for t, tree in enumerate(shared.value):
                    row, leaf = (np.arange(len(x)), tree.leaf_of(x)) if not beam and most is None else tree.opened(x, beam, most)
                    for part in range(0, len(row), 4096):
                        take = pa.array(row[part : part + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t), pa.int32()), pa.array(leaf[part : part + 4096], pa.int32()), batch.column("id").take(take), batch.column("v").take(take)], ["tree", "leaf", "id", "v"])

    return rows.select("id", F.col("v").cast("array<double>").alias("v"), *([reach] if reach else [])).mapInArrow(deal, f"tree int, leaf int, id {kind}, v array<double>")


def _least(a: np.ndarray, b: np.ndarray, rank: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of rows of a, of each one's k nearest rows of b (ties: by rank), and squared distances: some rows of a at a time.

    One matrix product gives distances up to rounding; those that may be among the k least are computed exactly. Where b has copies these may be all,
    so they are taken in parts, too.
    """
    step, part = max(1, HELD // len(b)), max(1, HELD // a.shape[1])
    last, of_b = min(k, len(b)) - 1, (b * b).sum(axis=1)
    for at in range(0, len(a), step):
        x = a[at : at + step]
        squares = (x * x).sum(axis=1)[:, None] + of_b[None, :]
        about = squares - 2 * (x @ b.T)
        rows, columns = np.nonzero(about <= (np.partition(about, last, axis=1)[:, last] + 1e-9 * squares.max(axis=1))[:, None])
        d = np.concatenate([((x[rows[i : i + part]] - b[columns[i : i + part]]) ** 2).sum(axis=1) for i in range(0, max(len(rows), 1), part)])
        order = np.lexsort((rank[columns], d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        yield at + rows[keep], columns[keep], d[keep]


def _compared(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """q, t, d: each query's k nearest (squared distance, ties: the smaller id) in each block of the leaves it opens."""
    kind = dict(held.dtypes)["id"]
    blocks = cut(held.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    of = held.join(blocks, ["tree", "leaf"]).select("tree", "leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    # queries of a leaf are dealt, too, so that a leaf that many ask for is many groups
    parts = cut(asked.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    to = asked.join(blocks, ["tree", "leaf"]).join(parts, ["tree", "leaf"])
    to = to.select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")
    of = of.join(parts, ["tree", "leaf"]).select("tree", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        ids, other = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        if not len(ids) or not len(other):
            return pa.table({"q": ids.slice(0, 0), "t": other.slice(0, 0), "d": pa.array([], pa.float64())})
        rank = np.argsort(np.argsort(np.asarray(other)))
        q, t, d = (np.concatenate(c) for c in zip(*_least(a, b, rank, k), strict=True))
        return pa.table({"q": ids.take(pa.array(q)), "t": other.take(pa.array(t)), "d": pa.array(d, pa.float64())})

    keys = ["tree", "leaf", "block", "part"]
    return to.groupBy(*keys).cogroup(of.groupBy(*keys)).applyInArrow(nearest, f"q {kind}, t {kind}, d double")


def nearest(queries: DataFrame, targets: DataFrame, k: int = 2, trees: int = TREES, beam: int = BEAM, leaf: int = LEAF_ROWS, exact: bool = False, seed: int = 1) -> DataFrame:
    """q, t, d, rank: for each query (id, v) the k nearest targets found and their squared distances; ties go to the smaller id.

    exact: one tree serves. A short walk gives a k-th distance, and a second one opens every cell (of ``CELL_ROWS``) within it, so that none is missed; in many dimensions
    these may be most cells. Ids are distinct on each side. Vectors have one length and finite components; queries without targets have no rows.
    """
    forest = grown(targets, 1 if exact else trees, leaf, seed)
    held = cut(_dealt(targets, forest, 0))
    found = _compared(_dealt(queries, forest, min(beam, FIRST_BEAM) if exact else beam), held, k)
    order = Window.partitionBy("q").orderBy("d", "t")
    best = lambda df: df.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = best(found)
    if not exact:
        return first
    first = cut(first)
    reach = first.groupBy("q").agg(F.max(F.when(F.col("rank") == k, F.col("d"))).alias("reach"))
    # rounding of a distance must not close a cell; a query with fewer than k found opens all
    asked = queries.join(reach.withColumnRenamed("q", "id"), "id", "left").withColumn("reach", F.coalesce(F.col("reach") * (1 + 1e-9), F.lit(float("inf"))))
    cells = [forest[0].coarser(CELL_ROWS)]
    return best(_compared(_dealt(asked, cells, 0, "reach"), cut(_dealt(targets, cells, 0)), k))
