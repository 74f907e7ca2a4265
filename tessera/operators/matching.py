"""Pairs of images and nearest-neighbour joins of descriptors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import forest

#: Rows of a block that meet the other block at once, which bounds the matrices of distances.
ROWS = 512


def banded_pairs(images: DataFrame, key: str, width: int) -> DataFrame:
    """a, b with a < b <= a + width. Each image looks for its successors by an equality join, not by comparing all."""
    steps = images.select(F.col(key).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(width))).alias("_s"))
    return steps.select("a", (F.col("a") + F.col("_s")).alias("b")).join(images.select(F.col(key).alias("b")), "b", "left_semi").select("a", "b")


def unchecked(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that aren't done yet, in either direction."""
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered(pairs).join(ordered(done), ["a", "b"], "left_anti")


def two_nearest(queries: DataFrame, targets: DataFrame, block: int = 4096) -> DataFrame:
    """q, t, d1, d2: for each query (id, v) its nearest target (ties: the smaller id) and squared distances to the two nearest.

    Both sides are dealt into blocks; each pair of blocks is a group of bounded size that gives two rows a query, and
    the best two of all blocks are kept. No pair of rows leaves its group.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    n_queries, n_targets = parts(queries), parts(targets)
    part = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = queries.select("id", "v", part(n_queries, "i"), every(n_targets, "j"))
    t = targets.select("id", "v", part(n_targets, "j"), every(n_queries, "i"))

    def best_two(a: np.ndarray, b: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # one matrix product gives distances up to rounding; those that may be among the two least are computed exactly
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        about = squares - 2 * (a @ b.T)
        second = np.partition(about, min(1, len(b) - 1), axis=1)[:, min(1, len(b) - 1)]
        rows, columns = np.nonzero(about <= (second + 1e-9 * squares.max(axis=1))[:, None])
        d = ((a[rows] - b[columns]) ** 2).sum(axis=1)
        sorted_ = np.lexsort((columns, d, rows))
        rows, columns, d = rows[sorted_], columns[sorted_], d[sorted_]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < 2
        return rows[keep] + first, columns[keep], d[keep]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, a = _vectors(left)
        other, b = _vectors(right)
        order = np.argsort(other, kind="stable")
        other, b = other[order], b[order]
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        found = [best_two(a[k : k + ROWS], b, k) for k in range(0, len(ids), ROWS)] if len(other) else none
        rows, columns, d = (np.concatenate(x) for x in zip(*(found or none), strict=True))
        return pa.table({"q": pa.array(ids[rows], pa.int64()), "t": pa.array(other[columns], pa.int64()), "d": pa.array(d, pa.float64())})

    near = q.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInArrow(nearest, "q long, t long, d double")
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))).filter("_n <= 2")
    at = lambda k, c: F.max(F.when(F.col("_n") == k, F.col(c)))
    return ranked.groupBy("q").agg(at(1, "t").alias("t"), at(1, "d").alias("d1"), at(2, "d").alias("d2"))


def two_nearest_indexed(queries: DataFrame, targets: DataFrame, exact: bool = False, **options: int) -> DataFrame:
    """As :func:`two_nearest`, through a k-d forest: a query meets the leaves that it opens, not all blocks. Without ``exact`` some of the two may be missed
    (options and recall: see :mod:`forest`); a query that finds one target has no d2."""
    near = forest.nearest(queries, targets, 2, exact=exact, **options)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return near.groupBy("q").agg(at(1, "t").alias("t"), at(1, "d").alias("d1"), at(2, "d").alias("d2"))


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("id").combine_chunks(), dtype=np.int64)
    flat = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def ratio_test(matches: DataFrame, ratio: float) -> DataFrame:
    return matches.filter(F.col("d1") <= ratio * F.col("d2"))


def exclusive(matches: DataFrame) -> DataFrame:
    """Matches whose target no other match has: all of those that share one go."""
    single = matches.groupBy("t").agg(F.count("*").alias("_c")).filter("_c = 1").select("t")
    return matches.join(single, "t", "left_semi")
