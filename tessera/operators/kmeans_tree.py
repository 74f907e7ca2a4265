"""Nearest neighbours through a hierarchical k-means tree that is a table.

Each node's rows are split among ``branching`` centroids by Lloyd rounds: rows find their nearest centroid, and centroids become the means of their
rows, as sums that tasks add up before they are shuffled, in the same step: rows go to Python once a round and don't come back. All nodes of a level are
split together, until a node has at most ``leaf`` rows. A search goes down level by level with the ``beam`` nodes of least score: the squared distance to the centroid less ``border`` times the node's variance, so that wide
nodes are opened from further off. Rows of the leaves that it ends in are compared.

Rows meet centroids in their tasks: centroids are sent in blocks of at most ``SENT`` numbers, and a level with more nodes takes more passes, each over
the rows of its own nodes only. A worker holds a batch of rows, a block of centroids with its sums, and differences of at most ``forest.HELD`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .forest import HELD, _compared, _matrix

BRANCHING, LEAF, ROUNDS = 16, 256, 11
BEAM, BORDER = 8, 0.4
#: Numbers of the centroids that are sent to tasks at once.
SENT = 4_000_000


def _passes(rows: DataFrame, centroids: DataFrame, meet: Callable[[dict, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """meet over id, v, node of the rows, with the children (names, centroids, variances) of each parent of a block of nodes; a pass a block."""
    spark = rows.sparkSession
    size = centroids.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("dims")).first()
    blocks = max(1, -(-size.n * (size.dims or 1) // SENT))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))

    def pass_over(number: int) -> DataFrame:
        some = centroids.filter(block("parent") == number).orderBy("parent", "node").toPandas()
        children = {p: (g["node"].to_numpy(np.int64), np.stack([np.asarray(c, np.float64) for c in g["c"]]), g["variance"].to_numpy(np.float64)) for p, g in some.groupby("parent")}
        shared = spark.sparkContext.broadcast(children)
        return rows.filter(block("node") == number).select("id", "v", "node").mapInArrow(lambda batches: meet(shared.value, batches), schema)

    return reduce(DataFrame.unionByName, [pass_over(b) for b in range(blocks)])


def _scores(x: np.ndarray, node: np.ndarray, children: dict, border: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of rows, names of their node's children, and scores (rows by children); at most HELD differences at once."""
    order = np.argsort(node, kind="stable")
    names, starts = np.unique(node[order], return_index=True)
    for n, rows in zip(names, np.split(order, starts[1:]), strict=True):
        if n not in children:
            continue
        to, c, variance = children[n]
        step = max(1, HELD // max(c.size, 1))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            apart = x[r, None, :] - c[None]
            yield r, to, np.multiply(apart, apart, out=apart).sum(axis=2) - border * variance


def _met(rows: DataFrame, centroids: DataFrame, every: bool, border: float = 0.0) -> DataFrame:
    """id, v, node (a child of the row's node), score: of each child if ``every``, else of the nearest (ties: the first).

    rows: id, v, node; centroids: parent, node, c, variance. Rows of nodes without children are left out.
    """
    kind = dict(rows.dtypes)["id"]

    def met(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        take, to, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(to, pa.int64()), pa.array(score, pa.float64())], ["id", "v", "node", "score"])

    def meet(children: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x, node = _matrix(batch.column(1)), np.asarray(batch.column(2), np.int64)
                found, held = [], 0
                for r, names, d in _scores(x, node, children, border):
                    if every:
                        found.append((np.repeat(r, len(names)), np.tile(names, len(r)), d.ravel()))
                    else:
                        best = d.argmin(axis=1)
                        found.append((r, names[best], d[np.arange(len(r)), best]))
                    held += len(found[-1][0]) * x.shape[1]
                    if held >= HELD:
                        yield met(batch, found)
                        found, held = [], 0
                if found:
                    yield met(batch, found)

    return _passes(rows, centroids, meet, f"id {kind}, v array<double>, node long, score double")


def _means(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """node, c, variance, n: of the rows that are nearest to each centroid the mean vector, their mean squared distance from it, and how many they are.

    rows and centroids as for :func:`_met`. A task adds its rows up; its sums are as many as the numbers that it is sent.
    """

    def add(children: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.concatenate([names for names, _, _ in children.values()])) if children else np.zeros(0, np.int64)
        total = None
        for batch in batches:
            x, node = _matrix(batch.column(1)), np.asarray(batch.column(2), np.int64)
            to = np.full(len(x), -1)
            for r, names, d in _scores(x, node, children):
                to[r] = names[d.argmin(axis=1)]
            order = np.argsort(to, kind="stable")
            order = order[np.searchsorted(to[order], 0) :]
            if not len(order):
                continue
            total = np.zeros((len(known), 2 + x.shape[1])) if total is None else total
            for at in range(0, len(order), 2048):
                r = order[at : at + 2048]
                names, starts = np.unique(to[r], return_index=True)
                total[np.searchsorted(known, names)] += np.add.reduceat(np.column_stack([np.ones(len(r)), (x[r] * x[r]).sum(axis=1), x[r]]), starts, axis=0)
        if total is None:
            return
        met, k = np.flatnonzero(total[:, 0]), total.shape[1]
        step = max(1, HELD // k)
        for at in range(0, len(met), step):
            some = met[at : at + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known[some], k)), pa.array(np.tile(np.arange(k), len(some)), pa.int32()), pa.array(total[some].ravel())], ["node", "k", "s"])

    parts = _passes(rows, centroids, add, "node long, k int, s double").groupBy("node", "k").agg(F.sum("s").alias("s"))
    whole = parts.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x.s).alias("s"))
    n = F.get("s", F.lit(0))
    c = F.transform(F.slice("s", 3, F.size("s")), lambda x: x / n)
    out = whole.select("node", c.alias("c"), n.cast("long").alias("n"), (F.get("s", F.lit(1)) / n).alias("_q"))
    return out.select("node", "c", F.greatest(F.col("_q") - F.aggregate("c", F.lit(0.0), lambda t, x: t + x * x), F.lit(0.0)).alias("variance"), "n")


def tree(points: DataFrame, branching: int = BRANCHING, leaf: int = LEAF, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """nodes (parent, node, c, variance, n, level) and rows (id, v, node: the leaf). points: id, v.

    The root is node 0 and has no row among the nodes. First centroids are the distinct vectors of a node that come first by a hash. A centroid without rows goes (its node doesn't exist); a node of equal rows stays a leaf, however many they are.
    """
    spark = points.sparkSession
    now = cut(points.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("node")))
    nodes, settled, level = [], [], 0
    while True:
        sizes = now.groupBy("node").agg(F.count("*").alias("n"), (F.min("v") != F.max("v")).alias("varied"))
        large = sizes.filter((F.col("n") > leaf) & F.col("varied")).select("node")
        if nodes:  # an only child would be split for ever
            only = nodes[-1].groupBy("parent").agg(F.min("node").alias("node"), F.count("*").alias("c")).filter("c = 1")
            large = large.join(only.select("node"), "node", "left_anti")
        large = cut(large)
        settled.append(now.join(large, "node", "left_anti"))
        now = cut(now.join(large, "node", "left_semi"))
        if not now.head(1):
            break
        level += 1
        order = Window.partitionBy("node").orderBy(F.xxhash64("v", F.lit(level)), "v")
        firsts = now.select("node", "v").distinct().withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= branching)
        # a child's number: unique, as levels and parents are kept apart by counting on from what is there
        base = (nodes[-1].agg(F.max("node").alias("m")).first().m if nodes else 0) + 1
        parents = cut(now.select("node").distinct().withColumn("_p", F.row_number().over(Window.orderBy("node")) - 1))
        centroids = cut(firsts.join(parents, "node").select(F.col("node").alias("parent"), (base + F.col("_p") * branching + F.col("_k") - 1).alias("node"), F.col("v").alias("c"), F.lit(0.0).alias("variance")))
        for _ in range(rounds):
            means = cut(_means(now, centroids))
            after = cut(means.join(centroids.select("parent", "node", F.col("c").alias("_was")), "node"))
            still = after.filter(F.col("c") != F.col("_was")).limit(1).count() == 0 and after.count() == centroids.count()
            centroids = after.select("parent", "node", "c", "variance")
            if still:
                break
        nodes.append(cut(after.select("parent", "node", "c", "variance", "n", F.lit(level).alias("level"))))
        now = cut(_met(now, centroids, False).drop("score"))
    empty = spark.createDataFrame([], "parent long, node long, c array<double>, variance double, n long, level int")
    return reduce(DataFrame.unionByName, nodes, empty), cut(reduce(DataFrame.unionByName, settled))


def nearest(queries: DataFrame, nodes: DataFrame, rows: DataFrame, k: int = 2, beam: int = BEAM, border: float = BORDER) -> DataFrame:
    """q, t, d, rank: the k nearest rows in the leaves that each query (id, v) opens, and squared distances; ties go to the smaller id."""
    front = cut(queries.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("score")))
    deepest = nodes.agg(F.max("level").alias("m")).first().m or 0
    order = Window.partitionBy("id").orderBy("score", "node")
    for level in range(1, deepest + 1):
        here = cut(nodes.filter(F.col("level") == level))
        below = _met(front, here, True, border)
        leaves = front.join(here.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
        both = leaves.select("id", "v", "node", "score").unionByName(below)
        front = cut(both.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= beam).drop("_n"))
    as_leaf = lambda df: df.select(F.lit(0).alias("tree"), F.col("node").alias("leaf"), "id", "v")
    found = _compared(as_leaf(front), as_leaf(rows), k).distinct()
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)
