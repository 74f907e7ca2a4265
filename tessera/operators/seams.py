"""Seams between images as watersheds, and blending across them: pixel tables, no image in one task.

The watershed grows regions from seeds over a grid of costs. Its regions are the trees of the minimum spanning forest whose roots are the seeds, so it
is built by rounds of joins instead of a queue: each region without a seed takes its cheapest way out, all at once (Boruvka).
Edges are in a total order (cost, then ends), so the forest is one and the same however it is computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def grid_edges(pixels: DataFrame, cost: str, diagonal: bool = False) -> DataFrame:
    """x, y, x2, y2, w: neighbouring pixels (right and below, or eight around) and the larger cost of both. pixels: x, y and the cost."""
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if diagonal else [])]
    near = pixels.select("x", "y", F.col(cost).alias("_c"), F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2")) for dx, dy in steps))).alias("_e")).select("x", "y", "_c", "_e.*")
    other = pixels.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col(cost).alias("_d"))
    return near.join(other, ["x2", "y2"]).select("x", "y", "x2", "y2", F.greatest("_c", "_d").alias("w"))


def forest(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, label (null where no seed can be reached), and the forest's edges (a, b, w).

    nodes: node; edges: a, b, w (loops are ignored; of two between the same ends the cheaper counts); seeds: node, label, one a node. Equal
    costs are taken in order of the smaller, then the larger end. In a round each tree without a label finds its first edge
    out; trees that choose each other or a labelled one become one. A round at least halves the trees without a label, and edges within a tree are dropped.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))
    live = cut(ordered.select("a", "b", "w", F.col("a").alias("ta"), F.col("b").alias("tb")))
    tree = cut(nodes.select("node").distinct().join(seeds.select("node", "label"), "node", "left").select("node", F.col("node").alias("tree"), "label"))
    chosen = []
    while True:
        labels = tree.select(F.col("node").alias("t"), "label").join(tree.select(F.col("tree").alias("t")).distinct(), "t", "left_semi")
        both = live.select(F.col("ta").alias("t"), F.col("tb").alias("to"), "w", "a", "b").union(live.select("tb", "ta", "w", "a", "b"))
        out = both.join(labels.filter("label IS NULL").select("t"), "t", "left_semi").groupBy("t").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
        out = cut(out.select("t", "e.*"))
        if not out.head(1):
            break
        chosen.append(out.select("a", "b", "w"))
        # each tree points to the one it takes; of two that take each other the smaller stays, unless the pair would lose its way
        back = out.select(F.col("t").alias("to"), F.col("to").alias("_back"))
        point = out.join(back, "to", "left").select("t", F.when((F.col("_back") == F.col("t")) & (F.col("t") < F.col("to")), F.col("t")).otherwise(F.col("to")).alias("to"))
        point = cut(point)
        while True:  # pointers to pointers, until all name a tree that stays
            next_ = point.select(F.col("t").alias("to"), F.col("to").alias("_further"))
            jumped = cut(point.join(next_, "to", "left").select("t", F.coalesce("_further", "to").alias("new"), F.col("to").alias("_was")))
            point = jumped.select("t", F.col("new").alias("to"))
            if not jumped.filter("new <> _was").head(1):
                break
        renamed = tree.join(point.withColumnRenamed("t", "tree"), "tree", "left").select("node", F.coalesce("to", "tree").alias("tree"), "label")
        tree = cut(renamed)
        names = lambda c: point.select(F.col("t").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        live = live.join(names("ta"), "ta", "left").join(names("tb"), "tb", "left").select("a", "b", "w", F.coalesce("_ta", "ta").alias("ta"), F.coalesce("_tb", "tb").alias("tb"))
        live = cut(live.filter("ta <> tb"))
    # a tree's name is a node of it, and the seed's where it has one
    roots = tree.select(F.col("node").alias("tree"), F.col("label").alias("_of"))
    spark = nodes.sparkSession
    labelled = tree.join(roots, "tree", "left").select("node", F.col("_of").alias("label"))
    taken = chosen[0] if chosen else spark.createDataFrame([], ordered.select("a", "b", "w").schema)
    for other in chosen[1:]:
        taken = taken.union(other)
    return labelled, taken.distinct()


def watershed(pixels: DataFrame, cost: str, label: str, diagonal: bool = False) -> DataFrame:
    """x, y, label: pixels with a label keep it, others get that of the region that reaches them over the lowest costs; null where none does."""
    name = lambda x, y: F.struct(F.col(y).alias("y"), F.col(x).alias("x"))
    edges = grid_edges(pixels, cost, diagonal).select(name("x", "y").alias("a"), name("x2", "y2").alias("b"), "w")
    seeds = pixels.filter(F.col(label).isNotNull()).select(name("x", "y").alias("node"), F.col(label).alias("label"))
    found, _ = forest(pixels.select(name("x", "y").alias("node")), edges, seeds)
    return found.select("node.x", "node.y", "label")


def seam_cost(a: Column, b: Column) -> Column:
    """What it costs to change images at a pixel: how much both differ there, as a whole number up to 255."""
    return F.least(F.abs(a - b).cast("long"), F.lit(255).cast("long"))


def merged(first: DataFrame, second: DataFrame, diagonal: bool = False) -> DataFrame:
    """x, y, v, image (1 or 2): two images (x, y, v) in one. Pixels of one image only are its own and seeds; where both are, the
    watershed of their differences divides them. An overlap that no seed borders goes to the first image."""
    both = first.select("x", "y", F.col("v").alias("v1")).join(second.select("x", "y", F.col("v").alias("v2")), ["x", "y"], "full")
    cost = F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull(), seam_cost(F.col("v1"), F.col("v2"))).otherwise(F.lit(0).cast("long"))
    alone = F.when(F.col("v2").isNull(), 1).when(F.col("v1").isNull(), 2)
    rows = cut(both.withColumn("cost", cost).withColumn("alone", alone))
    found = watershed(rows, "cost", "alone", diagonal).withColumn("image", F.coalesce("label", F.lit(1)))
    return rows.join(found, ["x", "y"]).select("x", "y", F.when(F.col("image") == 1, F.col("v1")).otherwise(F.col("v2")).alias("v"), "image")


# ---- blending in the gradient domain


def poisson_problem(merged_: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """x, y, v, fixed, b: what to solve so that the second image's part keeps its gradients and meets the first one's values. fixed: pixels of the
    first image's part; b: the sum of the second image's differences to those of the four neighbours that are in the picture."""
    rows = merged_.select("x", "y", "v", (F.col("image") == 1).alias("fixed"))
    own = second.select("x", "y", F.col("v").alias("s"))
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    near = own.select(F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("_p"), F.col("s").alias("_s")).select("_p.*", "_s")
    div = own.join(near, ["x", "y"]).groupBy("x", "y").agg(F.sum(F.col("s") - F.col("_s")).alias("b"))
    return rows.join(div, ["x", "y"], "left").select("x", "y", "v", "fixed", F.when(F.col("fixed"), 0.0).otherwise(F.coalesce(F.col("b").cast("double"), F.lit(0.0))).alias("b"))


def _around(rows: DataFrame) -> DataFrame:
    """x, y, _sum, _n: the sum and number of each place's neighbours among rows."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    near = rows.select("v", F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("_p"))
    return near.select("_p.x", "_p.y", "v").groupBy("x", "y").agg(F.sum("v").alias("_sum"), F.count("*").alias("_n"))


class _Tile:
    """A tile of a Poisson problem with a border of ``halo`` pixels from its neighbours, as arrays; places outside the picture don't exist."""

    def __init__(self, x: np.ndarray, y: np.ndarray, left: int, top: int, size: int):
        self.at = (y - top, x - left)
        self.shape = (size, size)
        rows, columns = np.indices(self.shape)
        self.odd = (rows + columns + left + top) % 2 == 1
        self.there = self.put(np.ones(len(x)))
        self.count = self.around(self.there)

    def put(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.at] = values
        return out

    def around(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape)
        out[1:] += a[:-1]
        out[:-1] += a[1:]
        out[:, 1:] += a[:, :-1]
        out[:, :-1] += a[:, 1:]
        return out


def relax(problem: DataFrame, sweeps: int, omega: float = 1.0, tile: int = 128, at_once: int = 4) -> DataFrame:
    """problem (x, y, v, fixed, b) after red-black sweeps of n v - (sum of neighbours) = b, over-relaxed by omega: first places with an even x + y, then the others.

    A tile takes its neighbours' pixels as far as ``at_once`` sweeps can reach and makes these sweeps by itself, so
    that rows are exchanged once for them and the result is that of sweeps over the whole picture, whatever the tiles.
    """
    if min(problem.select("x", "y").limit(1).count(), sweeps) == 0:
        return problem
    halo = 2 * min(at_once, sweeps)
    now, left = problem.select("x", "y", "v", "fixed", "b"), sweeps
    kind = dict(now.dtypes)
    whole = "x long, y long, v double, fixed boolean, b double"
    now = now.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"), "fixed", F.col("b").cast("double").alias("b"))

    def run(table: pa.Table, turns: int) -> pa.Table:
        x, y, tx, ty = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("x", "y", "tx", "ty"))
        v, b = (np.asarray(table.column(c).combine_chunks(), np.float64) for c in ("v", "b"))
        fixed = np.asarray(table.column("fixed").combine_chunks())
        t = _Tile(x, y, int(tx[0]) * tile - halo, int(ty[0]) * tile - halo, tile + 2 * halo)
        value, rest = t.put(v), t.put(b)
        free = (t.there > 0) & (t.put(fixed.astype(float)) == 0) & (t.count > 0)
        for _ in range(turns):
            for odd in (False, True):
                here = free & (t.odd == odd)
                new = (t.around(value) + rest) / np.maximum(t.count, 1)
                value = np.where(here, (1 - omega) * value + omega * new, value)
        own = (x // tile == tx) & (y // tile == ty)
        return pa.table({"x": x[own], "y": y[own], "v": value[t.at][own], "fixed": fixed[own], "b": b[own]})

    def tiles(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))

    while left > 0:
        turns = min(at_once, left)
        spread = now.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))
        now = cut(spread.groupBy("tx", "ty").applyInArrow(_with_turns(run, turns), whole))
        left -= turns
    return now.select(F.col("x").cast(kind["x"]).alias("x"), F.col("y").cast(kind["y"]).alias("y"), "v", "fixed", "b")


def _with_turns(run: Callable[[pa.Table, int], pa.Table], turns: int) -> Callable[[pa.Table], pa.Table]:
    def one(table: pa.Table) -> pa.Table:
        return run(table, turns)

    return one


def residual(problem: DataFrame) -> DataFrame:
    """x, y, fixed, r: b + (sum of neighbours) - n v, 0 at fixed places."""
    r = F.col("b") + F.coalesce("_sum", F.lit(0.0)) - F.coalesce("_n", F.lit(0)) * F.col("v")
    return problem.join(_around(problem), ["x", "y"], "left").select("x", "y", "fixed", F.when(F.col("fixed"), 0.0).otherwise(r).alias("r"))


def coarser(of: DataFrame) -> DataFrame:
    """The correction's problem on places of two by two: residuals added up and halved, as two edges join such places; a place with a fixed one is fixed at 0."""
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    rows = of.select(half("x"), half("y"), "fixed", "r").groupBy("x", "y").agg(F.max("fixed").alias("fixed"), (F.sum("r") / 2).alias("b"))
    return rows.select("x", "y", F.lit(0.0).alias("v"), "fixed", F.when(F.col("fixed"), 0.0).otherwise(F.col("b")).alias("b"))


#: A problem of at most so many places a side isn't made coarser, but swept until it is nearly solved.
COARSEST = 64


def _swept_out(problem: DataFrame, side: int) -> DataFrame:
    """Sweeps for a small problem, over-relaxed as suits its size; its pixels meet in few tasks, a hundred sweeps at once."""
    omega = 2 / (1 + math.sin(math.pi / (side + 1)))
    return relax(problem, 100 * max(1, side // 16), omega, tile=512, at_once=100)


def cycle(problem: DataFrame, side: int, sweeps: int = 2, tile: int = 128, coarsest: int = COARSEST) -> DataFrame:
    """One V-cycle of a problem of at most ``side`` places each way: sweeps, the correction from the coarser problem (itself a cycle), sweeps."""
    if side <= coarsest:
        return _swept_out(problem, side)
    now = relax(problem, sweeps, tile=tile)
    below = cycle(cut(coarser(residual(now))), -(-side // 2) + 1, sweeps, tile, coarsest)
    half = now.withColumn("_x", F.floor(F.col("x") / 2)).withColumn("_y", F.floor(F.col("y") / 2))
    step = below.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_e"))
    moved = half.join(step, ["_x", "_y"]).select("x", "y", F.when(F.col("fixed"), F.col("v")).otherwise(F.col("v") + F.col("_e")).alias("v"), "fixed", "b")
    return relax(cut(moved), sweeps, tile=tile)


def solve(problem: DataFrame, tolerance: float = 1e-4, cycles: int = 50, tile: int = 128, coarsest: int = COARSEST) -> tuple[DataFrame, float]:
    """The problem's solution and its largest residual: cycles until that is under the tolerance."""
    size = problem.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    side = 1 + int(max(size[0] or 0, size[1] or 0))
    now, most = problem, float("inf")
    for _ in range(cycles):
        now = cycle(now, side, tile=tile, coarsest=coarsest)
        most = residual(now).agg(F.max(F.abs("r")).alias("m")).first().m or 0.0
        if most < tolerance:
            break
    return now, most


def blended(first: DataFrame, second: DataFrame, tolerance: float = 1e-4, diagonal: bool = False) -> DataFrame:
    """x, y, v: both images along their seam, the second one's part moved to the first one's values over its gradients. Parts that don't touch the first image's keep
    their values up to a constant."""
    problem = cut(poisson_problem(merged(first, second, diagonal), first, second).withColumn("v", F.col("v").cast("double")))
    return solve(problem, tolerance)[0].select("x", "y", "v")
