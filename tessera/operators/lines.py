"""Edges of pixel tables and the lines they form: pixels put in order along each line by list ranking, so no line is one task's work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import components

#: Weights of the horizontal derivative at (dx, dy); the vertical one has them turned.
SOBEL = {(-1, -1): -1, (1, -1): 1, (-1, 0): -2, (1, 0): 2, (-1, 1): -1, (1, 1): 1}
#: Places a side of the tiles within which one task follows lines.
TILE = 256
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def _neighbours(pixels: DataFrame, keep: list[str], steps: list[tuple[int, int]] = AROUND) -> DataFrame:
    """img, x, y, dx, dy and kept columns of the pixel at (x + dx, y + dy), for each place that some pixel is beside."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))
    near = pixels.select("img", F.col("x").alias("_x"), F.col("y").alias("_y"), *keep, F.explode(offsets).alias("_o"))
    return near.select("img", (F.col("_x") - F.col("_o.dx")).alias("x"), (F.col("_y") - F.col("_o.dy")).alias("y"), "_o.dx", "_o.dy", *keep)


def gradients(pixels: DataFrame) -> DataFrame:
    """img, x, y, gx, gy, size: derivatives over the eight neighbours (img, x, y, v); pixels that lack one of them are left out. Tasks add up what pixels
    give to their neighbours before places are shuffled."""
    near = _neighbours(pixels, ["v"])
    weigh = lambda turn: F.sum(F.col("v") * F.coalesce(*(F.when((F.col("dx") == (y if turn else x)) & (F.col("dy") == (x if turn else y)), w) for (x, y), w in SOBEL.items()), F.lit(0)))
    sums = near.groupBy("img", "x", "y").agg(weigh(False).alias("gx"), weigh(True).alias("gy"), F.count("v").alias("_n")).filter("_n = 8").drop("_n")
    return sums.join(pixels.select("img", "x", "y"), ["img", "x", "y"], "left_semi").withColumn("size", F.hypot("gx", "gy"))


def thinned(edges: DataFrame) -> DataFrame:
    """Gradients that no neighbour along their own direction (one of four) exceeds; of equal ones in a row the first stays."""
    turn = F.pmod(F.degrees(F.atan2("gy", "gx")) + 22.5, F.lit(180.0))
    step = lambda a: F.when(turn < 45, a[0]).when(turn < 90, a[1]).when(turn < 135, a[2]).otherwise(a[3])
    along = cut(edges.withColumn("_dx", step((1, 1, 0, -1))).withColumn("_dy", step((0, 1, 1, 1))))
    at = lambda sign, name: edges.select("img", F.col("x").alias(f"_x{sign}"), F.col("y").alias(f"_y{sign}"), F.col("size").alias(name))
    both = along
    for k, name in ((1, "_after"), (-1, "_before")):
        sign = "p" if k > 0 else "m"
        both = both.withColumn(f"_x{sign}", F.col("x") + k * F.col("_dx")).withColumn(f"_y{sign}", F.col("y") + k * F.col("_dy")).join(at(sign, name), ["img", f"_x{sign}", f"_y{sign}"], "left")
    most = (F.col("size") >= F.coalesce("_after", F.lit(0.0))) & (F.col("size") > F.coalesce("_before", F.lit(0.0)))
    return both.filter(most).select(*edges.columns)


def _name(x: str = "x", y: str = "y") -> Column:
    return F.struct("img", F.col(y).alias("y"), F.col(x).alias("x"))


def _adjacent(pixels: DataFrame) -> DataFrame:
    """a, b: neighbouring pixels, in both directions."""
    near = _neighbours(pixels, []).join(pixels.select("img", "x", "y"), ["img", "x", "y"], "left_semi")
    return near.select(_name().alias("a"), F.struct("img", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).alias("b"))


def edges(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """img, x, y, gx, gy, size: thinned gradients of at least low that are connected, through such, to one of at least high."""
    some = cut(thinned(cut(gradients(pixels))).filter(F.col("size") >= low))
    parts = components(some.select(_name().alias("node")), _adjacent(some))
    strong = some.filter(F.col("size") >= high).select(_name().alias("node")).join(parts, "node").select("component").distinct()
    kept = parts.join(strong, "component", "left_semi").select("node.*")
    return some.join(kept, ["img", "y", "x"], "left_semi").select(*some.columns)


def _runs(steps: DataFrame, tile: int) -> DataFrame:
    """Steps (a, b: two neighbouring pixels) with next (the step that follows; null at a line's end), far, last: a step carried on as far as it stays in the square tile of its first pixel. A task
    holds one tile's steps; far counts the pixels gone on and last is the one that is reached."""
    kind = dict(steps.select("a.*").dtypes)["img"]

    def one(t: pa.Table) -> pa.Table:
        names = ("ax", "ay", "bx", "by")
        ax, ay, bx, by = (np.asarray(t.column(c).combine_chunks(), np.int64) for c in names)
        x0, y0 = min(ax.min(), bx.min()), min(ay.min(), by.min())
        wide, high = int(max(ax.max(), bx.max()) - x0 + 1), int(max(ay.max(), by.max()) - y0 + 1)
        a, b = (ay - y0) * wide + ax - x0, (by - y0) * wide + bx - x0
        code = a * (wide * high) + b
        order = np.argsort(code)
        # a step's follower leaves its end, and not to where it came from
        first, ends = np.searchsorted(a[order], b), np.searchsorted(a[order], b, side="right")
        follower = np.full(len(a), -1)
        for k in (0, 1):  # pixels have two neighbours at most
            at = first + k
            some = np.flatnonzero(at < ends)
            to = order[at[some]]
            ok = b[to] != a[some]
            follower[some[ok]] = to[ok]
        whole = ends > first  # the end lies in this tile: without a follower the line ends there
        # the last step of each run and how many are before it; a ring inside the tile has none and is left out
        top, before = np.where(follower < 0, np.arange(len(a)), follower), (follower >= 0).astype(np.int64)
        for _ in range(len(a).bit_length()):
            before, top = before + before[top] * (top != np.arange(len(a))), top[top]
        ring = follower[top] >= 0
        out = {c: t.column(c) for c in ("img", *names)}
        end_x, end_y, done = bx[top], by[top], whole[top]
        table = pa.table({**out, "far": before + 1, "fx": ax[top], "fy": ay[top], "lx": end_x, "ly": end_y, "done": done})
        return table.filter(pa.array(~ring))

    flat = steps.select(F.col("a.img").alias("img"), F.col("a.x").cast("long").alias("ax"), F.col("a.y").cast("long").alias("ay"), F.col("b.x").cast("long").alias("bx"), F.col("b.y").cast("long").alias("by"))
    tiles = flat.withColumn("tx", F.floor(F.col("ax") / tile)).withColumn("ty", F.floor(F.col("ay") / tile))
    return tiles.groupBy("img", "tx", "ty").applyInArrow(one, f"img {kind}, ax long, ay long, bx long, by long, far long, fx long, fy long, lx long, ly long, done boolean")


def lines(pixels: DataFrame, least: int = 2, tile: int = TILE) -> DataFrame:
    """img, line (its first pixel as x and y), x, y, place: pixels (img, x, y) in their order along lines of at least ``least`` pixels.

    Pixels with more than two neighbours join lines and belong to none, so what remains is open lines and rings. A task carries the steps of a square tile
    on to where they leave it. The steps that enter tiles are ranked by pointer jumping: each learns how far its line goes on and where it ends, twice as far with each round,
    and the other ones take that from the step where their tile's next one is entered. A line begins at its end that
    comes first by y and x; a ring is left out, as it has no end.
    """
    given = cut(pixels.select("img", "x", "y").distinct())
    crowded = _adjacent(given).groupBy("a").agg(F.count("*").alias("n")).filter("n > 2").select("a.*")
    single = cut(given.join(crowded, ["img", "x", "y"], "left_anti"))
    runs = cut(_runs(_adjacent(single), tile))
    # a run that goes on does so in another tile, with the step from its last pixel that doesn't lead back
    heads = runs.join(runs.filter("NOT done").select("img", F.col("lx").alias("ax"), F.col("ly").alias("ay"), F.col("fx").alias("_fx"), F.col("fy").alias("_fy")).distinct(), ["img", "ax", "ay"]).filter("bx <> _fx OR by <> _fy")
    step = lambda x, y, u, v: F.struct("img", F.col(y).alias("y"), F.col(x).alias("x"), F.col(v).alias("v"), F.col(u).alias("u"))
    starts = heads.select(step("ax", "ay", "bx", "by").alias("step"), step("fx", "fy", "lx", "ly").alias("_end"), "far", "done", F.struct("img", F.col("ly").alias("y"), F.col("lx").alias("x")).alias("last")).distinct()
    after = heads.select(step("_fx", "_fy", "ax", "ay").alias("_end"), step("ax", "ay", "bx", "by").alias("next"))
    now = cut(starts.join(after.distinct(), "_end", "left").select("step", "next", "far", "last"))
    longest = now.count()
    reach = 1
    while reach < longest and now.filter("next IS NOT NULL").head(1):
        ahead = now.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"), F.col("last").alias("_last"))
        now = cut(now.join(ahead, "next", "left").select("step", F.col("_next").alias("next"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_last", "last").alias("last")))
        reach *= 2
    beyond = after.distinct().join(now.select(F.col("step").alias("next"), F.col("next").alias("_more"), F.col("far").alias("_far"), F.col("last").alias("_last")), "next").select("_end", "_far", "_last", F.col("_more").isNull().alias("_ends"))
    whole = runs.withColumn("_end", step("fx", "fy", "lx", "ly")).join(beyond, "_end", "left")
    end = F.coalesce("_last", F.struct("img", F.col("ly").alias("y"), F.col("lx").alias("x")))
    done = whole.filter(F.coalesce("_ends", F.lit(True))).select(F.struct("img", F.col("ay").alias("y"), F.col("ax").alias("x")).alias("a"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), end.alias("last"))
    # a pixel inside a line knows both ends, a line's end the other one
    ends = done.groupBy("a").agg(F.min(F.struct("last", "far")).alias("lo"), F.max(F.struct("last", "far")).alias("hi"), F.count("*").alias("n"))
    first = F.when(F.col("n") == 2, F.col("lo.last")).otherwise(F.least("a", "lo.last"))
    place = F.when(F.col("n") == 2, F.col("lo.far")).when(F.col("a") < F.col("lo.last"), F.lit(0).cast("long")).otherwise(F.col("lo.far"))
    placed = ends.select("a", first.alias("line"), place.alias("place"))
    sized = placed.withColumn("_n", F.count("*").over(Window.partitionBy("line"))).filter(F.col("_n") >= least)
    kinds = dict(given.dtypes)
    as_given = lambda of: [F.col(f"{of}.{c}").cast(kinds[c]).alias(c) for c in ("x", "y")]
    return sized.select(F.col("a.img").alias("img"), F.struct(*as_given("line")).alias("line"), *as_given("a"), "place")
