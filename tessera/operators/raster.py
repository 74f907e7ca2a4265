"""Remapping and pyramids of images that are pixel tables: no image is one row, and none is in one task.

Pixels: img, x, y, v, and optionally m, a mask (0: not there). Places: img, id, sx, sy (where in that image a value is wanted).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 64
#: Of the weights of a place at least this much must fall on pixels that are there.
LEAST_WEIGHT = 0.2

# Coefficients of x^3, x^2, x and 1 of each tap's weight, from the first tap to the last.
CUBIC_A = -0.75
POLYNOMIALS: dict[str, list[tuple[float, float, float, float]]] = {
    "bilinear": [(0, 0, -1, 1), (0, 0, 1, 0)],
    "spline16": [(-1 / 3, 4 / 5, -7 / 15, 0), (1, -9 / 5, -1 / 5, 1), (-1, 6 / 5, 4 / 5, 0), (1 / 3, -1 / 5, -2 / 15, 0)],
    "spline36": [
        (1 / 11, -45 / 209, 26 / 209, 0),
        (-6 / 11, 270 / 209, -156 / 209, 0),
        (13 / 11, -453 / 209, -3 / 209, 1),
        (-13 / 11, 288 / 209, 168 / 209, 0),
        (6 / 11, -72 / 209, -42 / 209, 0),
        (-1 / 11, 12 / 209, 7 / 209, 0),
    ],
    "spline64": [
        (-1 / 41, 168 / 2911, -97 / 2911, 0),
        (6 / 41, -1008 / 2911, 582 / 2911, 0),
        (-24 / 41, 4032 / 2911, -2328 / 2911, 0),
        (49 / 41, -6387 / 2911, -3 / 2911, 1),
        (-49 / 41, 4050 / 2911, 2340 / 2911, 0),
        (24 / 41, -1080 / 2911, -624 / 2911, 0),
        (-6 / 41, 270 / 2911, 156 / 2911, 0),
        (1 / 41, -45 / 2911, -26 / 2911, 0),
    ],
}
SINCS = {"sinc256": 8, "sinc1024": 32}
KERNELS = ("nearest", "bilinear", "cubic", "spline16", "spline36", "spline64", *SINCS)


def taps(kernel: str) -> int:
    return {"nearest": 2, "cubic": 4, **SINCS}.get(kernel) or len(POLYNOMIALS[kernel])


def weights(kernel: str, x: np.ndarray) -> np.ndarray:
    """The taps' weights (rows by taps) for places that lie x (0 to 1) behind the tap before their middle."""
    if kernel == "nearest":
        return np.column_stack([x < 0.5, x >= 0.5]).astype(np.float64)
    half = taps(kernel) // 2
    d = np.abs(np.arange(taps(kernel)) - (half - 1) - x[:, None])  # distances of the taps
    if kernel in SINCS:
        return np.sinc(d) * np.sinc(d / half)
    if kernel == "cubic":
        a = CUBIC_A
        return np.where(d < 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
    return np.column_stack([np.polyval(c, x) for c in POLYNOMIALS[kernel]])


def remap(pixels: DataFrame, places: DataFrame, kernel: str, around: Column | None = None, tile: int = TILE) -> DataFrame:
    """img, id, v, m: the image's value and mask at each place, by a kernel of up to 32 by 32 taps; null where less than a fifth of its weight is on pixels that are there.

    A place goes to each tile of its image that its kernel touches (mostly one), and meets the tile's pixels there; the tiles' sums of weights, of
    weighted values and masks are added up for each place, and divided: weights of pixels that aren't there, or masked, count for
    nothing. around: the width of images that close on themselves (a column of places, null where they don't), whose columns go on at the other side.
    """
    n = taps(kernel)
    first = lambda c: F.floor(c) - (n // 2 - 1)
    named = places.select("img", "id", F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"), (F.lit(None) if around is None else around).cast("long").alias("wide"))
    spread = named.withColumn("_x0", first("sx")).withColumn("_y0", first("sy"))
    cells = lambda c: F.sequence(F.floor(F.col(c) / tile), F.floor((F.col(c) + n - 1) / tile))
    columns = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(F.pmod(F.col("_x0") + k, F.col("wide")) / tile))
    spread = spread.withColumn("tx", F.explode(F.when(F.col("wide").isNull(), cells("_x0")).otherwise(F.array_distinct(columns)))).withColumn("ty", F.explode(cells("_y0")))
    mask = F.col("m").cast("double") if "m" in pixels.columns else F.lit(1.0)
    held = pixels.select("img", "x", "y", F.col("v").cast("double").alias("v"), mask.alias("m"), F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).filter("v IS NOT NULL AND m <> 0")
    kinds = dict(named.dtypes)

    def summed(asked: pa.Table, source: pa.Table) -> pa.Table:
        out = {"img": asked.column("img"), "id": asked.column("id")}
        k = asked.num_rows
        total, value, masked = np.zeros(k), np.zeros(k), np.zeros(k)
        if k and source.num_rows:
            left, top = (int(asked.column(c)[0].as_py()) * tile for c in ("tx", "ty"))
            get = lambda t, c, of: np.asarray(t.column(c).combine_chunks(), of)
            at = (get(source, "y", np.int64) - top, get(source, "x", np.int64) - left)
            there, v, m = np.zeros((tile, tile)), np.zeros((tile, tile)), np.zeros((tile, tile))
            there[at], v[at], m[at] = 1.0, get(source, "v", np.float64), get(source, "m", np.float64)
            sx, sy = get(asked, "sx", np.float64), get(asked, "sy", np.float64)
            wide = np.array([w or 0 for w in asked.column("wide").to_pylist()], np.int64)
            bx, by = np.floor(sx), np.floor(sy)
            wx, wy = weights(kernel, sx - bx), weights(kernel, sy - by)
            for i in range(n):
                x = bx.astype(np.int64) - (n // 2 - 1) + i
                x = np.where(wide > 0, x % np.maximum(wide, 1), x) - left
                for j in range(n):
                    y = by.astype(np.int64) - (n // 2 - 1) + j - top
                    rows = np.flatnonzero((x >= 0) & (x < tile) & (y >= 0) & (y < tile))
                    w = wx[rows, i] * wy[rows, j] * there[y[rows], x[rows]]
                    total[rows] += w
                    value[rows] += w * v[y[rows], x[rows]]
                    masked[rows] += w * m[y[rows], x[rows]]
        return pa.table({**out, "w": total, "wv": value, "wm": masked})

    keys = ["img", "tx", "ty"]
    parts = spread.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(summed, f"img {kinds['img']}, id {kinds['id']}, w double, wv double, wm double")
    sums = parts.groupBy("img", "id").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("wm").alias("wm"))
    whole = F.col("w") > LEAST_WEIGHT
    return sums.select("img", "id", F.when(whole, F.col("wv") / F.col("w")).alias("v"), F.when(whole, F.col("wm") / F.col("w")).alias("m"))


# ---- pyramids

#: The five weights of a reduction.
REDUCE = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _spread(pixels: DataFrame, to: Callable[[str], Column], *extra: str) -> DataFrame:
    """Each pixel once for each place that it gives to, with the product of both axes' weights as w."""
    return pixels.select("img", *extra, F.explode(to("x")).alias("_x"), "y").select("img", *extra, "_x", F.explode(to("y")).alias("_y")).select("img", F.col("_x.k").alias("x"), F.col("_y.k").alias("y"), (F.col("_x.w") * F.col("_y.w")).alias("w"), *extra)


def _weight(distance: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in REDUCE[2:])), (F.abs(distance) + 1).cast("int"))


def reduced(pixels: DataFrame) -> DataFrame:
    """img, x, y, v: the next level, of half the size (rounded up). A place (x, y) takes the pixels up to two from (2x, 2y), those that are there, by
    the weights 1 4 6 4 1; it is there if any of them is. Tasks add up what their pixels give before places are shuffled."""

    def to(c: str) -> Column:
        ks = F.sequence(F.ceil((F.col(c) - 2) / 2), F.floor((F.col(c) + 2) / 2))
        return F.transform(F.filter(ks, lambda k: k >= 0), lambda k: F.struct(k.alias("k"), _weight(F.col(c) - 2 * k).alias("w")))

    sums = _spread(pixels.filter("v IS NOT NULL"), to, "v").groupBy("img", "x", "y").agg(F.sum(F.col("w") * F.col("v")).alias("_v"), F.sum("w").alias("_w"))
    sizes = pixels.groupBy("img").agg(F.max("x").alias("_right"), F.max("y").alias("_bottom"))
    inside = sums.join(sizes, "img").filter((2 * F.col("x") <= F.col("_right")) & (2 * F.col("y") <= F.col("_bottom")))
    return inside.select("img", "x", "y", (F.col("_v") / F.col("_w")).alias("v"))


def expanded(level: DataFrame, like: DataFrame) -> DataFrame:
    """img, x, y, v: a level brought back to the places of the finer level ``like``: a place takes the coarse places within one of half its
    coordinates, by the weights whose distance has its parity, renormalised."""

    def to(c: str) -> Column:
        ks = F.sequence(2 * F.col(c) - 2, 2 * F.col(c) + 2)
        return F.transform(ks, lambda k: F.struct(k.alias("k"), _weight(k - 2 * F.col(c)).alias("w")))

    sums = _spread(level, to, "v").groupBy("img", "x", "y").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return like.select("img", "x", "y").join(sums, ["img", "x", "y"])


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """img, level, x, y, v: level 0 (the pixels) to ``levels``."""
    now = pixels.select("img", "x", "y", F.col("v").cast("double").alias("v"))
    out = now.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        now = reduced(now)
        out = out.unionByName(now.withColumn("level", F.lit(k)))
    return out.select("img", "level", "x", "y", "v")


def bands(pixels: DataFrame, levels: int) -> DataFrame:
    """img, level, x, y, v: differences of each level from the next one brought back, and the last level itself."""
    now = pixels.select("img", "x", "y", F.col("v").cast("double").alias("v"))
    out = None
    for k in range(levels + 1):
        below = reduced(now) if k < levels else None
        if below is None:
            band = now
        else:
            back = expanded(below, now).withColumnRenamed("v", "_e")
            band = now.join(back, ["img", "x", "y"]).select("img", "x", "y", (F.col("v") - F.col("_e")).alias("v"))
        band = band.withColumn("level", F.lit(k))
        out = band if out is None else out.unionByName(band)
        now = below
    return out.select("img", "level", "x", "y", "v")


def collapsed(levels_: DataFrame, levels: int) -> DataFrame:
    """img, x, y, v: the picture of its bands."""
    at = lambda k: levels_.filter(F.col("level") == k).select("img", "x", "y", "v")
    now = at(levels)
    for k in range(levels - 1, -1, -1):
        band = at(k)
        back = expanded(now, band).withColumnRenamed("v", "_e")
        now = band.join(back, ["img", "x", "y"]).select("img", "x", "y", (F.col("v") + F.col("_e")).alias("v"))
    return now


def multiband(pixels: DataFrame, weight: DataFrame, levels: int) -> DataFrame:
    """x, y, v: images (img) blended band by band. weight: img, x, y, v (1 where the image is wanted, else 0); each band is averaged by the weights
    of its own level, so that seams are as wide as a band's detail. Places without weight of any image go to those that are there, equally."""
    band, mask = bands(pixels, levels), pyramid(weight, levels).withColumnRenamed("v", "w")
    both = band.join(mask, ["img", "level", "x", "y"])
    w = F.sum("w")
    mixed = both.groupBy("level", "x", "y").agg(F.when(w > 0, F.sum(F.col("w") * F.col("v")) / w).otherwise(F.avg("v")).alias("v"))
    return collapsed(mixed.withColumn("img", F.lit(0)), levels).select("x", "y", "v")
