"""Corners of pixel tables (img, x, y, v), and the place in another image where a corner's surroundings are found again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

#: Fixed value: the weight of the squared trace in a corner's response.
TRACE_WEIGHT = 0.04
#: Numbers of the places of squares that are correlated at once.
HELD = 1_000_000


def _gauss(scale: float, order: int) -> np.ndarray:
    """A sampled Gaussian of sum 1, or its derivative, whose first moment is -1."""
    r = int(3 * scale + 0.5 * order + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-x * x / (2 * scale * scale))
    if order == 0:
        return g / g.sum()
    g = -x * g
    return g / -(x * g).sum()


def _smoothed(v: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """Convolved along both axes; beyond the edge values are mirrored, without the edge's own repeated."""
    for axis, k in ((1, kx), (0, ky)):
        r = len(k) // 2
        wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        v = np.lib.stride_tricks.sliding_window_view(wide, len(k), axis=axis) @ k[::-1]
    return v


def corner_response(v: np.ndarray, scale: float) -> np.ndarray:
    """Determinant less the weighted squared trace of the smoothed products of derivatives."""
    g, d = _gauss(scale, 0), _gauss(scale, 1)
    x, y = _smoothed(v, d, g), _smoothed(v, g, d)
    xx, xy, yy = (_smoothed(p, g, g) for p in (x * x, x * y, y * y))
    return xx * yy - xy * xy - TRACE_WEIGHT * (xx + yy) ** 2


def corners(pixels: DataFrame, cell: int, scale: float, most: int) -> DataFrame:
    """img, cx, cy, x, y, response, rank: of each cell of ``cell`` by ``cell`` pixels the ``most`` places with the greatest response above zero that is greater than
    all eight around it. A cell is looked at by itself, as an image of its own, and is what a task holds; of equal responses the first by y, then x. Cells too small for the smoothing have no corner."""
    given = tiles.named(pixels)
    kind = dict(given.dtypes)["img"]

    def one(t: pa.Table) -> pa.Table:
        cx, cy, w, h = (int(t.column(c)[0].as_py()) for c in ("cx", "cy", "w", "h"))
        wide, high = min(cell, w - cx * cell), min(cell, h - cy * cell)
        x = y = np.zeros(0, np.int64)
        found = np.zeros(0)
        if min(wide, high) > int(3 * scale + 1):
            r = corner_response(tiles.block(t, cx * cell, cy * cell, wide, high), scale)
            around = np.lib.stride_tricks.sliding_window_view(r, (3, 3)).reshape(high - 2, wide - 2, 9)
            y, x = np.nonzero((np.delete(around, 4, axis=2).max(axis=2) < r[1:-1, 1:-1]) & (r[1:-1, 1:-1] > 0))
            best = np.lexsort((x, y, -r[y + 1, x + 1]))[:most]
            x, y = x[best] + 1, y[best] + 1
            found = r[y, x]
        n = len(found)
        return pa.table({
            "img": pa.array([t.column("img")[0].as_py()] * n, t.schema.field("img").type), "cx": np.full(n, cx), "cy": np.full(n, cy),
            "x": x + cx * cell, "y": y + cy * cell, "response": found, "rank": np.arange(1, n + 1, dtype=np.int32),
        })

    cells = given.join(tiles.sizes(pixels), "img").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return cells.groupBy("img", "cx", "cy").applyInArrow(one, f"img {kind}, cx long, cy long, x long, y long, response double, rank int")


def _places(wide: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rectangles, row by row: the rectangle, and the place's row and column in it."""
    sizes = wide * high
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return of, at // wide[of], at % wide[of]


def _pieces(pixels: DataFrame, wanted: DataFrame, radius: int, tile: int) -> DataFrame:
    """wanted (img, x, y, id) with part: the values of the pixels within radius that one tile holds (row by row), and where they begin."""

    def answer(values: np.ndarray, left: int, top: int, rows: pa.Table) -> pa.Array:
        x, y = tiles.numbers(rows, "x", np.int64) - left, tiles.numbers(rows, "y", np.int64) - top
        a, b = np.maximum(x - radius, 0), np.maximum(y - radius, 0)
        wide, high = np.minimum(x + radius + 1, tile) - a, np.minimum(y + radius + 1, tile) - b
        row, j, i = _places(wide, high)
        ends = np.concatenate([[0], np.cumsum(wide * high)])
        v = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[b[row] + j, a[row] + i]))
        return pa.StructArray.from_arrays([pa.array(a - x + radius), pa.array(b - y + radius), pa.array(wide), v], ["dx", "dy", "w", "v"])

    return tiles.asking(pixels, wanted, F.lit(radius), answer, "struct<dx:bigint,dy:bigint,w:bigint,v:array<double>>", tile)


def coefficients(templates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of templates, each with each place of its window that it fits in (template, row, column; one without the first axis, too); NaN where a place
    isn't whole (NaN in the window), 0 where either doesn't vary."""
    if templates.ndim == 2:
        return coefficients(templates[None], windows[None])[0]
    n, high, wide = templates.shape
    k = (templates - templates.mean(axis=(1, 2), keepdims=True)).reshape(n, -1)
    norm = (k * k).sum(axis=1)
    out = np.zeros((n, windows.shape[1] - high + 1, windows.shape[2] - wide + 1))
    for j in range(out.shape[1]):  # a row of places at a time
        places = np.lib.stride_tricks.sliding_window_view(windows[:, j : j + high], wide, axis=2).transpose(0, 2, 1, 3).reshape(n, out.shape[2], -1)
        less = places - places.mean(axis=2, keepdims=True)
        size = norm[:, None] * (less * less).sum(axis=2)
        with np.errstate(invalid="ignore"):
            out[:, j] = np.where(np.isnan(size), np.nan, np.where(size > 0, np.einsum("npk,nk->np", less, k) / np.sqrt(np.where(size > 0, size, 1)), 0.0))
    return out


def _peak(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and value of the extremum of the parabola through three values, and its second derivative."""
    c, b = (before + after) / 2 - at, (after - before) / 2
    x = np.where(c == 0, 0.0, -b / np.where(c == 0, 1.0, 2 * c))
    return x, c * x * x + b * x + at, 2 * c


def located(pixels: DataFrame, wanted: DataFrame, half: int, search: int, tile: int = tiles.TILE) -> DataFrame:
    """img, id, to, x2, y2, corr, best_x, best_y, best, bend_x, bend_y: where in image ``to`` the square of half width ``half`` around (x, y) of image ``img``
    correlates most, among places up to ``search`` away from (near_x, near_y).

    wanted: img, id, x, y, to, near_x, near_y (whole numbers; a row with a null takes no part). best_x, best_y and best are the whole place and its coefficient (of equal ones the first by
    y, then x); x2, y2 and corr those of parabolas through it and its neighbours, which are the same as best if a neighbour is missing or the parabola's extremum is over one away (corr is the parabolas'
    then, too, but without neighbours best). A square that isn't wholly in the image has no row, and nor has one that fits nowhere. Pixels within an image that aren't there count as zero. A task
    correlates the rows of a batch together, as many at once as have ``HELD`` numbers; the tiles give each row no more than its square and search window.
    """
    columns = ["img", "id", "x", "y", "to", "near_x", "near_y"]
    asked = wanted.select(*columns).dropna()
    kinds = dict(asked.dtypes)
    size = tiles.sizes(pixels)
    whole = (F.col("x") >= half) & (F.col("y") >= half) & (F.col("x") + half < F.col("w")) & (F.col("y") + half < F.col("h"))
    asked = asked.join(size, "img").filter(whole).drop("w", "h").join(size.withColumnRenamed("img", "to"), "to")
    far = half + search
    key = F.struct(*(F.col(c).alias(c) for c in (*columns, "w", "h"))).alias("id")
    squares = _pieces(pixels, asked.select("img", "x", "y", key), half, tile)
    windows = _pieces(pixels, asked.select(F.col("to").alias("img"), F.col("near_x").alias("x"), F.col("near_y").alias("y"), key), far, tile)
    both = squares.select("id.*", "part", F.lit(False).alias("there")).unionByName(windows.select("id.*", "part", F.lit(True).alias("there")))
    whole = both.groupBy(*columns, "w", "h").agg(*(F.collect_list(F.when(side, F.col("part"))).alias(name) for name, side in (("_square", ~F.col("there")), ("_window", F.col("there")))))

    def put(pieces: pa.ListArray, radius: int) -> np.ndarray:
        """Squares of that half width, a row's pieces put together."""
        of = np.repeat(np.arange(len(pieces)), np.asarray(pieces.value_lengths(), np.int64))
        parts = pieces.flatten()
        dx, dy, wide, sizes = (np.asarray(c, np.int64) for c in (*(parts.field(c) for c in ("dx", "dy", "w")), parts.field("v").value_lengths()))
        piece, j, i = _places(wide, sizes // wide)
        out = np.zeros((len(pieces), 2 * radius + 1, 2 * radius + 1))
        out[of[piece], dy[piece] + j, dx[piece] + i] = np.asarray(parts.field("v").flatten(), np.float64)
        return out

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        nx, ny, w, h = (np.asarray(batch.column(c), np.int64)[:, None] for c in ("near_x", "near_y", "w", "h"))
        window, reach, places = put(batch.column("_window"), far), np.arange(-far, far + 1), 2 * search + 1
        window[(ny + reach < 0) | (ny + reach >= h)] = np.nan
        window.transpose(0, 2, 1)[(nx + reach < 0) | (nx + reach >= w)] = np.nan
        r = coefficients(put(batch.column("_square"), half), window)
        some = np.flatnonzero(~np.isnan(r).all(axis=(1, 2)))
        r, n = r[some], np.arange(len(some))
        j, i = np.divmod(np.nanargmax(r.reshape(len(some), -1), axis=1), places) if len(some) else (n, n)
        around = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)  # a place beyond the search has no value either
        best = r[n, j, i]
        bx, by = nx[some, 0] + i - search, ny[some, 0] + j - search
        with np.errstate(invalid="ignore"):
            (dx, vx, cx), (dy, vy, cy) = _peak(around[n, j + 1, i], best, around[n, j + 1, i + 2]), _peak(around[n, j, i + 1], best, around[n, j + 2, i + 1])
            inner = ~np.isnan(cx + cy)
            near = inner & (np.abs(dx) <= 1) & (np.abs(dy) <= 1)
        double = lambda x, missing=None: pa.array(x, pa.float64(), mask=missing)
        x2, y2, corr = bx + np.where(near, dx, 0.0), by + np.where(near, dy, 0.0), np.where(inner, (vx + vy) / 2, best)
        values = [double(x2), double(y2), double(corr), pa.array(bx), pa.array(by), double(best), double(cx, ~inner), double(cy, ~inner)]
        rows = pa.array(some)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("img", "id", "to")), *values], ["img", "id", "to", "x2", "y2", "corr", "best_x", "best_y", "best", "bend_x", "bend_y"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // ((2 * search + 1) * (2 * half + 1) ** 2 + (2 * far + 1) ** 2))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield found(batch.slice(at, step))

    schema = f"img {kinds['img']}, id {kinds['id']}, to {kinds['to']}, x2 double, y2 double, corr double, best_x long, best_y long, best double, bend_x double, bend_y double"
    return whole.mapInArrow(every, schema)
