"""Keypoints of pixel tables (img, x, y, v), their directions and their descriptors.

A tile with its surroundings is one task's work in the search; sums over boxes around a point come from the tiles that they touch and are added up, so
points may be as large as they like and no task holds an image. Pixels that aren't there count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

OCTAVES, SCALES, FIRST_FILTER = 4, 5, 3
THRESHOLD = 1000.0
SIGMA = 1.2
BINS, GRID, WAVE = 18, 11, 4.0
#: Number, radius and half width of the samples of each ring.
RINGS = [(1, 0.0, 2.0), (6, 4.2, 1.9), (6, 8.0, 3.2)]


def filter_size(octave: int, scale: int) -> int:
    step = 2 << octave
    return FIRST_FILTER + 2 * (step - 2) + step * scale


def border(octave: int, scale: int) -> int:
    """Places (of the octave) at each side that have no score at this scale."""
    step = 2 << octave
    size = filter_size(octave, scale) if scale > 2 else filter_size(octave, 1) + (step if octave == 0 else 2 * step)
    return size * 3 // step + 1


def _point_size(octave: int, s: np.ndarray | float) -> np.ndarray | float:
    step = 1 << octave
    return (2 * s * step + FIRST_FILTER + (step - 1) * SCALES) / 3


def _halo(octave: int) -> int:
    # a point moves six places at most, and its sign is taken over 4.5 times its size
    return int(4.5 * _point_size(octave, SCALES - 0.5)) + (8 << octave) + 2


def second_derivatives(table: np.ndarray, size: float, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Box-filter second derivatives along x and y."""
    base = int(size + 0.5)
    mid = base // 2
    far, wide = mid + base, 2 * mid
    box = lambda a, b: tiles.boxes(table, x - a, x + a, y - b, y + b)
    return box(far, wide) - 3 * box(mid, wide), box(wide, far) - 3 * box(wide, mid)


def score(table: np.ndarray, size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Determinant of the box-filter Hessian, for the filter's area."""
    xx, yy = second_derivatives(table, size, x, y)
    d = (3 * size - 1) // 2 - 1
    quarter = lambda i, j: tiles.boxes(table, x + min(i, 0), x + max(i, 0), y + min(j, 0), y + max(j, 0))
    xy = (quarter(d, d) + quarter(-d, -d) - quarter(d, -d) - quarter(-d, d)) * 0.9 * 2 / 3
    return (xx * yy - xy * xy) * (9 / size**2) ** 2


def _scored(values: np.ndarray, left: int, top: int, w: int, h: int, octave: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The block's running sums, and scores by scale, row and column of the octave's places from (gx, gy) on; zero in borders and where the filter leaves the block."""
    step = 1 << octave
    table = tiles.summed(values)
    height, width = values.shape
    gx, gy = -(-left // step), -(-top // step)
    nx, ny = max((left + width - 1) // step - gx + 1, 0), max((top + height - 1) // step - gy + 1, 0)
    out = np.zeros((SCALES, ny, nx))
    x, y = np.meshgrid(np.arange(gx, gx + nx), np.arange(gy, gy + ny))
    for s in range(SCALES):
        b, size = border(octave, s), filter_size(octave, s)
        far = size // 2 + size
        px, py = x * step - left, y * step - top
        known = (x >= b) & (x < w // step - b) & (y >= b) & (y < h // step - b) & (px >= far) & (py >= far) & (px + far < width) & (py + far < height)
        out[s][known] = score(table, size, px[known], py[known])
    return table, out, gx, gy


def scores(pixels: DataFrame, octave: int = 0, tile: int = 256) -> DataFrame:
    """img, x, y, scale, score of the octave's places that aren't in the border of their scale."""
    step = 1 << octave

    def answer(values: np.ndarray, left: int, top: int, tx: int, ty: int, w: int, h: int) -> dict[str, np.ndarray]:
        _, found, gx, gy = _scored(values, left, top, w, h, octave)
        s, j, i = (c.ravel() for c in np.indices(found.shape))
        x, y, b = (i + gx) * step, (j + gy) * step, np.array([border(octave, k) for k in range(SCALES)])[s]
        own = (x // side == tx) & (y // side == ty) & (x // step >= b) & (x // step < w // step - b) & (y // step >= b) & (y // step < h // step - b)
        return {"x": x[own], "y": y[own], "scale": s[own].astype(np.int32), "score": found.ravel()[own]}

    side = tile << octave
    return tiles.with_surroundings(pixels, _halo(octave), side, answer, "x long, y long, scale int, score double")


def _maxima(found: np.ndarray, gx: int, gy: int, octave: int, w: int, h: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each block of two scales, rows and columns the greatest score (of equal ones the last by x, then y, then scale), if nothing around it is greater:
    the block's scale, row and column, and the place's."""
    wide, high = w >> octave, h >> octave
    _, ny, nx = found.shape
    for first in range(1, SCALES - 1, 2):
        b = border(octave, first + 1) + 1
        # the blocks of the image begin at b, whatever the tile
        x = np.arange(b + 2 * max(-(-(gx + 1 - b) // 2), 0), min(wide - b, gx + nx - 2), 2)
        y = np.arange(b + 2 * max(-(-(gy + 1 - b) // 2), 0), min(high - b, gy + ny - 2), 2)
        if not (len(x) and len(y)):
            continue
        bx, by = (c.ravel() for c in np.meshgrid(x, y))
        order = [(first + s, j, i) for i in (0, 1) for j in (0, 1) for s in (0, 1)]
        eight = np.stack([found[s, by - gy + j, bx - gx + i] for s, j, i in order])
        best = len(order) - 1 - np.argmax(eight[::-1], axis=0)
        s, j, i = (np.array([o[k] for o in order])[best] for k in range(3))
        top = eight.max(axis=0)
        some = np.flatnonzero((top >= THRESHOLD * 0.8) & (s < SCALES - 1))
        s, px, py, top = s[some], (bx + i)[some], (by + j)[some], top[some]
        around = np.max([found[s + c, py - gy + d, px - gx + e] for c in (-1, 0, 1) for d in (-1, 0, 1) for e in (-1, 0, 1)], axis=0) if len(some) else top
        limit = np.array([border(octave, k + 1) for k in range(SCALES - 1)])[s]
        fits = (around <= top) & (px >= limit) & (px <= wide - limit - 1) & (py >= limit) & (py <= high - limit - 1)
        yield np.full(fits.sum(), first), by[some][fits], bx[some][fits], s[fits], py[fits], px[fits]


def _fitted(f: np.ndarray, s: int, y: int, x: int, x0: int, x1: int, y0: int, y1: int) -> tuple[np.ndarray, int, int, float] | None:
    """The extremum of the parabola through a place and those around it: its deviation (x, y, scale), the place it is reckoned from after at most five
    moves within x0 < x < x1 and y0 < y < y1, and the score there. None: no extremum, or more than 1.5 away."""
    for turn in range(6):
        c = f[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2]
        if c.shape != (3, 3, 3):
            return None
        slope = np.array([c[1, 1, 2] - c[1, 1, 0], c[1, 2, 1] - c[1, 0, 1], c[2, 1, 1] - c[0, 1, 1]]) / 2
        mixed = lambda p: (p[2, 2] + p[0, 0] - p[2, 0] - p[0, 2]) / 4
        xx, yy, ss = (a - 2 * c[1, 1, 1] + b for a, b in ((c[1, 1, 0], c[1, 1, 2]), (c[1, 0, 1], c[1, 2, 1]), (c[0, 1, 1], c[2, 1, 1])))
        xy, xs, ys = mixed(c[1]), mixed(c[:, 1, :]), mixed(c[:, :, 1])
        try:
            v = np.linalg.solve(np.array([[xx, xy, xs], [xy, yy, ys], [xs, ys, ss]]), -slope)
        except np.linalg.LinAlgError:
            return None
        move = [int(v[k] > 0.6 and at < high) - int(v[k] < -0.6 and at > low) for k, at, low, high in ((0, x, x0, x1), (1, y, y0, y1))]
        if turn == 5 or move == [0, 0]:
            break
        x, y = x + move[0], y + move[1]
    if not (np.abs(v) <= 1.5).all():
        return None
    return v, y, x, c[1, 1, 1] + slope @ v / 2


def detect(pixels: DataFrame, octaves: int = OCTAVES, threshold: float = THRESHOLD, tile: int = 128) -> DataFrame:
    """img, id, x, y, scale, score, trace: maxima of the box-filter Hessian over place and scale, refined by a parabola.

    An octave looks at every 2^octave-th place; its tiles grow with it, so that surroundings stay the same share. id is unique in an image
    and names the octave and the block a point was found in. trace is the sign of the curvature's trace. Scores that an image's border leaves out count as zero.
    """

    def found_in(octave: int) -> DataFrame:
        side, step = tile << octave, 1 << octave

        def answer(values: np.ndarray, left: int, top: int, tx: int, ty: int, w: int, h: int) -> dict[str, np.ndarray]:
            table, found, gx, gy = _scored(values, left, top, w, h, octave)
            rows: list[tuple] = []
            for kept in _maxima(found, gx, gy, octave, w, h):
                own = (kept[2] * step // side == tx) & (kept[1] * step // side == ty)
                for first, by, bx, s, y, x in zip(*(c[own].tolist() for c in kept), strict=True):
                    b = border(octave, s + 1)
                    fit = _fitted(found, s, y - gy, x - gx, b + 1 - gx, (w >> octave) - b - 2 - gx, b + 1 - gy, (h >> octave) - b - 2 - gy)
                    if fit is None or fit[3] < threshold:
                        continue
                    v, fy, fx, value = fit
                    px, py, size = (fx + gx + v[0]) * step, (fy + gy + v[1]) * step, _point_size(octave, s + v[2])
                    rx, ry, base = int(np.floor(px + 0.5)), int(np.floor(py + 0.5)), int(3 * size + 0.5)
                    far = base // 2 + base
                    if not (far < rx < w - 1 - far and far < ry < h - 1 - far):
                        continue
                    sign = sum(d[0] for d in second_derivatives(table, 3 * size, np.array([rx - left]), np.array([ry - top])))
                    rows.append(((((octave * SCALES + first) << 28) + by << 28) + bx, px, py, size * SIGMA, value, 1 if sign > 0 else -1))
            kinds = (np.int64, np.float64, np.float64, np.float64, np.float64, np.int32)
            return {c: np.array([r[k] for r in rows], of) for k, (c, of) in enumerate(zip(("id", "x", "y", "scale", "score", "trace"), kinds, strict=True))}

        return tiles.with_surroundings(pixels, _halo(octave), side, answer, "id long, x double, y double, scale double, score double, trace int")

    out = found_in(0)
    for octave in range(1, octaves):
        out = out.unionByName(found_in(octave))
    return out


# ---- sums around points


def _waves(table: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right half less left half, and lower half less upper half, of the square of half width w."""
    box = lambda a, b, c, d: tiles.boxes(table, x + a * w, x + b * w, y + c * w, y + d * w)
    return box(0, 1, -1, 1) - box(-1, 0, -1, 1), box(-1, 1, 0, 1) - box(-1, 1, -1, 0)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(values.ravel(), pa.float64()))


def _carrying(points: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and all of them as ``own``, so that no row has to be joined with its result."""
    return points.select(*needed, F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("own"))


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A point's parts (one a tile that it touches) added up, entry by entry."""
    others = [c for c in parts.columns if c not in (*keys, "part")]
    rows = parts.groupBy(*keys).agg(*(F.first(c).alias(c) for c in others), F.sort_array(F.collect_list("part")).alias("_p"))
    return rows.withColumn("part", F.aggregate(F.slice("_p", 2, F.size("_p")), F.element_at("_p", 1), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))).drop("_p")


def _stacked(t: pa.RecordBatch) -> np.ndarray:
    column = t.column("part")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _inside(x: np.ndarray, y: np.ndarray, w: np.ndarray, wide: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (x > w) & (x + w < wide - 1) & (y > w) & (y + w < high - 1)


def _grid(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: np.asarray(t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c), np.float64)[:, None]
    dy, dx = (c.ravel() for c in np.mgrid[-GRID : GRID + 1, -GRID : GRID + 1])
    step, wave = np.floor(get("scale") + 0.8).astype(np.int64), np.floor(WAVE * get("scale") + 1.5).astype(np.int64)
    x, y = (np.floor(get(c) + 0.5).astype(np.int64) + d * step for c, d in (("x", dx), ("y", dy)))
    return x, y, wave, dx * dx + dy * dy


def oriented(pixels: DataFrame, points: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """points (img, id, x, y, scale and others) with turn and ori: a row for the strongest of 18 directions (turn 0), and one for each of up to four others that
    stand out and reach 0.8 of it. Directions are those of wave responses on a grid of 23 by 23 places around the point; where there are none, ori is the middle of the first."""
    wanted = _carrying(points.drop("turn", "ori"), ["img", "id", "x", "y", "scale"]).filter("img IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND scale IS NOT NULL").join(tiles.sizes(pixels), "img")
    reach = GRID * F.floor(F.col("scale") + 0.8) + F.floor(WAVE * F.col("scale") + 1.5) + 1

    def answer(values: np.ndarray, left: int, top: int, rows: pa.Table) -> pa.Array:
        x, y, wave, _ = _grid(rows)
        return _lists(np.concatenate(_waves(tiles.summed(values), x - left, y - top, wave), axis=1))

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.num_rows
            sums = _stacked(t)
            x, y, wave, far = _grid(t)
            k = x.shape[1]
            wide, high = (np.asarray(t.column(c), np.int64)[:, None] for c in ("w", "h"))
            size = np.hypot(sums[:, :k], sums[:, k:]) * np.exp(-(0.5 + 6) / BINS**2 * (far + 0.5)) * _inside(x, y, wave, wide, high)
            share = (np.arctan2(sums[:, k:], sums[:, :k]) + np.pi) / (2 * np.pi)
            bins = (share * BINS).astype(np.int64) % BINS
            hist = np.bincount((np.arange(n)[:, None] * BINS + bins).ravel(), size.ravel(), n * BINS).reshape(n, BINS)
            before, after = np.roll(hist, 1, 1), np.roll(hist, -1, 1)
            bend = before + after - 2 * hist
            shift = np.where(bend == 0, 0.0, -0.5 * (after - before) / np.where(bend == 0, 1, bend))
            angle = (np.arange(BINS) + 0.5 + shift) / BINS * 2 * np.pi - np.pi
            most = hist.argmax(axis=1)
            others = (hist > 0.8 * hist.max(axis=1, keepdims=True)) & (before < hist) & (after < hist)
            others[np.arange(n), most] = False
            rank = np.where(others, others.cumsum(axis=1), 0)
            rank[np.arange(n), most] = -1
            row, at = np.nonzero((rank == -1) | ((rank > 0) & (rank <= 4)))
            own = t.column("own").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([own, pa.array(np.maximum(rank[row, at], 0).astype(np.int32)), pa.array(angle[row, at])], ["own", "turn", "ori"])

    parts = _added(tiles.asking(pixels, wanted, reach, answer, "array<double>", tile), ["img", "id"])
    return parts.mapInArrow(directions, f"own {dict(wanted.dtypes)['own']}, turn int, ori double").select("own.*", "turn", "ori")


def _samples() -> np.ndarray:
    """x, y and half width of each sample; every other ring is turned by half a step."""
    turned = lambda k, n: 2 * np.pi * np.arange(n) / n + (np.pi / n if k % 2 else 0)
    return np.concatenate([np.column_stack([r * np.cos(turned(k, n)), r * np.sin(turned(k, n)), np.full(n, w)]) for k, (n, r, w) in enumerate(RINGS)])


def _sampled(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: np.asarray(t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c), np.float64)[:, None]
    s, (sx, sy, width) = np.maximum(np.floor(get("scale")), 1), _samples().T
    sin, cos = np.sin(get("ori")), np.cos(get("ori"))
    near = lambda v: np.floor(v + 0.5).astype(np.int64)
    return near(get("x") + s * (sx * cos - sy * sin)), near(get("y") + s * (sx * sin + sy * cos)), near(width * s), get("ori")


def described(pixels: DataFrame, points: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """points (img, id, turn, x, y, scale, ori and others) with vec, of unit length: at 13 places on rings around the point, turned by its direction, two wave
    responses for the area, turned back, and the mean less the middle's; zeros for places at the image's border, and if nothing varies."""
    keys = ["img", "id", "turn"]
    reach = F.ceil((RINGS[-1][1] + RINGS[-1][2]) * F.greatest(F.floor("scale"), F.lit(1))) + 3
    wanted = _carrying(points.drop("vec"), [*keys, "x", "y", "scale", "ori"]).filter("img IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND scale IS NOT NULL AND ori IS NOT NULL").join(tiles.sizes(pixels), "img")

    def answer(values: np.ndarray, left: int, top: int, rows: pa.Table) -> pa.Array:
        x, y, w, _ = _sampled(rows)
        table = tiles.summed(values)
        right, low = _waves(table, x - left, y - top, w)
        whole = tiles.boxes(table, x - left - w, x - left + w, y - top - w, y - top + w)
        return _lists(np.concatenate([right, low, whole], axis=1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y, w, ori = _sampled(t)
            wide, high = (np.asarray(t.column(c), np.int64)[:, None] for c in ("w", "h"))
            n, k = x.shape
            right, low, whole = (c * _inside(x, y, w, wide, high) / (w * w) for c in np.split(_stacked(t), 3, axis=1))
            there = _inside(x, y, w, wide, high)
            along, across = right * np.cos(ori) + low * np.sin(ori), low * np.cos(ori) - right * np.sin(ori)
            vec = np.stack([along, across, (whole - whole[:, :1]) * there], axis=2).reshape(n, 3 * k)
            vec = np.delete(vec, 2, axis=1)  # the middle has no difference from itself
            length = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
            out = _lists(vec / np.where(length == 0, 1, length))
            yield pa.RecordBatch.from_arrays([t.column("own"), out], ["own", "vec"])

    parts = _added(tiles.asking(pixels, wanted, reach, answer, "array<double>", tile), keys)
    return parts.mapInArrow(vectors, f"own {dict(wanted.dtypes)['own']}, vec array<double>").select("own.*", "vec")
