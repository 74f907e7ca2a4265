import numpy as np
from pyspark.sql import functions as F

from tessera.operators import correlation, keypoints, tiles


def frame(spark, *images, parts=3):
    rows = [(k, x, y, float(v[y, x])) for k, v in enumerate(images) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "img int, x int, y int, v double").repartition(parts)


def blobs(h, w, places, base=20):
    y, x = np.mgrid[:h, :w]
    return np.rint(base + sum(a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s)) for cx, cy, s, a in places))


def box(v, x0, x1, y0, y1):
    return v[y0 : y1 + 1, x0 : x1 + 1].sum()


def hessian(v, size, x, y):
    """By sums over the pixels themselves."""
    mid, wide = size // 2, 2 * (size // 2)
    far, d = mid + size, (3 * size - 1) // 2 - 1
    xx = box(v, x - far, x + far, y - wide, y + wide) - 3 * box(v, x - mid, x + mid, y - wide, y + wide)
    yy = box(v, x - wide, x + wide, y - far, y + far) - 3 * box(v, x - wide, x + wide, y - mid, y + mid)
    xy = box(v, x, x + d, y, y + d) + box(v, x - d, x, y - d, y) - box(v, x, x + d, y - d, y) - box(v, x - d, x, y, y + d)
    return (xx * yy - (0.6 * xy) ** 2) * 81 / size**4


def test_scores_equal_sums_over_pixels(spark):
    v = np.random.default_rng(2).integers(0, 255, (75, 90)).astype(float)
    for octave, tile in ((0, 32), (1, 48)):
        got = {(r.scale, r.x, r.y): r.score for r in keypoints.scores(frame(spark, v), octave, tile).collect()}
        step, want = 1 << octave, {}
        for s in range(5):
            b, size = keypoints.border(octave, s), keypoints.filter_size(octave, s)
            for y in range(b, 75 // step - b):
                for x in range(b, 90 // step - b):
                    want[s, x * step, y * step] = hessian(v, size, x * step, y * step)
        assert set(got) == set(want) and max(abs(got[k] - want[k]) / (1 + abs(want[k])) for k in want) < 1e-9
    assert [keypoints.filter_size(1, s) for s in range(5)] == [7, 11, 15, 19, 23]


def test_planted_blobs_are_found_with_their_scale(spark):
    planted = [(60, 60, 2.5, 180), (150, 70, 4, 150), (80, 160, 7, 150), (190, 180, 10, 150)]
    v = blobs(260, 270, planted)
    whole = {r.id: r for r in keypoints.detect(frame(spark, v), tile=512).collect()}
    for x, y, s, _ in planted:
        near = [r for r in whole.values() if abs(r.x - x) < 0.2 + s / 8 and abs(r.y - y) < 0.2 + s / 8 and r.trace == -1]
        assert any(0.6 * s < r.scale < 1.6 * s for r in near), (x, y, s, near)
    # tiles don't change what is found
    tiled = {r.id: r for r in keypoints.detect(frame(spark, v), tile=40).collect()}
    assert set(tiled) == set(whole)
    for k, r in whole.items():
        assert abs(r.x - tiled[k].x) < 1e-6 and abs(r.scale - tiled[k].scale) < 1e-6 and abs(r.score - tiled[k].score) < 1e-3 and r.trace == tiled[k].trace
    dark = keypoints.detect(frame(spark, 255 - v)).filter("abs(x - 60) < 1 AND abs(y - 60) < 1").collect()
    assert dark and all(r.trace == 1 for r in dark)


def test_nothing_to_find(spark):
    flat = frame(spark, np.full((60, 60), 9.0))
    assert keypoints.detect(flat).count() == 0 and keypoints.detect(flat.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1, 1, 1.0), (0, None, 1, 1.0), (0, 2, 2, None)], "img int, x int, y int, v double")
    assert keypoints.detect(odd).count() == 0
    assert keypoints.oriented(flat, keypoints.detect(flat)).count() == 0


def plain_direction(v, x, y, scale):
    """The histogram and its strongest direction, place by place."""
    step, w, hist = int(scale + 0.8), int(4 * scale + 1.5), np.zeros(18)
    rx, ry = int(x + 0.5), int(y + 0.5)
    for j in range(-11, 12):
        for i in range(-11, 12):
            px, py = rx + i * step, ry + j * step
            if not (w < px < v.shape[1] - 1 - w and w < py < v.shape[0] - 1 - w):
                continue
            dx = box(v, px, px + w, py - w, py + w) - box(v, px - w, px, py - w, py + w)
            dy = box(v, px - w, px + w, py, py + w) - box(v, px - w, px + w, py - w, py)
            size = np.hypot(dx, dy)
            if size > 0:
                hist[int((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 18) % 18] += size * np.exp(-6.5 / 324 * (i * i + j * j + 0.5))
    angle = lambda k: (k + 0.5 - 0.5 * (hist[(k + 1) % 18] - hist[k - 1]) / (hist[k - 1] + hist[(k + 1) % 18] - 2 * hist[k])) / 18 * 2 * np.pi - np.pi
    top = int(hist.argmax())
    more = [k for k in range(18) if k != top and hist[k] > 0.8 * hist[top] and hist[k] > hist[k - 1] and hist[k] > hist[(k + 1) % 18]]
    return [angle(k) for k in [top, *more[:4]]]


def test_directions_and_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 60, (130, 150)).astype(float) + np.add.outer(np.arange(130), 2 * np.arange(150)) // 3
    points = [(0, k, float(x), float(y), s, "own") for k, (x, y, s) in enumerate([(70.3, 60.6, 1.4), (64.0, 64.0, 2.6), (75.5, 66.2, 1.9), (12.0, 118.0, 1.5)])]
    df = spark.createDataFrame(points, "img int, id long, x double, y double, scale double, note string")
    turned = keypoints.oriented(frame(spark, v), df, tile=32)
    found = {}
    for r in turned.orderBy("id", "turn").collect():
        found.setdefault(r.id, []).append(r.ori)
        assert r.note == "own" and r.turn == len(found[r.id]) - 1
    for _, k, x, y, s, _ in points:
        assert np.allclose(found[k], plain_direction(v, x, y, s), atol=1e-9), k
    rows = keypoints.described(frame(spark, v), turned, tile=32).collect()
    assert len(rows) == sum(map(len, found.values()))
    for r in rows:
        vec, a, s = np.array(r.vec), r.ori, max(int(r.scale), 1)
        assert len(vec) == 38 and abs(np.linalg.norm(vec) - 1) < 1e-9
        want, middle = [], 0.0
        for k, (n, radius, width) in enumerate([(1, 0, 2), (6, 4.2, 1.9), (6, 8, 3.2)]):
            for q in range(n):
                phi = 2 * np.pi * q / n + (np.pi / 6 if k == 1 else 0) + a
                px, py, w = (int(np.floor(c + 0.5)) for c in (r.x + s * radius * np.cos(phi), r.y + s * radius * np.sin(phi), width * s))
                if not (w < px < 149 - w and w < py < 129 - w):
                    want += [0] * (2 if k == 0 else 3)
                    continue
                dx = (box(v, px, px + w, py - w, py + w) - box(v, px - w, px, py - w, py + w)) / w**2
                dy = (box(v, px - w, px + w, py, py + w) - box(v, px - w, px + w, py - w, py)) / w**2
                mean = box(v, px - w, px + w, py - w, py + w) / w**2
                middle = mean if k == 0 else middle
                want += [dx * np.cos(a) + dy * np.sin(a), dy * np.cos(a) - dx * np.sin(a)] + ([] if k == 0 else [mean - middle])
        assert np.allclose(vec, np.array(want) / np.linalg.norm(want), atol=1e-9)


def test_a_crowded_tile_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MOST_ASKED", 10)
    v = np.random.default_rng(1).integers(0, 60, (60, 60)).astype(float)
    df = spark.range(200).select(F.lit(0).alias("img"), "id", F.lit(30.0).alias("x"), F.lit(30.0).alias("y"), F.lit(1.5).alias("scale"))
    rows = keypoints.oriented(frame(spark, v), df).collect()
    assert {r.id for r in rows} == set(range(200)) and len({(r.turn, round(r.ori, 9)) for r in rows}) == len({r.turn for r in rows})


def test_corners_of_cells(spark):
    v = np.full((80, 100), 10.0)
    v[20:31, 15:36] = 200.0  # a box: four corners in the first cell
    v[60:70, 60:75] = 120.0
    got = correlation.corners(frame(spark, v, v[:9, :9]), 50, 1.5, 3).collect()
    first = sorted((r.rank, r.x, r.y) for r in got if (r.img, r.cx, r.cy) == (0, 0, 0))
    assert [k for k, _, _ in first] == [1, 2, 3]
    for r in got:
        near = [(15, 20), (35, 20), (15, 30), (35, 30), (60, 60), (74, 60), (60, 69), (74, 69)]
        assert min(max(abs(r.x - a), abs(r.y - b)) for a, b in near) <= 2, r
    assert {(r.cx, r.cy) for r in got} == {(0, 0), (1, 1)}
    wide = correlation.corners(frame(spark, v), 50, 1.5, 9).filter("cx = 0 AND cy = 0").collect()
    assert len(wide) == 4
    assert correlation.corners(frame(spark, v).limit(0), 50, 1.5, 3).count() == 0


def test_response_is_smoothed_products_of_derivatives():
    v = np.random.default_rng(0).uniform(0, 9, (30, 34))
    r = correlation.corner_response(v, 1.0)
    g = np.exp(-np.arange(-3, 4) ** 2 / 2)
    g /= g.sum()
    d = -np.arange(-4, 5) * np.exp(-np.arange(-4, 5) ** 2 / 2)
    d /= -(np.arange(-4, 5) * d).sum()
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k

    def at(f, kx, ky, x, y):
        a, b = len(kx) // 2, len(ky) // 2
        return sum(kx[a + i] * ky[b + j] * f(mirror(x - i, 34), mirror(y - j, 30)) for i in range(-a, a + 1) for j in range(-b, b + 1))

    px = np.array([[at(lambda a, b: v[b, a], d, g, x, y) for x in range(34)] for y in range(30)])
    py = np.array([[at(lambda a, b: v[b, a], g, d, x, y) for x in range(34)] for y in range(30)])
    for x, y in ((0, 0), (17, 11), (33, 29), (5, 28)):
        xx, xy, yy = (at(lambda a, b, p=p: p[b, a], g, g, x, y) for p in (px * px, px * py, py * py))
        assert abs(r[y, x] - (xx * yy - xy * xy - 0.04 * (xx + yy) ** 2)) < 1e-9


def test_planted_shifts_are_found(spark):
    rng = np.random.default_rng(8)
    fine = rng.uniform(0, 255, (40, 50)).repeat(4, 0).repeat(4, 1)
    soft = np.lib.stride_tricks.sliding_window_view(fine, (9, 9)).mean(axis=(2, 3))
    a, b = soft[10:110, 10:130], soft[7:107, 15:135] * 0.5 + 30  # place (x, y) of a is (x - 5, y + 3) of b, with another exposure
    wanted = [(0, k, x, y, 1, x, y) for k, (x, y) in enumerate([(40, 50), (63, 64), (90, 30), (4, 50), (25, 70)])] + [(0, 9, 50, 50, 1, None, 3), (0, 10, 50, 50, 1, 500, 500)]
    df = spark.createDataFrame(wanted, "img int, id int, x int, y int, to int, near_x int, near_y int")
    got = {r.id: r for r in correlation.located(frame(spark, a, b), df, 6, 9, tile=32).collect()}
    assert set(got) == {0, 1, 2, 4}  # one square leaves its image, one has a null, one fits nowhere
    for k in got:
        _, _, x, y, *_ = wanted[k]
        assert (got[k].best_x, got[k].best_y) == (x - 5, y + 3) and got[k].best > 1 - 1e-9
        assert abs(got[k].x2 - x + 5) < 0.1 and abs(got[k].y2 - y - 3) < 0.1 and got[k].bend_x < 0 and got[k].bend_y < 0
    flat = frame(spark, np.full((60, 60), 5.0), np.full((60, 60), 5.0))
    assert [r.best for r in correlation.located(flat, df.filter("id = 0"), 6, 2).collect()] == [0.0]


def test_coefficients_equal_numpys():
    rng = np.random.default_rng(5)
    t, w = rng.uniform(0, 9, (5, 5)), rng.uniform(0, 9, (9, 11))
    r = correlation.coefficients(t, w)
    assert r.shape == (5, 7)
    for j in range(5):
        for i in range(7):
            assert abs(r[j, i] - np.corrcoef(t.ravel(), w[j : j + 5, i : i + 5].ravel())[0, 1]) < 1e-12


def test_squares_are_correlated_together(spark, monkeypatch):
    """Rows of a batch in one array, and in parts of a few rows, find what each row finds by itself."""
    rng = np.random.default_rng(4)
    t, w = rng.integers(0, 9, (6, 3, 5)).astype(float), rng.integers(0, 9, (6, 7, 9)).astype(float)
    w[2, :2], t[3], w[4] = np.nan, 1.0, 5.0
    together = correlation.coefficients(t, w)
    assert together.shape == (6, 5, 5)
    for a, b, c in zip(t, w, together, strict=True):
        assert np.array_equal(correlation.coefficients(a, b), c, equal_nan=True)
    image = rng.integers(0, 50, (40, 45)).astype(float)
    pixels = spark.createDataFrame([(k, x, y, float(image[y, x])) for k in (0, 1) for y in range(40) for x in range(45)], "img long, x long, y long, v double")
    asked = spark.createDataFrame([(0, n, int(x), int(y), 1, int(x + dx), int(y + dy)) for n, (x, y, dx, dy) in enumerate(zip(rng.integers(0, 45, 60), rng.integers(0, 40, 60), rng.integers(-2, 3, 60), rng.integers(-2, 3, 60), strict=True))], "img long, id long, x long, y long, to long, near_x long, near_y long").coalesce(1)
    whole = sorted(correlation.located(pixels, asked, 2, 2, tile=16).collect())
    assert len(whole) > 30 and all(abs(r.best - 1) < 1e-9 for r in whole if r.best_x is not None and 4 <= r.best_x < 41 and 4 <= r.best_y < 36)
    monkeypatch.setattr(correlation, "HELD", 500)
    assert sorted(correlation.located(pixels, asked, 2, 2, tile=16).collect()) == whole
