import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.plans import solving


def picture(rng, h=40, w=50):
    v, m = rng.uniform(0, 255, (h, w)), rng.random((h, w)) > 0.1
    m[:, 20:24] = False
    return v, m


def frame(spark, v, m, img=0):
    h, w = v.shape
    return spark.createDataFrame([(img, x, y, v[y, x].item(), int(m[y, x]) * 255) for y in range(h) for x in range(w) if m[y, x] or x % 2], "img int, x int, y int, v double, m int")


def plain(v, m, kernel, sx, sy, wide):
    """One value, tap by tap."""
    n, (h, w) = raster.taps(kernel), v.shape
    bx, by = int(np.floor(sx)), int(np.floor(sy))
    wx, wy = raster.weights(kernel, np.array([sx - bx]))[0], raster.weights(kernel, np.array([sy - by]))[0]
    total = value = 0.0
    for j in range(n):
        for i in range(n):
            x, y = bx + 1 + i - n // 2, by + 1 + j - n // 2
            x = x % w if wide else x
            if 0 <= x < w and 0 <= y < h and m[y, x]:
                total += wx[i] * wy[j]
                value += wx[i] * wy[j] * v[y, x]
    return value / total if total > 0.2 else None


@pytest.mark.parametrize("kernel", raster.KERNELS)
@pytest.mark.parametrize("wide", [False, True])
def test_remap_against_taps(spark, kernel, wide):
    rng = np.random.default_rng(len(kernel))
    v, m = picture(rng)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-6, 56, 80), rng.uniform(-6, 46, 80), strict=True))] + [(80, 10.0, 10.0), (81, 400.0, 3.0), (82, 48.5, 3.5)]
    df = spark.createDataFrame([(0, *p) for p in places], "img int, id int, sx double, sy double")
    found = {r.id: r.v for r in raster.remap(frame(spark, v, m), df, kernel, F.lit(50) if wide else None, tile=16).collect()}
    assert len(found) == len(places)
    for k, x, y in places:
        want = plain(v, m, kernel, x, y, wide)
        assert (found[k] is None) == (want is None) and (want is None or abs(found[k] - want) < 1e-7), (kernel, x, y)
    if kernel not in ("nearest",) and m[10, 10]:
        assert abs(found[80] - v[10, 10]) < 1e-9


def test_weights_add_up():
    x = np.linspace(0, 0.999, 50)
    for kernel in raster.KERNELS:
        w = raster.weights(kernel, x)
        assert w.shape == (50, raster.taps(kernel)) and np.abs(w.sum(axis=1) - 1).max() < (0.02 if kernel in raster.SINCS else 1e-9)


def dense_reduce(v):
    h, w = v.shape
    out = np.zeros((-(-h // 2), -(-w // 2)))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            total = value = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    if 0 <= 2 * y + dy < h and 0 <= 2 * x + dx < w:
                        k = (1, 4, 6, 4, 1)[dx + 2] * (1, 4, 6, 4, 1)[dy + 2]
                        total, value = total + k, value + k * v[2 * y + dy, 2 * x + dx]
            out[y, x] = value / total
    return out


def test_pyramid_and_bands(spark):
    v, _ = picture(np.random.default_rng(2), 13, 18)
    df = frame(spark, v, np.ones_like(v, bool))
    one = dense_reduce(v)
    two = dense_reduce(one)
    found = {(r.level, r.x, r.y): r.v for r in raster.pyramid(df, 2).collect()}
    inside = {(k, x, y): f[y, x] for k, f in enumerate((v, one, two)) for y in range(f.shape[0]) for x in range(f.shape[1])}
    assert all(abs(found[p] - x) < 1e-9 for p, x in inside.items())
    back = {(r.x, r.y): r.v for r in raster.collapsed(raster.bands(df, 2), 2).collect()}
    assert all(abs(back[x, y] - v[y, x]) < 1e-9 for y in range(13) for x in range(18)) and len(back) == v.size
    flat = {(r.x, r.y): r.v for r in raster.expanded(raster.reduced(df.withColumn("v", F.lit(7.0))), df).collect()}
    assert len(flat) == v.size and all(abs(x - 7) < 1e-9 for x in flat.values())


def test_multiband(spark):
    v, _ = picture(np.random.default_rng(3), 16, 24)
    ones = np.ones_like(v, bool)
    both = frame(spark, v, ones, 0).unionByName(frame(spark, v + 50, ones, 1))
    weight = both.select("img", "x", "y", ((F.col("x") < 12) == (F.col("img") == 0)).cast("double").alias("v"))
    found = {(r.x, r.y): r.v for r in raster.multiband(both, weight, 2).collect()}
    assert len(found) == v.size
    step = np.array([[found[x, y] - v[y, x] for x in range(24)] for y in range(16)]).mean(axis=0)
    assert abs(step[0]) < 1 and abs(step[-1] - 50) < 1 and np.all(np.diff(step) > -1e-6) and np.diff(step).max() < 30


def test_remap_query_has_the_places_of_its_sql(spark, tmp_path):
    """1.7 is a decimal in SQL: a place that is off by a bit may lose a fifth of its weight to rounding."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT a AS p_partkey, a % 50 + 1 AS p_size, 900.0 + a / 7 AS p_retailprice FROM range(500) t(a)) TO '{tmp_path}/part.parquet'")
    want = con.execute(f"SELECT p_partkey, p_retailprice / 20 - 5, p_size * 1.7 + p_retailprice % 1 - 4 FROM '{tmp_path}/part.parquet'").fetchall()
    assert sorted((r.id, r.sx, r.sy) for r in solving._remap_places(spark, str(tmp_path)).collect()) == sorted(want)
