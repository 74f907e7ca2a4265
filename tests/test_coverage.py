import math
import random

from pyspark.sql import functions as F

from tessera.operators import coverage as C
from tessera.operators import matching


def test_overlap_is_directional_then_symmetric(spark):
    rows = [(0, 0.0, 0.0, 100.0, 100.0), (1, 50.0, 0.0, 250.0, 100.0), (2, 900.0, 900.0, 950.0, 950.0)]
    images = spark.createDataFrame(rows, "img_nr int, left double, top double, right double, bottom double")
    ratios = C.overlap_ratios(images, 10, 64.0)
    assert {(r.i, r.j): round(r.ratio, 6) for r in ratios.collect()} == {(0, 1): 0.5, (1, 0): 0.2}
    assert [tuple(r) for r in C.symmetric_overlap(ratios).collect()] == [(0, 1, 0.5)]
    point = C.shared_point(images, spark.createDataFrame([(0, 1), (0, 2)], "i int, j int")).collect()
    assert [tuple(r) for r in point] == [(0, 1, 50.0, 50.0)]


def test_two_nearest_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(0, 9) / 1.0 for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.q: (r.t, r.d1, r.d2) for r in matching.two_nearest(df.filter("id < 80"), df.filter("id >= 80"), block=30).collect()}
    for i, v in rows[:80]:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in rows[80:])
        assert got[i] == (d[0][1], d[0][0], d[1][0])
    assert matching.two_nearest(df, df.limit(0)).count() == 0


def test_masks_spread_and_gaps(spark):
    masks = spark.createDataFrame([(0, "m"), (1, "m")], "img_nr int, mask string")
    parts = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (3, 8)], "img_nr int, part int")
    assert sorted(tuple(r) for r in C.spread_masks(masks, parts).select("img_nr", "mask").collect()) == [(0, "m"), (1, "m"), (2, "m")]
    columns = spark.createDataFrame([(c,) for c in (0, 1, 2, 10, 350)], "c int")
    assert tuple(C.widest_gap(columns, "c", 360).first()) == (11, 339)
    assert C.widest_gap(spark.range(360), "id", 360).count() == 0


def test_tables_and_polygons(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 5.0],)], "t array<double>")
    assert df.select(C.monotone(F.col("t"))).first()[0] == [1.0, 3.0, 3.0, 5.0]
    poly = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],)], "p array<struct<x: double, y: double>>")
    area, more = poly.select(C.polygon_area(F.col("p")), C.resample_polygon(F.col("p"), 1.5)).first()
    assert area == 8.0 and len(more) == 3 + 2 + 3 + 2 and math.isclose(more[1].x, 4 / 3)


def test_threshold_ties_go_to_the_last(spark):
    w = spark.createDataFrame([(0, 0, 0, 0.1), (1, 0, 0, 0.1), (0, 1, 0, 0.9), (1, 1, 0, 0.2)], "img int, x int, y int, weight double")
    assert {(r.img, r.x) for r in C.threshold_masks(w, 0.5).filter("keep").collect()} == {(1, 0), (0, 1)}
