import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import photometry as P
from tessera.functions import scalar as S
from tessera.functions.expression import ExpressionError, apply_expression, compile_expression
from tessera.operators import coverage, edits
from tessera.session import spread


def value(spark, expr, **names):
    df = spark.createDataFrame([tuple(map(float, names.values()))], ", ".join(f"{k} double" for k in names)) if names else spark.range(1)
    return df.select(compile_expression(expr, {k: F.col(k) for k in names}).alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("-2^2", 4.0), ("2^3^2", 512.0), ("1 + 2*3", 7.0), ("7 % 3", 1.0), ("-7 % 3", -1.0), ("1/0", None), ("log(-1)", None), ("sqrt(16)+ABS(-2)", 6.0), ("1?2:3", 2.0), ("0 ? 1 : 1e-9 ? 2 : 3", 3.0), ("1 ? 2 : 1/0", None), ("2>1 && 1>2 || 1", 1.0), ("deg(pi)", 180.0), ("1e300*1e300", None)])
def test_expression_values(spark, text, want):
    got = value(spark, text)
    assert got == want if want is None else math.isclose(got, want)


@pytest.mark.parametrize("text", ["--1", "1+", "(1", "1)", "foo", "1?2", "2 $ 3", ""])
def test_expression_errors(text):
    with pytest.raises(ExpressionError):
        compile_expression(text, {})


def test_expression_falls_back_to_the_value(spark):
    df = spark.createDataFrame([(4.0, 2), (5.0, 0)], "val double, i int")
    assert [r.v for r in df.select(apply_expression("val / i", F.col("val"), {"i": F.col("i")}).alias("v")).collect()] == [2.0, 5.0]


def test_transforms_have_inverses(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-80, 80), rng.uniform(-60, 60)) for _ in range(40)] + [(0.0, 0.0)]
    df = spark.createDataFrame(points, "x double, y double")
    d = 120.0
    pairs = [(G.rect_to_erect(d), G.erect_to_rect(d)), (G.pano_to_erect(d), G.erect_to_pano(d)), (G.sphere_to_erect(d), G.erect_to_sphere(d)), (G.erect_to_mercator(d), G.mercator_to_erect(d)), (G.erect_to_transverse_mercator(d), G.transverse_mercator_to_erect(d)), (G.erect_to_sinusoidal(d), G.sinusoidal_to_erect(d)), (G.erect_to_stereographic(d), G.stereographic_to_erect(d)), (G.radial((0.98, 0.01, 0.0, -0.01), 100.0), G.undo_radial((0.98, 0.01, 0.0, -0.01), 100.0))]
    columns = [c.alias(f"{k}{a}") for k, (there, back) in enumerate(pairs) for c, a in zip(G.chain((F.col("x"), F.col("y")), there, back), "xy", strict=True)]
    for (x, y), r in zip(points, df.select(*columns).collect(), strict=True):
        for k in range(len(pairs)):
            assert math.isclose(r[2 * k], x, abs_tol=1e-6) and math.isclose(r[2 * k + 1], y, abs_tol=1e-6), k


def test_polygon_and_circle_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (3.0, 4.0)], "x double, y double")
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    x, y = F.col("x"), F.col("y")
    rows = df.select(G.in_polygon(x, y, square), G.in_polygon(x, y, square[::-1]), G.in_polygon(x, y, square, True), G.in_polygon(x, y, square[:2]), G.in_circle(x, y, 0.0, 0.0, 5.0)).collect()
    assert [tuple(r) for r in rows] == [(True, True, False, False, True), (False, False, True, False, False), (False, False, True, False, False)]


def test_lens_names_dates_and_order(spark):
    df = spark.createDataFrame([("", "ACME", "X1"), ("L", "ACME", "X1"), (None, None, "X1")], "lens string, make string, model string")
    assert [r[0] for r in df.select(S.lens_name(F.col("lens"), F.col("make"), F.col("model"))).collect()] == ["ACME|X1", "L", ""]
    names = spark.createDataFrame([(n,) for n in ("a10", "a2", "b", "a", "1a", "a02b")], "n string")
    assert [r.n for r in names.orderBy(S.natural_key(F.col("n")), "n").collect()] == ["1a", "a", "a2", "a02b", "a10", "b"]
    assert [r[0] is None for r in spark.createDataFrame([("2020:01:02 03:04:05",), ("x",)], "t string").select(S.photo_time(F.col("t"))).collect()] == [False, True]
    focal = spark.createDataFrame([(20.0,)], "f double")
    for name in S.LENSES:
        assert math.isclose(focal.select(S.focal(S.hfov(F.col("f"), 36.0, name), 36.0, name)).first()[0], 20.0, rel_tol=1e-9)


def test_range_rules(spark):
    df = spark.createDataFrame([(20.0, 30.0), (26.0, 30.0), (30.0, 40.0)], "a double, b double")
    assert [r[0] for r in df.select(S.in_range(F.col("a"), F.col("b"), 25.0, 0.15)).collect()] == [True, True, False]
    one = spark.createDataFrame([(40.0,), (43.0,)], "a double")
    assert [tuple(r) for r in one.select(S.near_single(F.col("a"), 40.0), S.near_single(F.col("a"), 40.0, True)).collect()] == [(True, True), (True, False)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inverse_tables_compute_a_value_once(spark):
    seen = P.look_up(P.gamma_table(0.5, 16), F.col("v"))
    df = spark.range(5).select((F.col("id") / 5).alias("v")).cache()
    plan = _plan(df.select(P.invert_table(P.gamma_table(0.5, 16), seen).alias("t")))
    assert plan.count("least(greatest(v#") == 1 and "POWER" not in plan


def test_resized_tables_compute_the_table_once(spark):
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pow(k / 4, F.col("g")))
    df = spark.range(5).select((F.col("id") / 5).alias("g")).cache()
    assert _plan(df.select(P.resize_table(five, 9).alias("t"))).count("POWER") == 1


def test_undone_radial_computes_its_target_once(spark):
    df = spark.range(5).select((F.col("id") / 5).alias("v")).cache()
    assert _plan(df.select(G.undo_radial((1.01, 0.0, -0.03, 0.002), 150.0)((F.col("v"), F.lit(1.0)))[0].alias("x"))).count("SQRT") == 1


def test_few_files_are_spread_over_the_cores(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 9)
    assert spread(many) is many


def test_clipped_masks_are_cut_once(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    v = F.col("v")
    rows = spark.range(5).select("id", (F.col("id") * 10.0).alias("v")).cache()
    masks = rows.select("id", F.array(corner(0.0, 0 * v), corner(9.0, 0 * v), corner(9.0, v), corner(0.0, v)).alias("poly"))
    cut = edits.clip_masks(masks, F.lit(5.0), F.lit(10.0), F.lit(30.0), F.lit(35.0))
    got = cut.select("id", F.abs(coverage.polygon_area(F.col("poly"))).alias("area")).filter("area > 0.001")
    assert _plan(got).count("30.0") == _plan(cut).count("30.0")
    assert {r.id: r.area for r in got.collect()} == {2: 40.0, 3: 80.0, 4: 100.0}
