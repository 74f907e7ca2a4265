import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import geometric, least_squares, photometric


def camera_pairs(rng, groups, images, n, curves=None, planted=None):
    """Pairs of pixels of planted cameras; planted[g][i] is a row of the parameters."""
    rows = []
    for g in range(groups):
        for _ in range(n):
            i, j = rng.choice(images, 2, replace=False)
            at = rng.uniform(-0.7, 0.7, 4)
            light = rng.uniform(0.1, 0.8 if curves is None else 0.35, 3)
            seen = []
            for k, im in enumerate((i, j)):
                f = photometric._light(planted[g][im][None], at[2 * k : 2 * k + 1], at[2 * k + 1 : 2 * k + 2])[0]
                v = light * f
                if curves is not None:
                    table = np.maximum.accumulate(curves[0] + planted[g][im][9 : 8 + len(curves)] @ curves[1:])
                    v = np.interp(v, np.linspace(0, 1, len(table)), table)
                seen += v.tolist()
            rows.append((g, int(i), int(j), *at.tolist(), *seen))
    return rows


PAIRS = "group int, i int, j int, x1 double, y1 double, x2 double, y2 double, r1 double, g1 double, b1 double, r2 double, g2 double, b2 double"


def planted_cameras(rng, groups, images, response=0):
    out = np.tile(np.array([photometric.PARAMETERS[n] for n in photometric.NAMES]), (groups, images, 1))
    for g in range(groups):
        out[g, 1:, 0] = rng.uniform(-0.6, 0.6, images - 1)
        out[g, 1:, 1:3] = rng.uniform(0.8, 1.25, (images - 1, 2))
        out[g, :, 4] = -0.2 - 0.05 * g
        out[g, :, 5] = 0.06
        if response:
            out[g, :, 9 : 9 + response] = rng.uniform(-0.3, 0.3, response)
    return out


def frames(spark, rng, planted, n, curves=None, outliers=0):
    groups, images = planted.shape[:2]
    rows = camera_pairs(rng, groups, images, n, curves, planted)
    rows = [(*r[:7], 0.9, 0.1, 0.9, 0.1, 0.9, 0.1) if k < outliers else r for k, r in enumerate(rows)]
    pairs = spark.createDataFrame(rows, PAIRS)
    cameras = spark.createDataFrame([(g, i, i, 0) for g in range(groups) for i in range(images)], "group int, img int, stack int, lens int")
    return pairs, cameras


def chosen(*, response=0):
    own = F.when(F.col("img") > 0, F.col("img"))
    out = dict.fromkeys(("Eev", "Er", "Eb"), own) | dict.fromkeys(("Vb", "Vc"), F.col("lens"))
    return out | dict.fromkeys(photometric.RESPONSE[:response], F.col("lens"))


def check(found, planted, names, near):
    rows = found.collect()
    assert len(rows) == planted.shape[0] * planted.shape[1]
    for r in rows:
        for n in names:
            assert abs(r[n] - planted[r.group, r.img, photometric.NAMES.index(n)]) < near, (r.group, r.img, n, r[n])


def test_photometric_fit_recovers_planted_cameras(spark):
    rng = np.random.default_rng(1)
    planted = planted_cameras(rng, 3, 4)
    pairs, cameras = frames(spark, rng, planted, 200, outliers=15)
    found, fits = photometric.fit(pairs, cameras, chosen())
    values = {(r.group, r.img): r for r in found.collect()}
    for (g, i), r in values.items():
        for n in ("Eev", "Er", "Eb", "Vb", "Vc"):
            # the first group holds pairs that fit no camera: Huber's rule bounds what they do
            assert abs(r[n] - planted[g, i, photometric.NAMES.index(n)]) < (1e-3 if g else 0.08), (g, i, n)
    errors = {r.group: r for r in fits.collect()}
    assert errors[1].error < 1e-6 and errors[0].error > 0.05 and errors[1].cost < errors[1].start_cost and errors[1].n == 200


def test_response_is_recovered(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(0, 1, 64)
    curves = np.stack([x**0.6, x * (1 - x), x * x * (1 - x)])
    planted = planted_cameras(rng, 1, 3, response=2)
    planted[:, :, 4:6] = 0
    pairs, cameras = frames(spark, rng, planted, 400, curves)
    own = F.when(F.col("img") > 0, F.col("img"))
    # exposure and response trade off, so exposures are given here
    fixed = cameras.join(spark.createDataFrame([(i, float(planted[0, i, 0])) for i in range(3)], "img int, Eev double"), "img")
    found, _ = photometric.fit(pairs, fixed, dict.fromkeys(("Er", "Eb"), own) | dict.fromkeys(("Ra", "Rb"), F.col("lens")), curves)
    check(found, planted, ("Eev", "Er", "Eb", "Ra", "Rb"), 1e-3)


def test_falling_response_costs():
    x = np.linspace(0, 1, 11)
    curves = np.stack([x, -3 * x * (1 - x)])
    p = np.zeros((2, 14))
    p[1, 9] = 1.0
    table = curves[0] + curves[1]
    want = sum((a - b) ** 2 for a, b in zip(table, table[1:], strict=False) if a > b) * 11
    got = photometric.FallingResponse(curves)(p, p, {})[:, 0]
    assert got[0] == 0 and abs(got[1] - want) < 1e-12 and want > 0


def test_smart_fit_takes_back_what_is_implausible(spark):
    rng = np.random.default_rng(3)
    planted = planted_cameras(rng, 3, 4)
    planted[0, :, 4:6] = 0
    planted[1, :, 4] = -0.5  # a corner keeps half its light
    planted[2, 1, 1] = 4.0  # too strong a balance
    planted[2, :, 4:6] = 0
    pairs, cameras = frames(spark, rng, planted, 200)
    found = {(r.group, r.img): r for r in photometric.smart_fit(pairs, cameras, True).collect()}
    assert len(found) == 12
    assert found[0, 0].stages == "exposure vignetting balance" and abs(found[0, 2].Er - planted[0, 2, 1]) < 1e-3
    assert found[1, 0].stages == "exposure balance" and found[1, 1].Vb == 0
    assert found[2, 0].stages == "exposure vignetting" and found[2, 1].Er == 1


def test_normal_sums_against_numpy(spark):
    rng = np.random.default_rng(4)
    planted = planted_cameras(rng, 2, 3)
    pairs, cameras = frames(spark, rng, planted, 50)
    slots, variables = least_squares.numbered(photometric.variables(cameras, {"Eev": F.col("img"), "Vb": F.col("lens")}))
    names = {(r.group, r.variable): r.number for r in variables.collect()}
    state = variables.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "value"))), lambda s: s.value).alias("x"))
    of = photometric.PairResiduals(None)
    got = {(r.group, r.p, r.q): r.v for r in least_squares.normal_sums([(pairs, of)], slots, state).collect()}
    rows = pairs.collect()
    for g in range(2):
        m = 4
        jj, jr, rr, n = np.zeros((m, m)), np.zeros(m), 0.0, 0
        for r in (r for r in rows if r.group == g):
            data = {c: np.array([r[c]]) for c in pairs.columns[3:]}

            def at(x, r=r, data=data, g=g):
                p, q = (np.array([[photometric.PARAMETERS[c] for c in photometric.NAMES]]) for _ in range(2))
                for a, i in ((p, r.i), (q, r.j)):
                    a[0, 0], a[0, 4] = x[names[g, f"Eev|{i}"]], x[names[g, "Vb|0"]]
                return of(p, q, data)[0]

            h = 1e-6
            j = np.column_stack([(at(np.eye(m)[k] * h) - at(-np.eye(m)[k] * h)) / (2 * h) for k in range(m)])
            e = at(np.zeros(m))
            jj, jr, rr, n = jj + j.T @ j, jr + j.T @ e, rr + e @ e, n + 1
        assert all(abs(got.get((g, a, b), 0) - jj[a, b]) < 1e-4 * np.abs(jj).max() for a in range(m) for b in range(m))
        assert all(abs(got[g, a, -1] - jr[a]) < 1e-4 * np.abs(jr).max() for a in range(m))
        assert abs(got[g, -1, -1] - rr) < 1e-8 and got[g, -2, -2] == n == 50


def test_groups_without_variables_or_observations(spark):
    rng = np.random.default_rng(5)
    planted = planted_cameras(rng, 2, 3)
    pairs, cameras = frames(spark, rng, planted, 30)
    found, fits = photometric.fit(pairs.filter("group = 1"), cameras, {"Eev": F.when((F.col("group") == 0) & (F.col("img") > 0), F.col("img"))})
    assert all(r.Eev == 0 for r in found.collect()) and found.count() == 6
    costs = {r.group: r.cost for r in fits.collect()}
    assert costs[0] is None and costs[1] > 0


@pytest.mark.parametrize("kind", [0, 1, 2, 4])
def test_directions_agree_with_the_projection_columns(spark, kind):
    rng = np.random.default_rng(kind)
    rows = [(float(rng.uniform(-170, 170)), float(rng.uniform(-60, 60)), float(rng.uniform(-40, 40)), float(rng.uniform(40, 90)), float(rng.uniform(-300, 300)), float(rng.uniform(-200, 200))) for _ in range(40)]
    df = spark.createDataFrame(rows, "yaw double, pitch double, roll double, hfov double, x double, y double")
    image = {"projection": F.lit(kind), "hfov": F.col("hfov"), "width": F.lit(1000.0), "yaw": F.col("yaw"), "pitch": F.col("pitch"), "roll": F.col("roll")}
    px, py = G.image_to_panorama((F.col("x"), F.col("y")), image, 360.0, 360.0)
    got = df.select("*", px.alias("lon"), py.alias("lat")).collect()
    p = np.array([[r.yaw, r.pitch, r.roll, r.hfov, 0, 0, 0, 0, 0, 1000, 800, kind] for r in got])
    d = geometric.directions(p, np.array([r.x for r in got]), np.array([r.y for r in got]))
    lon, lat = np.radians([r.lon for r in got]), np.radians([r.lat for r in got])
    want = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    assert np.abs(d - want).max() < 1e-6


def ring(rng, images=6, points=30, lens=(0.0, 0.0, 0.0)):
    """Images around the horizon, and points that neighbours share."""
    rows = [(i * 60.0 if i < 4 else i * 60.0 - 360, float(rng.uniform(-4, 4)) if i else 0.0, float(rng.uniform(-4, 4)) if i else 0.0) for i in range(images)]
    p = np.array([[y, q, r, 90.0, *lens, 0, 0, 1000, 800, 0] for y, q, r in rows])
    out = []
    for i in range(images):
        j, n = (i + 1) % images, 0
        while n < points:
            x, y = rng.uniform(-480, 480), rng.uniform(-380, 380)
            d = geometric.directions(p[i : i + 1], np.array([x]), np.array([y]))[0]
            place = project(p[j], d)
            if place is not None:
                out.append((0, len(out), i, j, float(x), float(y), *map(float, place), 0))
                n += 1
    return rows, out


def project(p, d):
    """Where a direction falls in a rectilinear image, by search over the plain camera (its radial polynomial included)."""
    y, q, r = np.radians(p[:3])
    rz = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    ry = np.array([[math.cos(q), 0, math.sin(q)], [0, 1, 0], [-math.sin(q), 0, math.cos(q)]])
    rx = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    v = (rz @ ry @ rx).T @ d
    if v[0] <= 0.55:
        return None
    f = p[9] / 2 / math.tan(math.radians(p[3]) / 2)
    x, z = v[1] / v[0] * f, v[2] / v[0] * f
    t = math.hypot(x, z) / 400
    a, b, c = p[4:7]
    k = a * t**3 + b * t**2 + c * t + 1 - a - b - c
    x, z = x * k, z * k
    return (x, z) if abs(x) < 500 and abs(z) < 400 else None


POINTS = "group int, id int, i int, j int, x1 double, y1 double, x2 double, y2 double, mode int"


def ring_images(spark, rows, start=True, v=90.0):
    turn = (lambda y: y) if not start else (lambda y: y + 3.0)
    out = [(0, i, 0, 1000.0, 800.0, 0, v, turn(y) if i else y, 0.0 if start else p, 0.0 if start else r) for i, (y, p, r) in enumerate(rows)]
    return spark.createDataFrame(out, "group int, img int, lens int, width double, height double, projection int, v double, y double, p double, r double")


def test_place_and_fit_recover_planted_angles(spark):
    rows, points = ring(np.random.default_rng(7))
    df = spark.createDataFrame(points, POINTS)
    fitted, fits = geometric.fit_all(df, ring_images(spark, rows, v=86.0), view=True)
    fitted = {r.img: r for r in fitted.collect()}
    for i, (y, p, r) in enumerate(rows):
        assert abs((fitted[i].y - y + 180) % 360 - 180) < 1e-3 and abs(fitted[i].p - p) < 1e-3 and abs(fitted[i].v - 90) < 1e-3
    assert fits.first().error < 1e-4


def test_radial_terms_are_recovered(spark):
    rows, points = ring(np.random.default_rng(8), lens=(0.0, -0.03, 0.01))
    df, images = spark.createDataFrame(points, POINTS), ring_images(spark, rows)
    free = F.when(F.col("img") > 0, F.col("img"))
    fitted, _ = geometric.optimise(df, images, dict.fromkeys(("y", "p", "r"), free) | dict.fromkeys(("b", "c"), F.col("lens")))
    r = fitted.filter("img = 3").first()
    assert abs(r.b + 0.03) < 1e-3 and abs(r.c - 0.01) < 1e-3


def fitted_errors(rows, points, i, j):
    start = lambda k: np.array([rows[k][0] + (3.0 if k else 0.0), 0.0, 0.0, 90, 0, 0, 0, 0, 0, 1000, 800, 0])
    data = {n: np.array([p[4 + k] for p in points], float) for k, n in enumerate(geometric.DATA)}
    x, damping = start(j), 1e-3

    def of(x):
        return geometric.residuals(np.tile(start(i), (len(points), 1)), np.tile(x, (len(points), 1)), data)

    for _ in range(100):
        r = of(x).ravel()
        jac = np.column_stack([(of(x + 1e-5 * np.eye(12)[k]) - of(x - 1e-5 * np.eye(12)[k])).ravel() / 2e-5 for k in range(3)])
        step = np.zeros(12)
        step[:3] = np.linalg.solve(jac.T @ jac + damping * np.eye(3), -jac.T @ r)
        if (of(x + step) ** 2).sum() < (r * r).sum():
            x, damping = x + step, damping / 5
        else:
            damping *= 5
    return np.linalg.norm(of(x), axis=1)


def test_clean_by_pair(spark):
    rows, points = ring(np.random.default_rng(9))
    bad = {p[1] for p in points if p[1] % 25 == 3}
    moved = [(*p[:6], p[6] + 90, *p[7:]) if p[1] in bad else p for p in points]
    moved = [(p[0], p[1], p[3], p[2], p[6], p[7], p[4], p[5], p[8]) if p[1] % 2 else p for p in moved]  # some the other way round
    extra = [(0, 900, 0, 3, 1.0, 1.0, 2.0, 2.0, 0), (0, 901, 1, 2, 400.0, 1.0, -400.0, 300.0, 1)]  # a pair with one point, and a line's point
    want = {}
    for i in range(6):
        for j in range(i + 1, 6):
            some = [p if p[2] < p[3] else (p[0], p[1], p[3], p[2], p[6], p[7], p[4], p[5], p[8]) for p in moved + extra if {p[2], p[3]} == {i, j} and p[8] == 0]
            if len(some) > 1:
                e = fitted_errors(rows, some, i, j)
                limit = e.mean() if e.std(ddof=1) > e.mean() else e.mean() + 2 * e.std(ddof=1)
                want[i, j] = {p[1] for p, x in zip(some, e, strict=True) if x > limit}
    df, images = spark.createDataFrame(moved + extra, POINTS), ring_images(spark, rows)
    assert bad <= set().union(*want.values()) and len(want) == 6
    assert {r.id for r in geometric.clean_by_pair(df, images).collect()} == set().union(*want.values())
    linked = spark.createDataFrame([(0, 1, 0)], "group int, a int, b int")
    assert {r.id for r in geometric.clean_by_pair(df, images, linked=linked).collect()} == set().union(*(w for k, w in want.items() if k != (0, 1)))
    errors = geometric.point_errors(df, ring_images(spark, rows, start=False))
    assert errors.filter("error > 1e-6 AND mode = 0").count() == len(bad) + 1 and errors.columns == ["group", "i", "j", "id", "x1", "y1", "x2", "y2", "mode", "error"]


def test_slopes_equal_differences():
    rng = np.random.default_rng(8)
    n, width = 50, len(photometric.NAMES)
    data = {c: rng.uniform(-0.7, 0.7, n) for c in ("x1", "y1", "x2", "y2")} | {f"{c}{k}": rng.uniform(0, 1, n) for c in "rgb" for k in (1, 2)}
    p, q = (np.array([list(photometric.PARAMETERS.values())]) + rng.uniform(-0.1, 0.1, (1, width)) for _ in range(2))
    of, used = photometric.PairResiduals(None), np.arange(2 * width)
    r, j = of.slopes(p, q, data, used)
    plain, differences = least_squares._derivatives(lambda *a: of(*a), p, q, data, used, n)
    assert np.allclose(r, plain) and np.allclose(j, differences, atol=1e-6)


def test_packs_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(least_squares, "PACK", 8)
    rows = [(f"g{k % 3}", k % 2, k % 5, float(k), k if k % 7 else None) for k in range(300)]
    packs = least_squares.packed(spark.createDataFrame([*rows, (None, 1, 1, 0.0, 0)], "group string, i int, j int, v double, w long").coalesce(1))
    got = []
    for r in packs.rows.collect():
        v, w = np.frombuffer(r._data).reshape(2, r._n)
        assert r._n <= least_squares.PACK
        got += [(r.group, r.i, r.j, a, None if np.isnan(b) else int(b)) for a, b in zip(v, w, strict=True)]
    assert packs.names == ["v", "w"] and sorted(got, key=lambda r: r[3]) == rows


def test_a_round_over_few_items_is_one_query(spark, monkeypatch):
    """The driver makes the steps of few variables: as over tables, in at most three jobs a round."""
    planted = planted_cameras(np.random.default_rng(8), 2, 3)
    pairs, cameras = frames(spark, np.random.default_rng(8), planted, 200)
    packs, slots = least_squares.kept(pairs), photometric.variables(cameras, chosen())
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def run(name):
        context.setJobGroup(name, name)
        found, ended = least_squares.minimise([(packs, photometric.PairResiduals(None))], slots)
        values = {(r.group, r.item, r.slot): r.value for r in found.collect()}
        rounds = {r.group: r.rounds for r in ended.collect()}
        return values, rounds, len(tracker.getJobIdsForGroup(name))

    here, rounds, jobs = run("few-items")
    monkeypatch.setattr(least_squares, "LOCAL_ITEMS", 0, raising=False)
    there, rounds_there, _ = run("many-items")
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-8 for k in here)
    assert rounds.keys() == rounds_there.keys()
    assert jobs <= 3 * max(rounds.values()) + 20


def test_points_of_two_images_are_reduced_to_six_rows(spark):
    """However many points two images share, a round of the fit reads six rows; their sums of squares are the points' own, wherever the cameras are turned to."""
    rng = np.random.default_rng(9)
    rows = [("g", int(i), int(i) + 1, *(float(c) for c in rng.uniform(-400, 400, 4)), 0) for i in rng.integers(0, 2, 5000)]
    rows += [("g", 2, 9, 1.0, 2.0, 3.0, 4.0, 0)]  # there is no image 9
    points = spark.createDataFrame(rows, "group string, i int, j int, x1 double, y1 double, x2 double, y2 double, mode int").repartition(7)
    images = spark.createDataFrame([("g", k, 1000.0, 800.0, k % 2, 10.0 * k, 0.0, 0.0, 60.0 + k) for k in range(3)], "group string, img int, width double, height double, projection int, y double, p double, r double, v double")
    got = {(r.i, r.j): r for r in geometric.reduced(points, images).collect()}
    assert sorted(got) == [(0, 1), (1, 2), (2, 9)] and got[2, 9]["_data"] is None and got[2, 9]["_count"] == 1
    for i in (0, 1):
        mine = np.array([r[3:7] for r in rows if r[1] == i])
        r = got[i, i + 1]
        assert r["_n"] == 6 and r["_count"] == len(mine)
        few = dict(zip(geometric.REDUCED, np.frombuffer(r["_data"]).reshape(7, 6), strict=True))
        many = dict(zip(("x1", "y1", "x2", "y2"), mine.T, strict=True)) | {"mode": np.zeros(len(mine))}
        for turn in rng.uniform(-90, 90, (5, 2, 3)):
            p, q = (np.array([[*t, 60.0 + k, 0, 0, 0, 0, 0, 1000, 800, k % 2]]) for t, k in zip(turn, (i, i + 1), strict=True))
            assert (geometric.ray_residuals(p, q, few) ** 2).sum() == pytest.approx((geometric.residuals(p, q, many) ** 2).sum(), rel=1e-12)
        assert few[geometric.STANDS_FOR].sum() == len(mine)
