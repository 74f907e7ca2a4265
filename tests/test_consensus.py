import numpy as np
import pytest

from tessera.operators import consensus as C
from tessera.operators import estimation


def line_rows(rng, n=400):
    """Three groups of points on a line, with outliers; one of two points, one of one, and one without a line."""
    out = []
    for g in range(3):
        x = rng.uniform(-50, 50, n)
        y = (g + 1) * x - 3 * g + rng.normal(0, 0.05, n)
        y[: n // 3] = rng.uniform(-200, 200, n // 3)
        out += [(g, "a", int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return out + [(3, "a", 0, 0.0, 1.0), (3, "a", 1, 1.0, 3.0), (4, "a", 0, 1.0, 1.0), (5, "b", 0, 2.0, 1.0), (5, "b", 1, 2.0, 5.0)]


def test_both_ways_find_the_same_lines(spark, monkeypatch):
    rows = line_rows(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "g int, h string, id int, x double, y double").repartition(5)
    got = []
    for local, block in ((20_000, 4096), (50, 64), (1, 1000)):
        monkeypatch.setattr(C, "LOCAL", local)
        monkeypatch.setattr(C, "BLOCK", block)
        found = C.consensus(df, ["g", "h"], "id", C.Line(), 0.3, 60)
        got.append({(r.g, r.h): (r.solution, r.inliers, r.n) for r in found.collect()})
    assert got[0] == got[1] == got[2] and {k[0] for k in got[0]} == {0, 1, 2, 3}
    for g in range(3):
        (slope, offset), inliers, n = got[0][g, "a"]
        assert abs(slope - g - 1) < 0.02 and abs(offset + 3 * g) < 0.5 and n == 400 and 230 <= inliers <= 300
    assert got[0][3, "a"] == ([2.0, 1.0], 2, 2)
    # each solution's inliers are what near() keeps
    kept = {}
    for r in C.near(df, ["g", "h"], found, C.Line(), 0.3).collect():
        kept[r.g, r.h] = kept.get((r.g, r.h), 0) + 1
    assert kept == {k: v[1] for k, v in got[0].items()}


@pytest.mark.parametrize("local", [20_000, 20])
def test_homographies_of_large_groups(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL", local)
    monkeypatch.setattr(C, "BLOCK", 100)
    rng, rows = np.random.default_rng(2), []
    for pair in range(2):
        h = np.array([[1.1, 0.05 * pair, 20], [-0.03, 0.95, 5], [1e-5, 2e-5, 1]])
        a = rng.uniform(0, 1000, (300, 2))
        p = np.column_stack([a, np.ones(300)]) @ h.T
        b = p[:, :2] / p[:, 2:]
        b[200:] = rng.uniform(3000, 4000, (100, 2))
        rows += [(pair, i, *map(float, (*a[i], *b[i]))) for i in range(300)]
    df = spark.createDataFrame(rows, "pair int, id int, x1 double, y1 double, x2 double, y2 double")
    got = estimation.ransac(df, ["pair"], rounds=120, distance=1.0).collect()
    assert sorted((r.pair, r.id) for r in got) == [(p, i) for p in range(2) for i in range(200)] and got[0].asDict().keys() == set(df.columns)


def test_repeated_points_and_empty(spark):
    df = spark.createDataFrame([("k", float(x % 3), 2.0 * (x % 3)) for x in range(12)], "k string, x double, y double")
    r, = estimation.ransac_line(df, ["k"], 0.1).collect()
    assert (round(r.slope, 6), round(r.offset, 6), r.n, r.inliers) == (2.0, 0.0, 12, 12)
    assert estimation.ransac_line(df.limit(0), ["k"], 0.1).count() == 0


def test_many_draws_are_solved_as_one_by_one():
    """Draws over a grid, some of which determine nothing or have no value at a drawn row."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(1, 51, 30), rng.integers(0, 11, 30), rng.uniform(1, 100, 30), rng.integers(0, 9, 30)]).astype(float)
    draws = np.array([x[rng.choice(30, 5, replace=False)] for _ in range(400)])
    draws[3, 1:] = draws[3, 0]
    found = C.Homography().solve(draws)
    for d, h in zip(draws, found, strict=True):
        want = estimation.solve_homography(d[:, :2], d[:, 2:])
        assert np.isnan(h).any() if want is None else np.allclose(h, want.ravel(), rtol=1e-6, atol=1e-9)
    # systems are solved at once: no call a draw
    m, b = rng.normal(size=(50, 10, 8)), rng.normal(size=(50, 10))
    got, sure = C._least_squares(m, b)
    assert sure.all() and np.allclose(got, [np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(m, b, strict=True)])


def planted(rng, groups, n):
    """Matches of groups of n rows over a grid, of which two thirds follow a homography."""
    out = []
    for g in range(groups):
        a = np.column_stack([rng.integers(1, 51, n), rng.integers(0, 11, n)]).astype(float)
        b = np.column_stack([2 * a[:, 0] + 3 * a[:, 1] + g, a[:, 0] - 4 * a[:, 1]])
        b[: n // 3] = rng.uniform(1000, 9000, (n // 3, 2))
        out += [(g, i, *map(float, (*a[i], *b[i]))) for i in range(n)]
    return out


def test_small_groups_of_one_size_are_solved_at_once(spark, tmp_path):
    """Not group by group, and what is found doesn't depend on how rows came; matches are held against a homography without Python."""
    folder = str(tmp_path)

    class Counted(C.Homography):
        def solve(self, draws):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return super().solve(draws)

    columns = "g int, id int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(planted(np.random.default_rng(8), 60, 24) + [(None, k, 1.0, 1.0, 1.0, 1.0) for k in range(8)] + [(99, 0, 1.0, 1.0, 1.0, 1.0)], columns)
    got = [{r.g: (r.solution, r.inliers, r.n) for r in C.consensus(df.repartition(k), ["g"], "id", Counted(), 5.0, 200).collect()} for k in (1, 7)]
    assert got[0] == got[1] and {k: v[1:] for k, v in got[0].items()} == {g: (16, 24) for g in range(60)}
    assert 0 < len(list(tmp_path.iterdir())) <= 8  # two parts of draws in each run, and not for each of 60 groups
    kept = estimation.ransac(df, ["g"], rounds=200, distance=5.0)
    assert {(r.g, r.id) for r in kept.collect()} == {(g, i) for g in range(60) for i in range(8, 24)}
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()


def test_counts_equal_errors_at_the_bound():
    """Rows at exactly the distance, solutions without a value at a row, undetermined and huge ones."""
    x = np.array([[3.0, 4.0, 3.0, 24.0], [1.0, 0.0, 21.0, 0.0], [0.0, 0.0, 12.0, 16.0], [2.0, 5.0, 2.0, 5.0], [7.0, 1.0, 7.0 + 20 * (1 - 1e-15), 1.0]])
    one = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    s = np.array([one, [1, 0, 0, 0, 1, 0, -0.5, 0, 1], [0, 0, 0, 0, 0, 0, -0.5, 0, 1], [np.nan] * 8 + [1], [1e200, 0, 0, 0, 1e200, 0, 1e200, 0, 1], [1e160] * 8 + [1], [np.inf] * 8 + [1]])
    model = C.Homography()
    want = (model.error(s, x) < 20.0).sum(axis=1)
    assert want[0] == 1 + (np.hypot(x[4, 0] - x[4, 2], 0) < 20) and want[3] == 0
    assert (model.agree(s, x, 20.0) == want).all() and (model.agree(np.stack([s, s[::-1]]), np.stack([x, x]), 20.0) == [want, want[::-1]]).all()


def test_draws_take_the_rows_of_least_hashes():
    rng = np.random.default_rng(9)
    h = np.sort(rng.integers(-(2**63), 2**63 - 1, (3, 40)), axis=1)
    h[1, 3:20] = h[1, 3]  # rows of one identity: lower bits decide
    draws = np.arange(7, 90)
    got = C._picked(h, draws, 5)
    for g in range(3):
        of = C._ordered(h[g], draws)
        assert got[g].shape == (83, 5) and (np.diff(got[g], axis=1) > 0).all()
        assert (np.sort(np.take_along_axis(of, got[g], axis=1), axis=1) == np.sort(of, axis=1)[:, :5]).all()


def test_rows_of_one_identity_may_come_in_any_order(spark):
    rows = [(g, i // 2, *v) for g, i, *v in planted(np.random.default_rng(10), 30, 24)]
    columns = "g int, id int, x1 double, y1 double, x2 double, y2 double"
    got = [{r.g: r.solution for r in C.consensus(spark.createDataFrame(r, columns).coalesce(1), ["g"], "id", C.Homography(), 5.0, 30).collect()} for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 30
