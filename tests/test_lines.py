import math

import numpy as np

from tessera.operators import lines


def frame(spark, pixels, img=0):
    return spark.createDataFrame([(img, x, y) for x, y in pixels], "img int, x int, y int").repartition(3)


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.img, r.line, r.place)):
        out.setdefault((r.img, r.line), []).append((r.x, r.y, r.place))
    return out


def test_lines_come_back_in_order(spark):
    rising = [(x, 40 + x // 3) for x in range(90)]
    arc = [(200 + x, round((x - 60) ** 2 / 200) - 80) for x in range(121)]
    pair, dot = [(300, 300), (301, 301)], [(400, 400)]
    ring = [(500, 500), (501, 500), (502, 501), (502, 502), (501, 503), (500, 503), (499, 502), (499, 501)]
    shuffled = [p for i in np.random.default_rng(1).permutation(len(rising)) for p in [rising[i]]]
    found = got(lines.lines(frame(spark, [*shuffled, *arc, *pair, *dot, *ring]).unionByName(frame(spark, rising, 1))))
    order = lambda p: p if (p[0][1], p[0][0]) < (p[-1][1], p[-1][0]) else p[::-1]
    want = {(0, order(p)[0]): [(*q, k) for k, q in enumerate(order(p))] for p in (rising, arc, pair)} | {(1, rising[0]): [(*q, k) for k, q in enumerate(rising)]}
    assert {(i, tuple(f)): v for (i, f), v in found.items()} == want
    assert got(lines.lines(frame(spark, pair), 3)) == {} and lines.lines(frame(spark, [])).count() == 0


def test_crossings_part_lines(spark):
    cross = [(x, 10) for x in range(21)] + [(10, y) for y in range(21) if y != 10]
    found = got(lines.lines(frame(spark, cross)))
    assert sorted(len(v) for v in found.values()) == [9, 9, 9, 9]


def test_edges_keep_what_strong_ones_reach(spark):
    h, w = 30, 40
    v = np.zeros((h, w))
    v[:, 20:] = np.linspace(12, 100, h)[:, None]  # one step, weak above and strong below
    v[5:8, 5] = 14.0  # weak, and by itself
    df = spark.createDataFrame([(0, x, y, float(v[y, x])) for y in range(h) for x in range(w)], "img int, x int, y int, v double")
    found = {(r.x, r.y) for r in lines.edges(df, 30, 250).collect()}
    assert found == {(19, y) for y in range(1, h - 1)} or found == {(20, y) for y in range(1, h - 1)}
    g = {(r.x, r.y): r for r in lines.gradients(df).collect()}
    assert len(g) == (h - 2) * (w - 2) and (0, 3) not in g
    for x, y in ((19, 7), (20, 15), (5, 6), (33, 20)):
        gx = (v[y - 1 : y + 2, x + 1] * [1, 2, 1]).sum() - (v[y - 1 : y + 2, x - 1] * [1, 2, 1]).sum()
        gy = (v[y + 1, x - 1 : x + 2] * [1, 2, 1]).sum() - (v[y - 1, x - 1 : x + 2] * [1, 2, 1]).sum()
        assert abs(g[x, y].gx - gx) < 1e-9 and abs(g[x, y].gy - gy) < 1e-9 and abs(g[x, y].size - math.hypot(gx, gy)) < 1e-9


def test_lines_are_followed_through_tiles(spark, monkeypatch):
    """What pointer jumping ranks are the steps that enter tiles, not all; lines and rings over many tiles come out as in one."""
    line = [(x, -20 + x // 2) for x in range(150)] + [(150 + k, 54 - k) for k in range(60)]
    side = 40
    ring = [(300 + k, 0) for k in range(side)] + [(300 + side, k + 1) for k in range(side)] + [(300 + side - k - 1, side + 1) for k in range(side)] + [(299, side - k) for k in range(side)]
    pixels = frame(spark, [*line, *ring, (8, 90), (7, 91)])
    want = got(lines.lines(pixels, tile=4096))
    assert [len(v) for v in sorted(want.values(), key=len)] == [2, len(line)]
    ranked = []
    monkeypatch.setattr(lines, "cut", lambda df, cut=lines.cut: ranked.append(cut(df)) or ranked[-1])
    assert got(lines.lines(pixels, tile=8)) == want
    jumped = [df.count() for df in ranked if "next" in df.columns]
    assert jumped and max(jumped) < len(line) + len(ring)  # of two steps a pixel
