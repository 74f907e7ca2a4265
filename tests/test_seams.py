import heapq

import numpy as np
import pytest

from tessera.operators import seams


def grid(spark, values, name="c", kind="long"):
    h, w = values.shape
    return spark.createDataFrame([(x, y, values[y, x].item()) for y in range(h) for x in range(w)], f"x long, y long, {name} {kind}").repartition(3)


def flooded(cost, seeds, diagonal=False):
    """Labels and weight by a flood with a queue, one edge after another."""
    h, w = cost.shape
    label = {p: s for p, s in seeds.items()}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1), *([(1, 1), (-1, -1), (1, -1), (-1, 1)] if diagonal else [])]
    heap, total = [], 0

    def push(x, y):
        for dx, dy in steps:
            a, b = x + dx, y + dy
            if 0 <= a < w and 0 <= b < h and (a, b) not in label:
                ends = sorted([(y, x), (b, a)])
                heapq.heappush(heap, (int(max(cost[y, x], cost[b, a])), ends, (a, b), label[x, y]))

    for x, y in list(label):
        push(x, y)
    while heap:
        c, _, p, s = heapq.heappop(heap)
        if p not in label:
            label[p] = s
            total += c
            push(*p)
    return label, total


@pytest.mark.parametrize(("diagonal", "high"), [(False, 1000), (True, 1000), (False, 4)])
def test_watershed_equals_a_flood(spark, diagonal, high):
    rng = np.random.default_rng(3)
    cost = rng.integers(0, high, (14, 17))
    seeds = {(0, 0): 1, (16, 13): 2, (8, 4): 3, (9, 4): 3}
    df = grid(spark, cost)
    label = {(r.x, r.y): r.label for r in seams.watershed(df.join(spark.createDataFrame([(x, y, s) for (x, y), s in seeds.items()], "x long, y long, s int"), ["x", "y"], "left"), "c", "s", diagonal).collect()}
    want, _ = flooded(cost, seeds, diagonal)
    assert label == want


def test_forest_weight_parts_and_no_seeds(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 50, 200), strict=True)]
    edges += [(70, 71, 1), (71, 71, 0)]
    nodes = spark.createDataFrame([(n,) for n in [*range(60), 70, 71, 72]], "node long")
    seeds = {3: "a", 20: "b", 44: "a"}
    found, tree = seams.forest(nodes, spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame(list(seeds.items()), "node long, label string"))
    label = {r.node: r.label for r in found.collect()}
    assert label[70] is None and label[71] is None and label[72] is None and len(label) == 63
    # Kruskal's rule, seeds as one to begin with
    root = {n: n for n in label}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for s in seeds:
        root[find(s)] = find(3)
    total = 0
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    chosen = tree.collect()
    assert sum(r.w for r in chosen) == total
    near = {}
    for r in chosen:
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    for s, name in seeds.items():  # what the forest's edges reach from a seed has its label
        seen, todo = {s}, [s]
        while todo:
            for m in near.get(todo.pop(), set()) - seen:
                seen.add(m)
                todo.append(m)
        assert {label[m] for m in seen} == {name} and not (seen & seeds.keys()) - {s}


def test_merged_images(spark):
    one = np.full((6, 10), 100)
    two = np.full((6, 10), 100)
    two[:, 5] = 180  # both agree but for a column that the seam must not cross without need
    a = grid(spark, one, "v").filter("x < 8")
    b = grid(spark, two, "v").filter("x > 2")
    found = {(r.x, r.y): (r.v, r.image) for r in seams.merged(a, b).collect()}
    assert len(found) == 60 and all(found[x, y][1] == 1 for x in range(3) for y in range(6)) and all(found[x, y][1] == 2 for x in (8, 9) for y in range(6))
    cut = {y: [x for x in range(9) if found[x, y][1] != found[x + 1, y][1]] for y in range(6)}
    assert all(len(c) == 1 and c[0] in (4, 5) for c in cut.values())
    alone = seams.merged(a, b.filter("x > 2 AND x < 6")).filter("image = 2").count()
    assert alone == 0


def dense_sweeps(v, fixed, b, sweeps, omega):
    h, w = v.shape
    v = v.copy()
    for _ in range(sweeps):
        for odd in (0, 1):
            old = v.copy()
            for y in range(h):
                for x in range(w):
                    near = [(x + dx, y + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < w and 0 <= y + dy < h]
                    if not fixed[y, x] and (x + y) % 2 == odd:
                        v[y, x] = (1 - omega) * old[y, x] + omega * (sum(old[q, p] for p, q in near) + b[y, x]) / len(near)
    return v


def problem(spark, rng, h=21, w=26):
    v, b, fixed = rng.uniform(0, 9, (h, w)), rng.uniform(-1, 1, (h, w)), rng.random((h, w)) < 0.08
    fixed[0, 0] = True
    rows = [(x - 5, y - 7, v[y, x].item(), bool(fixed[y, x]), b[y, x].item()) for y in range(h) for x in range(w)]
    return v, b, fixed, spark.createDataFrame(rows, "x int, y int, v double, fixed boolean, b double").repartition(3)


@pytest.mark.parametrize(("tile", "at_once", "sweeps"), [(7, 2, 3), (64, 4, 5), (5, 1, 2)])
def test_sweeps_dont_depend_on_tiles(spark, tile, at_once, sweeps):
    v, b, fixed, df = problem(spark, np.random.default_rng(5))
    want = dense_sweeps(v, fixed, b, sweeps, 1.4)  # x and y are shifted by 12 together, so colours are the same
    found = {(r.x + 5, r.y + 7): r.v for r in seams.relax(df, sweeps, 1.4, tile, at_once).collect()}
    assert len(found) == v.size and all(abs(found[x, y] - want[y, x]) < 1e-9 for y in range(v.shape[0]) for x in range(v.shape[1]))


@pytest.mark.parametrize(("coarsest", "tolerance", "near"), [(64, 1e-5, 1e-3), (13, 0.05, 0.3)])
def test_solve_reaches_the_solution(spark, coarsest, tolerance, near):
    v, b, fixed, df = problem(spark, np.random.default_rng(6), 12, 14)
    b[fixed] = 0
    found, most = seams.solve(df, tolerance, tile=32, coarsest=coarsest)
    assert most < tolerance
    h, w = v.shape
    n = h * w
    a, rhs = np.zeros((n, n)), np.zeros(n)
    for y in range(h):
        for x in range(w):
            k = y * w + x
            near = [(x + dx) + (y + dy) * w for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < w and 0 <= y + dy < h]
            if fixed[y, x]:
                a[k, k], rhs[k] = 1, v[y, x]
            else:
                a[k, k], rhs[k] = len(near), b[y, x]
                a[k, near] -= 1
    want = np.linalg.solve(a, rhs).reshape(h, w)
    assert all(abs(r.v - want[r.y + 7, r.x + 5]) < near for r in found.collect())


def test_blend_keeps_gradients(spark):
    y, x = np.mgrid[:8, :16]
    scene = (3 * x + 2 * y).astype(float)
    one, two = grid(spark, scene, "v", "double").filter("x < 10"), grid(spark, scene + 40, "v", "double").filter("x > 5")
    found = {(r.x, r.y): r.v for r in seams.blended(one, two, 1e-4).collect()}
    assert len(found) == 128 and all(abs(found[a, b] - scene[b, a]) < 0.02 for a in range(16) for b in range(8))
