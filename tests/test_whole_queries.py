import pytest

from tessera.plans import queries as Q

FAR = 1_000_000_000_000
LINES = [(k + d, k) for k in range(1, 8) for d in (0, 1)] + [(p, 50) for p in range(100, 140)]  # a chain of 14 levels, and a hot node
SUPPLIERS = list(range(95, 126)) + [*range(1, 8), 50]
PARTS = [(k, k % 17 * 3) for k in range(1, 150)]
CUSTOMERS = [(k, f"c{k}", k * 37 % 11000 - 1000.0) for k in range(1, 400)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    for name, rows, kind in (("lineitem", LINES, "l_partkey long, l_suppkey long"), ("supplier", [(s,) for s in SUPPLIERS], "s_suppkey long"), ("part", PARTS, "p_partkey long, p_size int"), ("customer", CUSTOMERS, "c_custkey long, c_name string, c_acctbal double")):
        spark.createDataFrame(rows, kind).coalesce(2).write.parquet(f"{d}/{name}.parquet")
    return d


def near():
    by = {}
    for a, b in LINES:
        by.setdefault(a, set()).add(b + FAR)
        by.setdefault(b + FAR, set()).add(a)
    return by


def reach(start):
    by, seen, front = near(), {start: 0}, [start]
    for n in front:
        for m in by.get(n, ()):
            if m not in seen:
                seen[m] = seen[n] + 1
                front.append(m)
    return seen


def test_graphs(spark, tables):
    nodes = {p for p, _ in PARTS} | {s + FAR for s in SUPPLIERS}
    got = {r.node: r.component for r in Q.connected_components(spark, tables).collect()}
    assert got == {n: min(reach(n)) for n in nodes}
    levels = {r.node: r.level for r in Q.breadth_first(spark, tables).collect()}
    assert levels == reach(1) and max(levels.values()) == 14


def test_rectangles(spark, tables):
    r = {k: (k % 10 * 37.0, k // 10 * 29.0, k % 10 * 37.0 + 60 + k % 7, k // 10 * 29.0 + 50) for k in SUPPLIERS}
    inside = lambda x, y, j: r[j][0] <= x < r[j][2] and r[j][1] <= y < r[j][3]
    want, points = {}, set()
    for i, (left, top, right, bottom) in r.items():
        for j in r:
            n = sum(inside(left + (right - left) * (a + 0.5) / 10, top + (bottom - top) * (b + 0.5) / 10, j) for a in range(10) for b in range(10))
            if i != j and n:
                pair = (min(i, j), max(i, j))
                want[pair] = max(want.get(pair, 0), n / 100)
        if i + 1 in r and any(inside(left + (right - left) * a / 10, top + (bottom - top) * b / 10, i + 1) for a in range(11) for b in range(11)):
            points.add((i, i + 1))
    assert {(x.i, x.j): x.ratio for x in Q.overlap(spark, tables).collect()} == pytest.approx(want)
    got = Q.geometric_points(spark, tables).collect()
    assert {(x.i, x.j) for x in got} == points and all(inside(x.x, x.y, x.j) for x in got)


def test_relations(spark, tables):
    old = {n: k for k, n, b in CUSTOMERS if b < 5000}
    fresh = [n for _, n, b in CUSTOMERS if b >= 0 and n not in old]
    want = {n: old.get(n) or max(old.values()) + 1 + fresh.index(n) for _, n, b in CUSTOMERS if b >= 0}
    assert {r["name"]: r.merged for r in Q.merge_by_name(spark, tables).collect()} == want
    sizes = sorted({s for _, s in PARTS if s > 0})
    assert {r.p_partkey: r.mode for r in Q.renumber_lines(spark, tables).collect()} == {p: sizes.index(s) + 3 if s > 0 else s for p, s in PARTS}
