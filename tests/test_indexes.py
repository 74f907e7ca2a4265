import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tessera.operators import forest, kmeans_tree


def clustered(n=4000, dims=24, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    x = centres[rng.integers(0, 40, n)] + 0.5 * rng.standard_normal((n, dims))
    x[:copies] = x[0]
    return np.float32(x).astype(float)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def brute(q, t, k, first=0):
    out = {}
    for i, v in enumerate(q):
        d = ((t - v) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(t)), d))[:k]
        out[first + i] = [(int(j), float(d[j])) for j in order]
    return out


def got(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r.rank)):
        found.setdefault(r.q, []).append((r.t, r.d))
    return found


def recall(found, want):
    return sum(len({t for t, _ in found.get(q, [])} & {t for t, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_forest_recall_and_distances(spark):
    t, q = clustered(), clustered(300, seed=1)[:300] + 0.05
    want = brute(q, t, 2)
    found = got(forest.nearest(frame(spark, q), frame(spark, t)))
    assert recall(found, want) >= 0.9
    for k, near in found.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and all(abs(((t[j] - q[k]) ** 2).sum() - d) < 1e-9 for j, d in near)


@pytest.mark.parametrize(("dims", "copies"), [(2, 0), (3, 700), (8, 300)])
def test_forest_exact(spark, monkeypatch, dims, copies):
    monkeypatch.setattr(forest, "BLOCK", 100)
    t, q = clustered(1500, dims, 2, copies), clustered(120, dims, 3)
    q[:3] = t[0]
    found = got(forest.nearest(frame(spark, q), frame(spark, t), 3, leaf=40, exact=True))
    want = brute(q, t, 3)
    assert {k: [j for j, _ in v] for k, v in found.items()} == {k: [j for j, _ in v] for k, v in want.items()}


def test_walk_opens_every_cell_in_reach():
    x = clustered(800, 4, 5)
    tree = forest.Tree(x, 20, 1)
    leaf = tree.leaf_of(x)
    q = clustered(50, 4, 6)
    reach = np.full(len(q), 1.5)
    row, opened = tree.opened(q, 0, reach)
    cells = {(int(r), int(o)) for r, o in zip(row, opened, strict=True)}
    some = 0
    for i in range(len(q)):
        for j in np.flatnonzero(((x - q[i]) ** 2).sum(axis=1) <= 1.5):
            assert (i, int(leaf[j])) in cells
            some += 1
    assert some > 50 and len(cells) < 50 * len(np.unique(leaf))
    # with a beam, a walk opens so many cells at most, and its own one
    row, opened = tree.opened(q, 3)
    assert np.bincount(row).max() <= 3 and all(int(tree.leaf_of(q[i : i + 1])[0]) in opened[row == i] for i in range(len(q)))


def test_work_grows_slower_than_pairs(spark):
    """Distances computed for each query don't grow with the targets."""
    sizes = []
    for n in (2000, 8000):
        t, q = frame(spark, clustered(n, 8, 7)), frame(spark, clustered(100, 8, 8))
        trees = forest.grown(t, leaf=64)
        held = forest._dealt(t, trees, 0).groupBy("tree", "leaf").count()
        sizes.append(forest._dealt(q, trees, 8).join(held, ["tree", "leaf"]).agg({"count": "sum"}).first()[0])
    assert sizes[1] < 1.6 * sizes[0] < 1.6 * 4 * 8 * 100 * 128


def test_forest_of_few_rows(spark):
    empty = frame(spark, np.zeros((0, 3)))
    one = frame(spark, np.ones((1, 3)))
    assert got(forest.nearest(one, empty)) == {} and got(forest.nearest(empty, one)) == {}
    assert got(forest.nearest(one, frame(spark, np.zeros((1, 3)), 7))) == {0: [(7, 3.0)]}


def test_kmeans_tree(spark):
    t, q = clustered(2500, 16, 4), clustered(200, 16, 4)[:200] + 0.05
    nodes, rows = kmeans_tree.tree(frame(spark, t), branching=6, leaf=80, rounds=6)
    leaves = {r.id: r.node for r in rows.collect()}
    assert len(leaves) == len(t)
    n = {r.node: r for r in nodes.collect()}
    members = {}
    for i, leaf in leaves.items():
        members.setdefault(leaf, []).append(i)
    assert max(map(len, members.values())) <= 80
    parents = {r.parent for r in n.values()}
    # a leaf's centroid is the mean of its rows, and its variance theirs; a node has the rows of its children
    settled = [(leaf, m) for leaf, m in members.items() if leaf]
    near = sum(np.abs(t[m].mean(axis=0) - np.array(n[leaf].c)).max() < 0.2 for leaf, m in settled)
    assert near > 0.9 * len(settled) and not parents & members.keys() and max(r.level for r in n.values()) >= 2
    found = got(kmeans_tree.nearest(frame(spark, q), nodes, rows, 2))
    assert recall(found, brute(q, t, 2)) >= 0.9
    whole = got(kmeans_tree.nearest(frame(spark, q[:20]), nodes, rows, 2, beam=10_000))
    assert {k: [j for j, _ in v] for k, v in whole.items()} == {k: [j for j, _ in v] for k, v in brute(q[:20], t, 2).items()}


def test_kmeans_tree_of_copies_and_passes(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "SENT", 20)
    x = clustered(300, 4, 9, copies=200)
    nodes, rows = kmeans_tree.tree(frame(spark, x), branching=3, leaf=30, rounds=3)
    assert rows.count() == 300 and rows.filter("id < 200").select("node").distinct().count() == 1
    found = got(kmeans_tree.nearest(frame(spark, x[:5]), nodes, rows, 2, beam=10_000))
    assert all([j for j, _ in v] == [0, 1] for v in found.values())
    same = kmeans_tree.tree(frame(spark, np.ones((50, 2))), leaf=10)
    assert same[0].count() == 0 and same[1].select("node").distinct().count() == 1


def test_exact_walk_sends_a_query_to_few_cells(spark, monkeypatch):
    """In many dimensions all cells are within reach: a query is sent once a large cell, not once a small leaf, and nothing is missed."""
    x = np.random.default_rng(4).normal(size=(700, 16))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    sent, compared = [], forest._compared
    monkeypatch.setattr(forest, "_compared", lambda asked, held, k: sent.append(asked.count()) or compared(asked, held, k))
    monkeypatch.setattr(forest, "CELL_ROWS", 200, raising=False)
    got = {(r.q, r["rank"]): r.t for r in forest.nearest(rows.filter("id < 100"), rows.filter("id >= 100"), 2, leaf=8, exact=True).collect()}
    d = ((x[:100, None] - x[None, 100:]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :2] + 100
    assert got == {(q, n + 1): int(want[q, n]) for q in range(100) for n in (0, 1)}
    assert sum(sent) <= 100 * 14


def peak_mb(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_hold_bounded_parts(spark, monkeypatch):
    """Where all vectors are copies every pair is a candidate, and rows of one node meet all its children: a worker holds neither at once."""
    steps = []
    took = lambda self, func, schema: steps.append(func) or spark.createDataFrame([], schema)
    rows = frame(spark, np.zeros((2, 2)))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", took)
    leaf = rows.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"), "id", "v")
    forest._compared(leaf, leaf, 2)
    same = pa.table({"id": pa.array(np.arange(1000)[::-1]), "v": pa.array([[1.0] * 64] * 1000)})
    found, mb = peak_mb(lambda: steps[-1](same, same))
    assert found.column("t").to_pylist() == [0, 1] * 1000 and set(found.column("d").to_pylist()) == {0.0} and mb < 60
    centroids = spark.createDataFrame([(0, n + 1, [float(n)] * 64, 0.0) for n in range(16)], "parent long, node long, c array<double>, variance double")
    monkeypatch.setattr(type(rows), "mapInArrow", took)
    kmeans_tree._met(rows.withColumn("node", F.lit(0).cast("long")), centroids, True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2048)), pa.array(list(np.ones((2048, 64)))), pa.array(np.zeros(2048, np.int64))], ["id", "v", "node"])
    got, mb = peak_mb(lambda: [(b.num_rows, set(zip(b.column("node").to_pylist(), b.column("score").to_pylist(), strict=True))) for b in steps[-1](iter([batch]))])
    assert sum(n for n, _ in got) == 2048 * 16 and set().union(*(s for _, s in got)) == {(n + 1, 64.0 * (n - 1) ** 2) for n in range(16)}
    assert max(n for n, _ in got) <= 8192 and mb < 16
