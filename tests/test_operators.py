import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import estimation, filters, graph, lens, matching, ranking, relations, statistics

POINTS = "cp_id long, img1 int, img2 int, x1 double, y1 double, x2 double, y2 double, mode int"


def test_error_stats_of_nothing_and_one(spark):
    none = spark.createDataFrame([], "e double")
    assert tuple(statistics.error_stats(none, "e").first()) == (0, 1_000_000.0, 0.0, None, None)
    one = spark.createDataFrame([(3.0,)], "e double")
    assert statistics.error_stats(one, "e").first().variance is None and statistics.over_limit(one, "e", 2.0).count() == 0


def test_index_quantiles_take_a_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 2, 9)] + [("b", 4.0), ("b", None)], "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in statistics.index_quantiles(df, "v", {"lo": 0.1, "hi": 0.9}, "k").collect()}
    assert got == {"a": (1.0, 9.0), "b": (4.0, 4.0)}


def test_compaction_divides_whole_weights(spark):
    df = spark.createDataFrame([("l", 1.0, 10), ("l", 2.0, 7)], "k string, v double, w int")
    assert statistics.compact(df, "w", ["v"], "k").first().w == 8


def test_lens_look_up_rules(spark):
    t = lambda rows: spark.createDataFrame(rows, "f double, v double, w int")
    find = lambda rows, x: tuple(lens.look_up(t(rows), "f", "v", "w", x).first())
    two = [(20.0, 60.0, 10), (30.0, 40.0, 10), (30.0, 46.0, 20), (90.0, 1.0, 1)]
    assert find(two, 25.0) == (True, 52.0) and find(two, 20.0) == (True, 60.0)
    assert find(two, 17.0) == (False, None) and find(two, 110.0) == (False, None)
    assert find([(40.0, 5.0, 1)], 42.0) == (True, 5.0) and find([(40.0, 5.0, 1)], 50.0) == (False, None) and find([], 50.0) == (False, None)
    assert tuple(lens.look_up(t([(40.0, 0.05, 1)]), "f", "v", "w", 40.0, least=0.1).first()) == (False, None)


def test_lens_look_up_for_all_images(spark):
    t = spark.createDataFrame([("a", 20.0, 60.0, 10), ("a", 30.0, 40.0, 10), ("b", 40.0, 5.0, 1)], "lens string, f double, v double, w int")
    images = spark.createDataFrame([(1, "a", 25.0), (2, "b", 42.0), (3, "b", 60.0), (4, "c", 1.0), (5, None, None)], "nr int, lens string, x double")
    found = lens.look_up_all(images, "nr", "x", t, "lens", "f", "v", "w")
    assert {r.nr: r.v for r in found.collect()} == {1: 50.0, 2: 5.0, 3: None, 4: None, 5: None}
    own = images.withColumn("v", F.when(F.col("nr") == 1, 9.0))
    assert {r.nr: r.v for r in lens.fill(own, found, "nr", "v").collect()} == {1: 9.0, 2: 5.0, 3: None, 4: None, 5: None}


def test_mirrored_and_distinct_points(spark):
    rows = [(0, 1, 2, 1.0, 2.0, 3.0, 4.0, 0), (1, 2, 1, 3.0, 4.0, 1.0, 2.0, 0), (2, 1, 2, 1.0000001, 2.0, 3.0, 4.0, 0), (3, 1, 1, 5.0, 5.0, 6.0, 6.0, 0), (4, 1, 2, 1.0, 2.0, 3.0, 4.0, 1)]
    df = spark.createDataFrame(rows, POINTS)
    assert sorted(r.cp_id for r in relations.distinct_points(df).collect()) == [0, 3, 4]
    turned = {r.cp_id: tuple(r)[1:7] for r in relations.mirrored(df, 2).collect()}
    assert turned[0] == (2, 1, 3.0, 4.0, 1.0, 2.0) and turned[1] == (2, 1, 3.0, 4.0, 1.0, 2.0) and 3 not in turned
    assert {r.cp_id: r.x1 for r in relations.mirrored(df, 1).collect()}[3] == 5.0
    masks = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)]), (2, [(0.0, 0.0), (9.0, 9.0)])], "img_nr int, poly array<struct<x: double, y: double>>")
    assert sorted(r.cp_id for r in relations.in_masks(df, masks).collect()) == [0, 1, 2, 4]


def test_merge_upsert_and_numbers(spark):
    old = spark.createDataFrame([("a", 0), ("b", 1)], "name string, nr int")
    new = spark.createDataFrame([("c", 0), ("b", 1), ("d", 2)], "name string, nr int")
    assert {r.name: r.merged for r in relations.merge_by_name(old, new, "name", "nr").collect()} == {"b": 1, "c": 2, "d": 3}
    assert {tuple(r) for r in relations.upsert(old, new.filter("name = 'b'").withColumn("nr", F.lit(7)), ["name"]).collect()} == {("a", 0), ("b", 7)}
    rng = random.Random(1)
    values = [(rng.randrange(10**6), i) for i in range(3000)]
    got = {r.i: r.n for r in ranking.row_numbers(spark.createDataFrame(values, "v int, i int").repartition(7), "n", ["v", "i"]).collect()}
    assert [i for _, i in sorted(values)] == sorted(got, key=got.get) and sorted(got.values()) == list(range(3000))
    lines = spark.createDataFrame([(0, 0), (1, 2), (2, 9), (3, 5), (4, 9)], "cp_id int, mode int")
    assert {r.cp_id: r.mode for r in relations.renumber_lines(lines).collect()} == {0: 0, 1: 2, 2: 4, 3: 3, 4: 4}


def test_components_partition_nodes(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    nodes = sorted({x for e in edges for x in e} | {999})
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), df)
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}
    assert not graph.is_connected(got).first().connected and not graph.is_connected(got.limit(0)).first().connected
    far = {r.node: r.level for r in graph.levels(df, spark.createDataFrame([(400,)], "node long")).collect()}
    assert far[440] == 40 and len(far) == 41


def test_sessions_merge_at_the_gap(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2020-01-01 00:00:00'), (1, TIMESTAMP '2020-01-01 01:00:00'), (1, TIMESTAMP '2020-01-01 02:00:01') AS t(u, ts)")
    assert sorted(r.n for r in graph.sessions(df, ["u"], "ts", "1 hour").collect()) == [1, 2]


def test_mutual_exclusion_drops_all(spark):
    m = spark.createDataFrame([(1, 5, 1.0, 9.0), (2, 5, 1.0, 9.0), (3, 6, 1.0, 9.0), (4, 7, 8.0, 9.0)], "q int, t int, d1 double, d2 double")
    assert [r.q for r in matching.exclusive(matching.ratio_test(m, 0.25)).collect()] == [3]


def test_ransac_finds_the_homography(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.05, 20], [-0.03, 0.95, 5], [1e-5, 2e-5, 1]])
    a = rng.uniform(0, 1000, (40, 2))
    p = np.column_stack([a, np.ones(40)]) @ h.T
    b = p[:, :2] / p[:, 2:]
    b[30:] = rng.uniform(0, 1000, (10, 2)) + 3000
    rows = [(1, i, *map(float, (*a[i], *b[i]))) for i in range(40)] + [(2, i, *map(float, (*a[i], *rng.uniform(0, 1e5, 2)))) for i in range(12)] + [(3, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair int, id int, x1 double, y1 double, x2 double, y2 double")
    got = estimation.ransac(df, ["pair"], rounds=300, distance=5.0).collect()
    assert sorted(r.id for r in got if r.pair == 1) == list(range(30)) and {r.pair for r in got} == {1}


def test_greedy_groups(spark):
    images = spark.createDataFrame([("p", i, ev) for i, ev in enumerate((0.0, 0.4, 0.5, 0.9, 0.2))], "project_id string, img_nr long, ev double")
    assert {r.img_nr: r.layer for r in estimation.greedy_layers(images).collect()} == {0: 0, 1: 0, 4: 0, 2: 1, 3: 1}
    overlaps = spark.createDataFrame([("p", 0, 2, 0.9), ("p", 2, 3, 0.9), ("p", 1, 3, 0.7)], "project_id string, i long, j long, ratio double")
    assert {r.img_nr: r.stack for r in estimation.greedy_stacks(overlaps, images).collect()} == {0: 0, 2: 0, 1: 1, 3: 2, 4: 3}


def test_deghost_lowers_what_moves(spark):
    rows = [(i, x, y, 200.0 if (i, x, y) == (2, 2, 2) else 120.0) for i in range(3) for x in range(5) for y in range(5)]
    got = {(r.img, r.x, r.y): r.weight for r in estimation.deghost(spark.createDataFrame(rows, "img int, x int, y int, v double")).collect()}
    assert max(got.values()) == 255 and got[2, 2, 2] < 5 < got[0, 2, 2]


def test_sieve_counts_equal_scores_once(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (1.5, 1.0, 5.0), (1.2, 1.0, 4.0), (9.0, 9.0, 1.0)], "x double, y double, s double")
    got = ranking.sieve(df, F.col("x"), F.col("y"), 10.0, 10.0, 2, 2, 2, ["s"]).collect()
    assert sorted(r.s for r in got) == [1.0, 4.0, 5.0]


def test_ransac_query_finds_parts_with_half_inliers(spark, tmp_path):
    from tessera.plans.queries import ransac_filter

    rng, rows, want = np.random.default_rng(7), [], set()
    for part in range(6):
        good = set(rng.permutation(20)[: 10 + part % 3].tolist())
        for i in range(20):
            x, y = rng.uniform(1, 50), rng.uniform(0, 10)
            u, v = (2 * x + 3 * y + 5, x - 4 * y) if i in good else rng.uniform(1000, 9000, 2)
            rows.append((part, part * 100 + i, 1, float(x), float(y / 100), float(u * 1000), float(v / 100)))
            want |= {(part, (part * 100 + i) * 10 + 1)} if i in good else set()
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.l_partkey, r.id) for r in ransac_filter(spark, str(tmp_path)).collect()} == want


def test_layers_of_many_projects_with_large_numbers(spark):
    rng = random.Random(4)
    far = 2**60 + 1  # beyond what a double holds
    rows = [(p, far + n, rng.choice([0.0, 0.3, 0.8, 1.7, 2.0])) for p in range(40) for n in range(p % 6)]
    want = {}
    for p in range(40):
        todo, at = [(n, ev) for q, n, ev in rows if q == p], 0
        while todo:
            seed = todo[0][1]
            want |= {(p, n): at for k, (n, ev) in enumerate(todo) if not k or abs(ev - seed) < 0.5}
            todo, at = [(n, ev) for n, ev in todo if (p, n) not in want], at + 1
    got = estimation.greedy_layers(spark.createDataFrame(rows, "project_id int, img_nr long, ev double")).collect()
    assert {(r.project_id, r.img_nr): r.layer for r in got} == want and len(got) == len(rows)


def test_match_sieve_keeps_the_best_before_the_shuffle(spark):
    """A cell's best match alone needs no window over all of its rows; missing scores come last."""
    rows = [(1, 0.0, 0.0, 1.0, "a"), (1, 0.1, 0.0, 2.0, "b"), (1, 9.0, 9.0, None, "c"), (2, 5.0, 5.0, None, "d"), (2, 5.0, 5.0, -1.0, "e")]
    found = filters.match_sieve(spark.createDataFrame(rows, "k int, x double, y double, s double, name string"), ["k"], "x", "y", ["s"])
    assert found.columns == ["k", "x", "y", "s", "name", "cell_x", "cell_y"]
    assert sorted(r.name for r in found.collect()) == ["b", "c", "e"]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_two_nearest_over_parts_of_a_block(spark):
    """A block's rows meet the other block in parts of ``ROWS``; none is missed and numbers stay those of the whole block."""
    x = [((k * 37) % 101 / 7.0, (k * 53) % 97 / 5.0) for k in range(1300)]
    assert 1200 > 2 * matching.ROWS
    rows = spark.createDataFrame([(k, list(v)) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.q: (r.t, r.d1) for r in matching.two_nearest(rows.filter("id < 1200"), rows.filter("id >= 1200")).collect()}
    apart = lambda q, t: sum((a - b) ** 2 for a, b in zip(x[q], x[t], strict=True))
    want = {q: min((apart(q, t), t) for t in range(1200, 1300)) for q in range(1200)}
    assert len(got) == 1200 and all(abs(got[q][1] - want[q][0]) < 1e-9 for q in want)


def test_printed_numbers_equal_the_formatter(spark):
    from pyspark.sql import functions as F

    from tessera.operators import edits, relations

    values = [0.0, -0.0, 1.0, -3.0, 12.0, 99999.0, 100000.0, -99999.0, 1e6, 1234567.0, 0.5, 12.0000001, -7.25, 1e-9, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", relations.printed(F.col("x"), 6).alias("a"), F.format_string("%.6g", "x").alias("b")).collect()
    assert all(r.a == r.b for r in got)
    # the merged points' plan reads what was made once, instead of making both projects' points for each use
    points = spark.createDataFrame([(k, 1, 2, float(k % 3), 0.0, 1.0, 0.0, 0) for k in range(9)], "cp_id long, img1 long, img2 long, x1 double, y1 double, x2 double, y2 double, mode int")
    part = {"images": spark.createDataFrame([(1, "a"), (2, "b")], "img_nr long, filename string"), "points": points, "masks": spark.createDataFrame([], "img_nr long, mask_type int, poly array<struct<x: double, y: double>>"), "links": spark.createDataFrame([], "var string, img_nr long, anchor long")}
    merged = edits.merge_projects(part, part)["points"]
    assert merged.count() == 3 and all("tessera-cut" in f for f in merged.inputFiles())


def test_small_groups_are_solved_together(spark):
    """Groups of few rows are no Python call each, and a line's distances are a column."""
    from tessera.operators import estimation

    rows = [(k, float(x), 2.0 * x + k + (40.0 if x % 5 == 0 else 0.0)) for k in range(50) for x in range(20)]
    found = estimation.ransac_line(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], 1.0)
    got = {r.k: (round(r.slope, 6), round(r.offset, 6), r.n, r.inliers) for r in found.collect()}
    assert got == {k: (2.0, float(k), 20, 16) for k in range(50)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonMapInArrow" not in plan
