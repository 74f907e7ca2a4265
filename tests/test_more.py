import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import geometry as G
from tessera.functions import photometry as P
from tessera.functions import scalar as S
from tessera.operators import coverage, edits, estimation, filters, graph, lens, ranking, statistics
from tessera.sources import project, tables


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(7, 7), (500, 501), (501, 500)]
    rng.shuffle(pairs)
    nodes = sorted({n for p in pairs for n in p} | {900})
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), e).collect()}
    assert got == label
    alone = graph.components(spark.createDataFrame([(1,), (2,)], "node long"), e.limit(0))
    assert {tuple(r) for r in alone.collect()} == {(1, 1), (2, 2)} and graph.components(alone.select("node").limit(0), e.limit(0)).count() == 0


def test_blending_order_starts_at_the_reference_and_restarts(spark):
    o = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.0005), (4, 5, 0.2)], "i long, j long, ratio double")
    images = spark.createDataFrame([(k,) for k in range(1, 7)], "img_nr long")
    got = {r.img_nr: r.level for r in graph.blending_order(images, o, 3).collect()}
    assert got == {3: 0, 2: 1, 1: 2, 4: 0, 5: 1, 6: 0}
    assert {r.img_nr: r.level for r in graph.blending_order(images, o, 99).collect()}[1] == 0


def test_deep_levels_by_blocks(spark, monkeypatch):
    """A long strip with short cuts, whose levels need few rounds; blocks of any size give the same."""
    rng = random.Random(9)
    pairs = [(k, k + 1) for k in range(400)] + [(k, k + 2) for k in range(0, 400, 7)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, queue = {12: 0}, [12]
    for n in queue:
        for m in near[n]:
            if m not in want:
                want[m] = want[n] + 1
                queue.append(m)
    want[900] = 0  # a start of its own
    e, start = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(12,), (900,)], "node long")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    for size in (300, 10_000):
        written.clear()
        monkeypatch.setattr(graph, "BLOCK_EDGES", size)
        assert {r.node: r.level for r in graph.levels(e, start).collect()} == want
        assert max(want.values()) > 40 and len(written) < 40


def test_greedy_stacks_open_at_the_smallest(spark):
    rng = random.Random(3)
    ratios = [(p, i, j, rng.random()) for p in (0, 1) for i in range(8) for j in range(i + 1, 8)]
    want = {}
    for p in (0, 1):
        todo, n = list(range(8)), 0
        while todo:
            mine = [m for m in todo if m == todo[0] or any(q == p and {i, j} == {m, todo[0]} and r > 0.7 for q, i, j, r in ratios)]
            want |= {(p, m): n for m in mine}
            todo, n = [m for m in todo if m not in mine], n + 1
    images = spark.createDataFrame([(p, i) for p in (0, 1) for i in range(8)], "p long, img_nr long")
    got = estimation.greedy_stacks(spark.createDataFrame(ratios, "p long, i long, j long, ratio double"), images, "p")
    assert {(r.p, r.img_nr): r.stack for r in got.collect()} == want


def test_sessions_in_order_take_the_first_that_holds(spark):
    rng = random.Random(5)
    rows = [(u, i, rng.randint(0, 5000)) for u in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "u long, i long, s long").withColumn("t", F.timestamp_seconds("s"))
    want = {}
    for u in (1, 2):
        spans = []
        for _, i, t in sorted(r for r in rows if r[0] == u):
            k = next((k for k, (a, b) in enumerate(spans) if a - 60 <= t <= b + 60), len(spans))
            spans[k : k + 1] = [(min(spans[k][0], t), max(spans[k][1], t)) if k < len(spans) else (t, t)]
            want[u, i] = k
    got = graph.first_matching_sessions(df, ["u"], "t", ["i"], 60)
    assert {(r.u, r.i): r.session for r in got.collect()} == want


def test_seeded_sample_and_radius(spark):
    df = spark.createDataFrame([(k % 3, k, float(k)) for k in range(100)], "g int, k int, d double")
    one, other = (sorted(r.k for r in ranking.seeded_sample(d, 5, ["g"], ["k"], 7).collect()) for d in (df, df.repartition(7)))
    assert one == other and len(one) == 15 and one != sorted(r.k for r in ranking.seeded_sample(df, 5, ["g"], ["k"], 8).collect())
    assert sorted(r.k for r in ranking.within(df, "d", 6.0, None, ["g"], ["k"]).collect()) == [0, 1, 2, 3, 4, 5]
    assert [r.k for r in ranking.sorted_points(df, "g", True, ["k"]).limit(2).collect()] == [2, 5]


def test_turned_angles_are_products_of_rotations(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-170, 170), rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(20)]
    df = spark.createDataFrame(rows, "y double, p double, r double")
    by = (20.0, -10.0, 5.0)
    got = df.select(*G.turned_angles(F.col("y"), F.col("p"), F.col("r"), by)).collect()
    for a, b in zip(rows, got, strict=True):
        assert np.allclose(np.array(G.rotation(*by)) @ np.array(G.rotation(*a)), np.array(G.rotation(*b)), atol=1e-9)


def test_more_transforms_have_inverses(spark):
    rng = random.Random(4)
    points = [(rng.uniform(-80, 80), rng.uniform(-60, 60)) for _ in range(30)] + [(0.0, 0.0)]
    df, d, turn = spark.createDataFrame(points, "x double, y double"), 120.0, G.rotation(10, 20, 30)
    back = [list(r) for r in zip(*turn, strict=True)]
    pairs = [(G.rect_to_pano(d), G.pano_to_rect(d)), (G.sphere_to_rect(d), G.rect_to_sphere(d)), (G.sphere_to_pano(d), G.pano_to_sphere(d)), (G.persp_sphere(turn, d), G.persp_sphere(back, d)), (G.persp_rect(turn, d), G.persp_rect(back, d)), (G.vertical((0.98, 0.01, 0.0, -0.01), 100.0), G.undo_vertical((0.98, 0.01, 0.0, -0.01), 100.0))]
    columns = [c.alias(f"{k}{a}") for k, (there, again) in enumerate(pairs) for c, a in zip(G.bound((F.col("x"), F.col("y")), there, again), "xy", strict=True)]
    for (x, y), r in zip(points, df.select(*columns).collect(), strict=True):
        for k in range(len(pairs)):
            assert math.isclose(r[2 * k], x, abs_tol=1e-6) and math.isclose(r[2 * k + 1], y, abs_tol=1e-6), k
    far = spark.createDataFrame([(0.3, -0.2)], "x double, y double").select(*G.mirror_to_sphere_cp(1.0, 2.0)(G.sphere_cp_to_mirror(1.0, 2.0)((F.col("x"), F.col("y"))))).first()
    assert math.isclose(abs(far[0]), 0.3, abs_tol=1e-9) and math.isclose(abs(far[1]), 0.2, abs_tol=1e-9)
    assert spark.range(1).select(G.mirror_to_sphere_cp(1.0, 2.0)((F.lit(3.0), F.lit(0.0)))[0]).first()[0] is None


def test_levelled_axis_and_robust_line(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 2 * np.pi, 50)
    axes = np.column_stack([np.cos(a), np.sin(a), 0.1 * np.sin(a)])
    got = coverage.levelled(spark.createDataFrame(axes.tolist(), "x double, y double, z double"))
    _, v = np.linalg.eigh(axes.T @ axes)
    assert np.allclose(np.abs(got), np.abs(v[:, 0]), atol=1e-9) and coverage.levelled(spark.createDataFrame([], "x double, y double, z double")) is None
    points = [("a", float(x), 2.0 * x + 1 + (100.0 if x % 4 == 0 else 0.0)) for x in range(40)] + [("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0)]
    lines = estimation.ransac_line(spark.createDataFrame(points, "k string, x double, y double"), ["k"], 0.5).collect()
    assert [(r.k, round(r.slope, 6), round(r.offset, 6), r.n, r.inliers) for r in lines] == [("a", 2.0, 1.0, 40, 30)]
    assert estimation.tries_needed(0.999, 0.3, 5) == 38 and estimation.tries_needed(0.999, 0.0, 5) == 1


def test_largest_rectangle_against_all(spark):
    rng = random.Random(6)
    for share in (0.5, 0.8, 1.0, 0.0):
        ok = {(x, y): rng.random() < share for x in range(9) for y in range(7)}
        df = spark.createDataFrame([(x, y, v) for (x, y), v in ok.items()], "x long, y long, ok boolean")
        every = [((r - l) * (b - t), -t, -l, r, b) for l in range(9) for r in range(l + 1, 10) for t in range(7) for b in range(t + 1, 8) if all(ok[x, y] for x in range(l, r) for y in range(t, b))]
        got = coverage.largest_rectangle(df, "x", "y", F.col("ok")).collect()
        assert [(r.area, -r.top, -r.left) for r in got] == ([max(every)[:3]] if every else [])


def test_links_are_cut_and_rebuilt(spark):
    links = spark.createDataFrame([("y", 2, 1), ("y", 3, 1), ("v", 3, 2)], "var string, img_nr long, anchor long")
    ids = lambda df: sorted(tuple(r) for r in df.collect())
    assert ids(edits.unlink(links, spark.createDataFrame([("y", 1)], "var string, img_nr long"))) == [("v", 3, 2), ("y", 3, 2)]
    assert ids(edits.link(links, spark.createDataFrame([("y", 1, 0), ("v", 1, 1)], "var string, img_nr long, anchor long"))) == [("v", 3, 2), ("y", 1, 0), ("y", 2, 0), ("y", 3, 0)]
    images = spark.createDataFrame([(0,), (2,), (3,)], "img_nr long")
    assert ids(edits.subset_links(links, images)) == [("v", 2, 1), ("y", 2, 1)]
    assert [edits.subset_reference(k, images).first()[0] for k in (0, 2, 3, 1)] == [0, 1, 2, 0]
    assert spark.range(1).select(edits.remaining_reference(F.lit(5), F.lit(5)), edits.remaining_reference(F.lit(4), F.lit(5))).first()[:] == (0, 4)
    with pytest.raises(ValueError, match="3 images"):
        edits.apply_template(images, images.limit(1), [])


def test_merged_projects(spark):
    kinds = {"images": "img_nr long, filename string, hfov double", "points": "cp_id long, img1 long, img2 long, x1 double, y1 double, x2 double, y2 double, mode int", "masks": "img_nr long, mask_type int, poly array<struct<x: double, y: double>>", "links": "var string, img_nr long, anchor long"}
    make = lambda **rows: {k: spark.createDataFrame(rows.get(k, []), kind) for k, kind in kinds.items()}
    tri = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    old = make(images=[(0, "a", 1.0), (1, "b", 2.0)], points=[(0, 0, 1, 1.0, 1.0, 2.0, 2.0, 0), (1, 0, 0, 1.0, 1.0, 2.0, 2.0, 3)], masks=[(0, 0, tri)], links=[("v", 1, 0)])
    new = make(images=[(0, "b", 9.0), (1, "c", 3.0)], points=[(0, 0, 1, 5.0, 5.0, 6.0, 6.0, 0), (1, 0, 0, 1.0, 1.0, 2.0, 2.0, 3)], masks=[(0, 0, tri), (0, 1, tri)], links=[("v", 1, 0)])
    m = edits.merge_projects(old, new)
    assert sorted(tuple(r) for r in m["images"].collect()) == [(0, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)]
    assert sorted(tuple(r)[:3] + (r.mode,) for r in m["points"].collect()) == [(0, 0, 1, 0), (1, 0, 0, 3), (2, 1, 2, 0), (3, 1, 1, 4)]
    assert sorted((r.img_nr, r.mask_type) for r in m["masks"].collect()) == [(0, 0), (1, 0), (1, 1)]
    assert sorted(tuple(r) for r in m["links"].collect()) == [("v", 1, 0), ("v", 2, 0)]


def test_vignetting_of_unknown_aperture_and_missing_lens(spark):
    t = spark.createDataFrame([("a", 20.0, 2.0, 0.1, 10), ("a", 20.0, 4.0, 0.3, 10), ("a", 30.0, 2.0, 0.5, 10), ("b", 40.0, 2.8, 0.7, 1)], "lens string, focallength double, aperture double, vb double, weight int")
    images = spark.createDataFrame([(1, "a", 25.0, 0.0), (2, "b", 42.0, 2.9), (3, "b", 42.0, 3.5), (4, "x", 42.0, 3.5), (5, "a", 20.0, None), (6, None, 1.0, 1.0)], "nr int, lens string, x double, y double")
    got = {r.nr: r.vb for r in lens.look_up_vignetting(images, "nr", "lens", "x", "y", t, ["vb"], "weight").collect()}
    assert got[2] == 0.7 and got[3] is None and got[4] is None and got[6] is None and 0.1 <= got[1] <= 0.5


def test_response_tables_are_undone(spark):
    t = P.gamma_table(0.45, 64)
    df = spark.createDataFrame([(v / 20,) for v in range(21)] + [(-1.0,), (2.0,)], "v double")
    rows = df.select("v", P.invert_table(t, P.look_up(t, F.col("v")))).collect()
    assert all(math.isclose(r[1], min(max(r.v, 0), 1), abs_tol=1e-9) for r in rows)
    assert df.select(P.unrespond(P.respond(F.col("v"), F.lit(0.5), (1.0, -0.1, 0.0, 0.0), 2.0), F.lit(0.5), (1.0, -0.1, 0.0, 0.0), 2.0)).first()[0] == 0.0
    assert df.limit(1).select(F.size(P.resize_table(t, 10))).first()[0] == 10


def test_whole_project_round_trip(spark, tmp_path):
    text = '''p f2 w3000 h1500 v360 E12.5 R0 T"UINT8" S100,2900,0,1500 n"TIFF_m c:LZW"
m g1 i6
i w4000 h3000 f0 v50 Eev10 a0.1 b0 c0 Va1 Vb0 Vc0 Vd0 r0 p0 y0.25 S1,2,3,4 Vm5 n"a 1.jpg"
i w4000 h3000 f0 v=0 Eev11 a=0 b=0 c=0 Va=0 Vb=0 Vc=0 Vd=0 r0 p0 y40 Vm5 n"a 2.jpg"
v y1
v r1 p1
c n0 N1 x3500 y1500 X300 Y1502 t0
k i1 t0 p"0 0 100 0 100 100.5 0 100"
#option_minOverlap 0.7
'''
    (tmp_path / "one.pto").write_text(text)

    def parts(folder, pattern):
        lines = project.read_lines(spark, str(folder), pattern).withColumn("project_id", F.lit("p"))
        return {"output": project.output(lines), "images": project.images(lines), "optimise": project.to_optimise(lines), "points": project.control_points(lines), "masks": project.masks(lines), "options": project.options(lines)}

    first = parts(tmp_path, "one.pto")
    assert first["images"].filter("img_nr = 0").first().crop == [1, 2, 3, 4] and first["output"].first().region == [100, 2900, 0, 1500]
    assert sorted(tuple(r)[1:] for r in first["optimise"].collect()) == [(1, "p"), (1, "r"), (1, "y")]
    project.write_lines(project.project_lines(first).coalesce(1), str(tmp_path / "out"))
    again = parts(tmp_path / "out", "*.txt")
    for name, df in first.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again[name].collect())), name
    assert project.option(first["options"], "minOverlap", "double", "0.5").first()[1] == 0.7
    stitch = [r.line for r in project.stitcher_lines(first["output"], first["images"]).orderBy("place").collect()]
    assert stitch[0].startswith("p f2 w3000") and " v50 " in stitch[2] and "=" not in stitch[2]
    values = {(r.img_nr, r.name): r.value for r in project.optimised(project.read_lines(spark, str(tmp_path), "one.pto")).collect()}
    assert values[1, "v"] == 50.0 and values[0, "y"] == 0.25


def test_coordinates_and_image_lists(spark):
    lines = spark.createDataFrame([(0, "1 2"), (1, " 3.5   4 "), (2, "x 1"), (3, "1 2 3"), (4, "")], "place int, line string")
    assert [tuple(r)[2:] for r in project.coordinates(lines).orderBy("place").collect()] == [(1.0, 2.0), (3.5, 4.0)]
    assert [tuple(r)[1:] for r in project.coordinates(lines, True).collect()] == [(1, 2.0, 3.0)]
    files = spark.createDataFrame([("b10.jpg", 5, 5, 8), ("b9.jpg", 5, 5, 8), ("mask.tif", 5, 5, 1), ("bad.jpg", None, None, None), ("b9.jpg", 5, 5, 8)], "filename string, width int, height int, bits int")
    assert [r.filename for r in project.image_list(files).orderBy("img_nr").collect()] == ["b9.jpg", "b10.jpg"]
    long = spark.createDataFrame([("a1234567890129.tif",), ("a1234567890123.tif",), ("a99.tif",)], "n string")
    assert [r.n for r in long.orderBy(S.natural_key(F.col("n"))).collect()] == ["a99.tif", "a1234567890123.tif", "a1234567890129.tif"]


def test_feature_files_rigs_and_jobs(spark, tmp_path):
    points = spark.createDataFrame([(0, 0, 2.0, 1.0, 3.0, 4.0, 5.0, [0.1, 0.2]), (0, 1, 7.0, 6.0, 8.0, 9.0, 10.0, [1.0, 2.0])], "img_nr int, kp_id long, x double, y double, scale double, orientation double, score double, vec array<double>")
    images = spark.createDataFrame([(0, "a.jpg", 10, 20)], "img_nr int, filename string, width int, height int")
    text = [r.line for r in tables.keypoint_lines(points, images).orderBy("place").collect()]
    assert text[:2] == ["2", "2"] and text[-2:] == ["a.jpg", "10 20"]
    (tmp_path / "k.txt").write_text("\n".join([f"{text[0]} {text[1]}", *text[2:]]) + "\n")
    assert [(r.x, r.y, r.vec) for r in tables.read_keypoints(spark, str(tmp_path / "k.txt")).collect()] == [(2.0, 1.0, [0.1, 0.2]), (7.0, 6.0, [1.0, 2.0])]
    assert tables.keypoint_lines(points, images, "ellipses").orderBy("place").first().line == "2" and "<Dim>2</Dim>" in tables.keypoint_lines(points, images, "xml").filter("place = 2").first().line
    (tmp_path / "rig.xml").write_text('<rig><header><camera><sensor coef="1.6"/></camera><lens type=" Rectilinear "><focal>35</focal></lens></header><shoot><pict id="1" bracket="2"><time>x</time><position yaw="10.5" pitch="-3" roll="0"/></pict></shoot></rig>')
    assert tuple(tables.read_rig(spark, str(tmp_path / "rig.xml")).first())[1:] == (1, 2, 10.5, -3.0, 0.0)
    assert tuple(tables.read_rig_header(spark, str(tmp_path / "rig.xml")).first())[1:] == (1.6, "rectilinear", 35.0)
    (tmp_path / "b.txt").write_text("3\n/a.pto\npre\n1\n0\nF\n/b.pto\n\n2\n4\nT\n/half\n")
    jobs = tables.read_jobs(spark, str(tmp_path / "b.txt"))
    assert [tuple(r)[2:] for r in jobs.orderBy("place").collect()] == [("/a.pto", "pre", 1, 0, False), ("/b.pto", None, 2, 4, True)]
    assert [r.line for r in tables.job_lines(jobs).orderBy("place").collect()] == ["3", "/a.pto", "pre", "1", "0", "F", "/b.pto", "", "2", "4", "T"]


def test_lens_tables_are_kept_whole(spark, tmp_path):
    path = str(tmp_path / "db")
    rows = spark.createDataFrame([("L", 35.0, 50.0, 10)], "lens string, focallength double, hfov double, weight int")
    tables.write_lens_tables({"lens_hfov": rows}, path)
    db = tables.open_lens_tables(spark, path)
    assert db["lens_hfov"].count() == 1 and db["emor"].count() == 0 and db["lens_crop"].count() == 0
    more = tables.append_weighted(db["lens_hfov"], spark.createDataFrame([("M", 20.0, 80.0)], "lens string, focallength double, hfov double"))
    tables.replace_table(more, f"{path}/lens_hfov")
    assert sorted(tuple(r) for r in tables.open_lens_tables(spark, path)["lens_hfov"].collect()) == [("L", 35.0, 50.0, 10), ("M", 20.0, 80.0, 10)]
    spark.range(1).select(F.lit(99).alias("version")).write.mode("overwrite").parquet(f"{path}/version")
    with pytest.raises(ValueError, match="99"):
        tables.open_lens_tables(spark, path)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(Session())


def test_small_operators_on_nothing(spark):
    none = spark.createDataFrame([], "img_nr long, img1 long, img2 long, x1 double, y1 double, x2 double, y2 double, error double, mode int, k string")
    assert filters.vertical_points(none, "k", 3).count() == 0 and filters.plain_points(none).count() == 0 and filters.without_points(none.select("img_nr"), none).count() == 0
    assert statistics.best_scale(none, F.col("x1")).first().scale == 1.0
    lone = spark.createDataFrame([("a", 0.0, 0.0, 0.5, 100.0, 9.0), ("b", 0.0, 0.0, 50.0, 100.0, 9.0)], "k string, x1 double, y1 double, x2 double, y2 double, error double")
    assert [r.k for r in filters.vertical_points(lone, "k", 3).collect()] == ["a"]
    a = coverage.lens_assigned(spark.createDataFrame([(0, "A", 2.0, 1.0), (1, "A", 3.0, 2.0), (2, None, 5.0, 5.0)], "n int, m string, r double, b double"), "n", ["m"], "r", "b")
    assert sorted((r.n, r.anchor, r.r, r.b) for r in a.collect()) == [(0, 0, 1.0, 1.0), (1, 0, 1.5, 2.0), (2, 2, 1.0, 1.0)]


def test_vertical_points_join_and_rank_without_sorting_all_lines(spark):
    """Joins with one row a key hold that table and sort no lines; the first n come out as by hand, also with ties, empty values and fewer than n."""
    rng = random.Random(5)
    rows = [(k, 0.0, 0.0, rng.choice([0.0, 1.0]), float(rng.randint(0, 700)), rng.choice([0.0, rng.random(), None])) for k in range(12) for _ in range((k * k + 1) % 97)]
    rows += [(50, 0.0, 0.0, 3.0, 90.0, 0.4)] * 40 + [(51, 0.0, float(i), 0.0, 800.0 + i, 0.5) for i in range(30)] + [(52, 0.0, 0.0, 0.0, 9.0, 0.0)] * 3 + [(53, 0.0, 0.0, None, float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double, error double").repartition(3)
    want = []
    for key in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == key]
        errors = np.array([r[5] for r in of if r[5] is not None])
        if len(of) == 1:
            want += [(*of[0], 0.0)] if abs(of[0][3]) < 0.05 * math.hypot(of[0][3], of[0][4]) else []
            continue
        limit = errors.mean() + errors.std(ddof=1) if len(errors) > 1 else -1
        kept = [r for r in of if r[5] is not None and r[5] <= limit]
        most = max((r[5] for r in kept), default=0)
        length = lambda r: 500.0 if r[3] is None else min(math.hypot(r[3] - r[1], r[4] - r[2]), 500.0)
        merits = [(*r, r[5] / most + 1 - length(r) / 500) for r in kept] if most > 0 else []
        want += sorted(merits, key=lambda r: (r[6], *r[1:3], r[3] or 0.0, r[4]))[:4]
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = filters.vertical_points(df, "k", 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(None if v is None else round(v, 9) for v in r) for r in found.collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    text = lambda r: tuple(map(str, r))
    assert sorted(got, key=text) == sorted((tuple(None if v is None else round(v, 9) for v in r) for r in want), key=text) and len(got) > 40
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
