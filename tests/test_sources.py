from pyspark.sql import functions as F

from tessera.sources import project, tables
from tessera.streaming import windows

PROJECT = '''p f2 w3000 h1500 v360 n"TIFF_m c:LZW"
i w4000 h3000 f0 v50 r0 p0 y0 Eev10 a0.1 n"a 1.jpg"
i w4000 h3000 f0 v=0 r0 p0 y40 Eev11 a=0 Vm4 Vb0.5 n"a 2.jpg"
c n0 N1 x3500 y1500 X300 Y1502 t0
c n1 N0 x1 y2.5 X3 Y4
k i1 t0 p"0 0 100 0 100 100 0 100"
#word_outputStacksMinOverlap 0.7
'''


def test_project_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.pto").write_text(PROJECT)
    lines = project.read_lines(spark, str(tmp_path))
    one, two = sorted(project.images(lines).collect(), key=lambda r: r.img_nr)
    assert (one.filename, one.hfov, one.ev, one.dist) == ("a 1.jpg", 50.0, 10.0, [0.1, 0.0, 0.0])
    assert (two.filename, two.hfov, two.yaw, two.dist, two.vig_coeff) == ("a 2.jpg", 50.0, 40.0, [0.1, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])
    points = sorted(project.control_points(lines).collect(), key=lambda r: r.cp_id)
    assert [(r.img1, r.img2, r.x1, r.y1, r.x2, r.y2, r.mode) for r in points] == [(0, 1, 3500, 1500, 300, 1502, 0), (1, 0, 1, 2.5, 3, 4, 0)]
    assert len(project.masks(lines).first().poly) == 4 and project.options(lines).first()[1:] == ("outputStacksMinOverlap", "0.7")
    text = project.point_lines(project.control_points(lines)).withColumn("place", F.col("cp_id"))
    project.write_lines(text.withColumn("project_id", F.lit("p")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["c n0 N1 x3500 y1500 X300 Y1502 t0", "c n1 N0 x1 y2.5 X3 Y4 t0"]


def test_lens_blocks(spark, tmp_path):
    (tmp_path / "l.txt").write_text("TABLE=Hfov\nCOLUMNS=HFOV;Lens;FocalLength\n50;ACME;35\nbad;row\nx;B;3\nENDTABLE\nTABLE=Crop\nCOLUMNS=Cropfactor;Maker;Model\n1.5;ACME;X1\nENDTABLE\n")
    blocks = tables.read_lens_blocks(spark, str(tmp_path / "l.txt"))
    assert sorted(tuple(r) for r in tables.lens_table(blocks, "Hfov", "lens_hfov").collect() if r.hfov) == [("ACME", 35.0, 50.0, 10)]
    crop = tables.lens_table(blocks, "Crop", "camera_crop")
    assert tuple(crop.first()) == ("ACME", "X1", 1.5)
    tables.write_lens_table(crop, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "csv")).first().model == "X1"


def test_keypoints_and_pairs(spark, tmp_path):
    (tmp_path / "k.txt").write_text("2 3\n1 2 3 4 5 0.1 0.2 0.3\n6 7 8 9 10 1 2 3\nshort 1\n")
    rows = tables.read_keypoints(spark, str(tmp_path / "k.txt")).collect()
    assert [(r.y, r.x, r.vec) for r in rows] == [(1.0, 2.0, [0.1, 0.2, 0.3]), (6.0, 7.0, [1.0, 2.0, 3.0])]
    (tmp_path / "p.txt").write_text(" ".join(["1"] * 16) + "\n1 2\n")
    assert tables.read_photo_pairs(spark, str(tmp_path / "p.txt")).collect()[0].edge == 1.0


def test_streaming_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "value").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.windowed_stats(stream, "ts", "value", "1 day", None, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()
