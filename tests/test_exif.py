import struct

import pytest

from tessera.sources import exif

SHOT = {"make": "Maker", "model": "One Two", "orientation": 6, "exposure_time": 0.0125, "f_number": 5.6, "iso": 200.0, "date": "2020:01:02 03:04:05", "focal_length": 18.5, "focal_length_35": 28, "lens": "18-55", "pixels_x": 400, "pixels_y": 300, "distance": 2.5}


def xmp(**values):
    body = b"http://ns.adobe.com/xap/1.0/\0<x " + b" ".join(f'GPano:{k}="{v}"'.encode() for k, v in values.items()) + b"/>"
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jpg").write_bytes(exif.encoded(SHOT, jpeg=(400, 300)) + b"pixels" * 1000)
    (tmp_path / "b.tif").write_bytes(exif.encoded(SHOT | {"width": 40, "height": 30, "orientation": 3}, ">"))
    (tmp_path / "sub").mkdir()
    whole = exif.encoded({"make": "Pano", "shutter_speed": 3.0, "aperture": 4.0}, jpeg=(400, 150))
    pano = xmp(ProjectionType="Equirectangular", CroppedAreaImageWidthPixels=400, CroppedAreaImageHeightPixels=150, FullPanoWidthPixels=800, FullPanoHeightPixels=400, CroppedAreaTopPixels=100)
    (tmp_path / "sub" / "c.jpg").write_bytes(whole[:2] + pano + whole[2:])
    (tmp_path / "d.txt").write_bytes(b"nothing of the kind")
    (tmp_path / "e.jpg").write_bytes(exif.encoded(SHOT, jpeg=(400, 300))[:90])
    (tmp_path / "f.jpg").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    loop = exif.encoded({"make": "x" * 40})
    (tmp_path / "g.tif").write_bytes(loop[:8] + struct.pack("<H", 65535) + loop[10:])
    (tmp_path / "h.jpg").write_bytes(b"\xff\xd8\xff\xff\xff\xe0\0\2" + exif.encoded({}, jpeg=(20, 10))[2:])
    return tmp_path


def read(spark, folder, **options):
    exif.register(spark)
    return spark.read.format("exif").load(str(folder))


def test_heads_are_read(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in read(spark, folder).collect()}
    assert set(rows) == {"a.jpg", "b.tif", "c.jpg", "d.txt", "e.jpg", "f.jpg", "g.tif", "h.jpg"}
    for k, v in SHOT.items():
        assert rows["a.jpg"][k] == v and (k == "orientation" or rows["b.tif"][k] == v)
    assert (rows["a.jpg"].width, rows["a.jpg"].height, rows["b.tif"].width, rows["b.tif"].orientation) == (400, 300, 40, 3)
    assert rows["a.jpg"].error is None and rows["a.jpg"].pano is None and rows["c.jpg"].pano["FullPanoWidthPixels"] == "800"
    assert (rows["h.jpg"].width, rows["h.jpg"].make) == (20, None)
    assert rows["d.txt"].error == "neither JPEG nor TIFF" and all(rows[k].error for k in ("e.jpg", "f.jpg", "g.tif"))


def test_named_columns_only(spark, folder):
    exif.register(spark)
    some = spark.read.format("exif").schema("make string, path string").load(str(folder / "a.jpg"))
    assert [tuple(r) for r in some.collect()] == [("Maker", str(folder / "a.jpg"))]
    assert spark.read.format("exif").schema("path string").load(str(folder)).count() == 8
    with pytest.raises(Exception, match="no such fields"):
        spark.read.format("exif").schema("colour string").load(str(folder)).collect()
    (folder / "empty").mkdir()
    assert read(spark, folder / "empty").count() == 0


def test_what_images_take(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in exif.camera(read(spark, folder)).collect()}
    a, c = rows["a.jpg"], rows["c.jpg"]
    assert (a.exposure_s, a.aperture_f, a.speed, a.roll, a.focal_mm, a.focal_35_mm) == (0.0125, 5.6, 200.0, 90, 18.5, 28.0) and abs(a.crop - 28 / 18.5) < 1e-12 and a.projection is None
    assert (c.exposure_s, c.aperture_f, c.roll, c.crop) == (0.125, 4.0, 0, 0.0)
    assert (c.projection, c.hfov_deg, c.shift_e) == ("equirectangular", 180.0, 25.0)
    assert (rows["h.jpg"].projection, rows["h.jpg"].hfov_deg) == ("equirectangular", 360.0) and rows["d.txt"].crop == 0
    turned = spark.createDataFrame([(1, bytearray(exif.encoded(SHOT, jpeg=(300, 400)))), (2, None)], "id int, head binary")
    one, none = exif.camera(exif.parsed(turned, "head")).orderBy("id").collect()
    assert one.roll == 0 and one.pixels_x == 400 and none.make is None and none.error is None and none.crop == 0
    plane = exif.encoded({"per_unit_x": 4000.0, "per_unit_y": 4000.0, "unit": 3, "focal_length_35": None, "focal_length": 10.0}, ">", (1440, 960))
    p = exif.camera(exif.parsed(spark.createDataFrame([(bytearray(plane),)], "head binary"), "head")).first()
    assert abs(p.crop - (36**2 + 24**2) ** 0.5 / (3.6**2 + 2.4**2) ** 0.5) < 1e-9


def test_no_damage_crashes():
    whole = exif.encoded(SHOT, jpeg=(400, 300))
    for n in range(len(whole)):
        exif.read_head(__import__("io").BytesIO(whole[:n]))
        for b in (0, 255):
            exif.read_head(__import__("io").BytesIO(whole[:n] + bytes([b]) + whole[n + 1 :]))
