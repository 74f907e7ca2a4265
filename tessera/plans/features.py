"""Registered queries of keypoints, corners, correlation and files' heads: pictures are the tables' own rows counted by place, one a band of orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlation, keypoints
from ..session import cut
from ..sources import exif
from .queries import query, table

WIDE, HIGH = 96, 80
_PICTURES = f"""p AS (SELECT l_orderkey // 20000 AS img, l_orderkey % {WIDE} AS x, l_partkey % {HIGH} AS y, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
    size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY 1),
    g AS (SELECT img, x, y, coalesce(v, 0) AS v FROM (SELECT img, x, y FROM size, range({WIDE}) a(x), range({HIGH}) b(y) WHERE x < w AND y < h) LEFT JOIN p USING (img, x, y)),
    s AS (SELECT img, x, y, sum(r) OVER (PARTITION BY img, x ORDER BY y) AS s FROM (SELECT img, x, y, sum(v) OVER (PARTITION BY img, y ORDER BY x) AS r FROM g))"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    keys = [F.expr("l_orderkey DIV 20000").alias("img"), (F.col("l_orderkey") % WIDE).alias("x"), (F.col("l_partkey") % HIGH).alias("y")]
    return t.groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("v"))


def _corners_sql(scale: int) -> str:
    """Places whose running sums make the three derivatives at a place, with their weights."""
    size = keypoints.filter_size(0, scale)
    mid, wide = size // 2, 2 * (size // 2)
    far, d = mid + size, (3 * size - 1) // 2 - 1
    shapes = {
        0: [(1, -far, far, -wide, wide), (-3, -mid, mid, -wide, wide)],
        1: [(1, -wide, wide, -far, far), (-3, -wide, wide, -mid, mid)],
        2: [(1, 0, d, 0, d), (1, -d, 0, -d, 0), (-1, 0, d, -d, 0), (-1, -d, 0, 0, d)],
    }
    rows: dict[tuple[int, int], list[int]] = {}
    for k, boxes in shapes.items():
        for w, x0, x1, y0, y1 in boxes:
            for x, y, sign in ((x1, y1, 1), (x0 - 1, y0 - 1, 1), (x0 - 1, y1, -1), (x1, y0 - 1, -1)):
                rows.setdefault((x, y), [0, 0, 0])[k] += sign * w
    return ", ".join(f"({scale}, {size}, {keypoints.border(0, scale)}, {x}, {y}, {a}, {b}, {c})" for (x, y), (a, b, c) in rows.items())


_HESSIAN = f"""c(scale, size, b, dx, dy, a, e, f) AS (VALUES {', '.join(_corners_sql(s) for s in range(5))}),
    d AS (SELECT q.img, q.x, q.y, scale, size, sum(a * coalesce(s, 0))::DOUBLE AS xx, sum(e * coalesce(s, 0))::DOUBLE AS yy, sum(f * coalesce(s, 0))::DOUBLE AS xy
        FROM (SELECT img, g.x, g.y, c.* FROM g JOIN size USING (img), c WHERE g.x >= b AND g.x < w - b AND g.y >= b AND g.y < h - b) q LEFT JOIN s ON s.img = q.img AND s.x = q.x + dx AND s.y = q.y + dy GROUP BY ALL)"""


@query(f"WITH {_PICTURES}, {_HESSIAN} SELECT img, x, y, scale, round((xx * yy - 0.36 * xy * xy) * 81 / (size * size * size * size) / 1000, 4) + 0.0 AS score FROM d")
def hessian_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all places of all pictures at the first octave's five scales, in thousands."""
    found = keypoints.scores(_pictures(spark, sf_dir), 0, tile=64)
    return found.select("img", "x", "y", "scale", (F.round(F.col("score") / 1000, 4) + 0.0).alias("score"))


@query()
def picture_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of all pictures."""
    return keypoints.detect(cut(_pictures(spark, sf_dir)), tile=64).select("img", "id", *(F.round(c, 6).alias(c) for c in ("x", "y", "scale")), F.round("score", 3).alias("score"), "trace")


@query()
def picture_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions and descriptors of all pictures' keypoints."""
    pixels = cut(_pictures(spark, sf_dir))
    points = keypoints.detect(pixels, tile=64)
    found = keypoints.described(pixels, keypoints.oriented(pixels, points))
    return found.select("img", "id", "turn", F.round("ori", 6).alias("ori"), F.transform("vec", lambda v: F.round(v, 6) + 0.0).alias("vec"))


_PARTS = "SELECT p_partkey AS id, CAST(p_partkey % 3 AS BIGINT) AS a, CAST((p_partkey + 1) % 3 AS BIGINT) AS b, CAST(p_partkey % 41 + 5 AS BIGINT) AS x, CAST(p_size % 37 + 6 AS BIGINT) AS y, CAST(p_partkey % 43 AS BIGINT) AS nx, CAST(p_size AS BIGINT) AS ny FROM part"


@query(f"""
WITH g AS (SELECT l_orderkey % 3 AS img, l_partkey % 53 AS x, l_suppkey % 10 * 6 + l_linenumber % 6 AS y, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
    size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY 1), asked AS ({_PARTS}),
    inside AS (SELECT asked.*, t.w, t.h FROM asked JOIN size f ON f.img = a JOIN size t ON t.img = b WHERE x >= 2 AND y >= 2 AND x + 2 < f.w AND y + 2 < f.h),
    o AS (SELECT i, j FROM range(-2, 3) p(i), range(-2, 3) q(j)),
    k AS (SELECT id, i, j, coalesce(v, 0) AS k FROM inside, o LEFT JOIN g ON g.img = a AND g.x = inside.x + i AND g.y = inside.y + j),
    c AS (SELECT id, b, m.x, m.y FROM inside, LATERAL (SELECT nx + u.d AS x, ny + z.d AS y FROM range(-2, 3) u(d), range(-2, 3) z(d)) m WHERE m.x >= 2 AND m.y >= 2 AND m.x + 2 < w AND m.y + 2 < h),
    n AS (SELECT c.id, c.x, c.y, 25 * sum(k * coalesce(v, 0)) - sum(k) * sum(coalesce(v, 0)) AS n, 25 * sum(k * k) - sum(k) * sum(k) AS d1, 25 * sum(coalesce(v, 0) * coalesce(v, 0)) - sum(coalesce(v, 0)) * sum(coalesce(v, 0)) AS d2
        FROM c JOIN k USING (id) LEFT JOIN g ON g.img = c.b AND g.x = c.x + i AND g.y = c.y + j GROUP BY 1, 2, 3)
SELECT id, round(max(CASE WHEN d1 > 0 AND d2 > 0 THEN n / sqrt(d1::DOUBLE * d2) ELSE 0 END), 6) AS best FROM n GROUP BY id
""")
def correlated_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best coefficient of a square around each part's place in one picture among the places near another one in the next picture."""
    t = table(spark, sf_dir, "lineitem")
    place = [(F.col("l_orderkey") % 3).alias("img"), (F.col("l_partkey") % 53).alias("x"), (F.col("l_suppkey") % 10 * 6 + F.col("l_linenumber") % 6).alias("y")]
    pixels = t.groupBy(*place).agg(F.sum("l_quantity").cast("long").alias("v"))
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    asked = table(spark, sf_dir, "part").select((key % 3).alias("img"), F.col("p_partkey").alias("id"), (key % 41 + 5).alias("x"), (size % 37 + 6).alias("y"), ((key + 1) % 3).alias("to"), (key % 43).alias("near_x"), size.alias("near_y"))
    found = correlation.located(pixels, asked, 2, 2)
    return found.select("id", (F.round("best", 6) + 0.0).alias("best"))


@query()
def picture_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest corners of each cell of the pictures."""
    return correlation.corners(_pictures(spark, sf_dir), 32, 2.0, 10).select("img", "cx", "cy", "x", "y", F.round("response", 6).alias("response"), "rank")


def _shots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        heads = []
        for key, brand, size in zip(*(t.column(c).to_pylist() for c in ("p_partkey", "p_brand", "p_size")), strict=True):
            tags = {"make": brand, "orientation": (1, 3, 6, 8)[key % 4], "focal_length": float(size), "focal_length_35": 2 * size if key % 3 else None, "f_number": 1 + size / 10}
            tags |= {"iso": 100.0 * (key % 8) if key % 5 else None, "shutter_speed": float(key % 6), "pixels_x": 400 if key % 7 else 300, "pixels_y": 300 if key % 7 else 400, "per_unit_x": 200.0, "per_unit_y": 200.0, "unit": 3}
            heads.append(exif.encoded(tags, "<" if key % 2 else ">", (400, 300) if key % 11 else (400, 200)))
        yield pa.RecordBatch.from_arrays([t.column("p_partkey"), pa.array(heads, pa.binary())], ["id", "head"])


@query("""
WITH p AS (SELECT *, p_partkey % 4 AS o, CASE WHEN p_partkey % 3 <> 0 THEN 2.0 * p_size END AS full_, CASE WHEN p_partkey % 11 <> 0 THEN 300 ELSE 200 END AS h FROM part)
SELECT p_partkey AS id, p_brand AS make, round(pow(2, -(p_partkey % 6)), 9) AS exposure_s, round(1 + p_size / 10.0, 6) AS aperture_f, CASE WHEN p_partkey % 5 <> 0 THEN 100.0 * (p_partkey % 8) ELSE 0 END::DOUBLE AS speed,
    CASE WHEN abs(CASE WHEN p_partkey % 7 <> 0 THEN 4 / 3 ELSE 3 / 4 END - 400 / h) > 0.1 THEN 0 ELSE CASE o WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 270 ELSE 0 END END AS roll,
    p_size::DOUBLE AS focal_mm, coalesce(full_, 0)::DOUBLE AS focal_35_mm, round(CASE WHEN full_ > 0 THEN full_ / p_size ELSE sqrt(36 * 36 + 24 * 24) / sqrt(400 * 400 + 300 * 300) * 20 END, 6) AS crop, CASE WHEN h = 200 THEN 'equirectangular' END AS projection
FROM p
""")
def exif_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as the head of a JPEG file, read back, and what an image takes from it."""
    id_type = dict(table(spark, sf_dir, "part").dtypes)["p_partkey"]
    heads = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").mapInArrow(_shots, f"id {id_type}, head binary")
    found = exif.camera(exif.parsed(heads, "head"))
    return found.select("id", "make", F.round("exposure_s", 9).alias("exposure_s"), F.round("aperture_f", 6).alias("aperture_f"), "speed", "roll", "focal_mm", "focal_35_mm", F.round("crop", 6).alias("crop"), "projection")
