"""Lens-database look-ups: weighted means by key, the nearest keys, and interpolation between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_range, interpolate, interpolate_plane, near_single
from .ranking import nearest
from .statistics import weighted_mean


def look_up(table: DataFrame, key: str, value: str, weight: str, target: float, least: float | None = None) -> DataFrame:
    """found, value at target: from the weighted means of the two nearest keys.

    One key alone counts within 0.075 of target; of two, target must lie between them, or within 0.15 of
    the nearer. ``least``: smaller values count as not found.
    """
    near = nearest(weighted_mean(table, weight, [value], key), 2, key, target)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = near.agg(F.count("*").alias("n"), at(1, key).alias("k1"), at(1, value).alias("v1"), at(2, key).alias("k2"), at(2, value).alias("v2"))
    x1, y1, x2, y2 = (F.col(c) for c in ("k1", "v1", "k2", "v2"))
    single = F.when((F.col("n") == 1) & near_single(x1, target), y1)
    both = F.when((F.col("n") == 2) & in_range(x1, x2, target, 0.15), interpolate(x1, y1, x2, y2, target))
    value_ = F.coalesce(single, both)
    if least is not None:
        value_ = F.when(value_ >= least, value_)
    return two.select(value_.isNotNull().alias("found"), value_.alias(value))


def nearest_grid(table: DataFrame, first: str, second: str, values: list[str], weight: str, x: float, y: float, *keys: str) -> DataFrame:
    """Weighted means at the two nearest first keys to x and, for each, the two nearest second keys to y (of each of keys)."""
    means = weighted_mean(table, weight, values, *keys, first, second)
    firsts = nearest(means.select(*keys, first).distinct(), 2, first, x, list(keys)).drop("rank")
    return nearest(means.join(firsts, [*keys, first]), 2, second, y, [*keys, first])


def interpolate_grid(grid: DataFrame, first: str, second: str, value: str, x: float, y: float, *keys: str) -> DataFrame:
    """Value at (x, y) of each of keys from :func:`nearest_grid`: along the second key, then along the first."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    lines = grid.groupBy(*keys, first).agg(at(1, second).alias("s1"), at(1, value).alias("v1"), at(2, second).alias("s2"), at(2, value).alias("v2"))
    lines = lines.select(*keys, first, F.when(F.col("s2").isNull(), F.col("v1")).otherwise(interpolate(F.col("s1"), F.col("v1"), F.col("s2"), F.col("v2"), y)).alias("v"))
    near = nearest(lines, 2, first, x, list(keys))
    two = near.groupBy(*keys).agg(at(1, first).alias("k1"), at(1, "v").alias("v1"), at(2, first).alias("k2"), at(2, "v").alias("v2"))
    return two.select(*keys, F.when(F.col("k2").isNull(), F.col("v1")).otherwise(interpolate(F.col("k1"), F.col("v1"), F.col("k2"), F.col("v2"), x)).alias(value))


def _two_nearest(keyed: Column, x: Column) -> Column:
    """The two entries of an array of structs (k first) whose k is nearest to x; of equal ones the smaller k."""
    apart = F.transform(keyed, lambda e: F.struct(F.abs(e["k"] - x).alias("d"), e["k"].alias("k"), e.alias("e")))
    return F.transform(F.slice(F.array_sort(apart), 1, 2), lambda e: e["e"])


def look_up_all(images: DataFrame, image: str, focal: str, table: DataFrame, lens: str, key: str, values: str | list[str], weight: str) -> DataFrame:
    """image, values: as :func:`look_up` for every image at once, in the rows of its own lens; null where nothing fits.

    The table is brought to weighted means, then to one sorted array a lens, of as many entries as the lens has focal
    lengths. So an image meets one row, however popular its lens is, and all values come out together.
    """
    values = [values] if isinstance(values, str) else values
    means = weighted_mean(table, weight, values, lens, key).filter(F.col(key).isNotNull())
    keyed = means.groupBy(lens).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values))))).alias("_keyed"))
    near = images.select(image, lens, F.col(focal).alias("_x")).join(keyed, lens, "left").withColumn("_near", _two_nearest(F.col("_keyed"), F.col("_x")))
    x, a, b = F.col("_x"), F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    one, two = b.isNull() & near_single(a["k"], x), b.isNotNull() & in_range(a["k"], b["k"], x, 0.15)
    at = lambda i: F.when(one, a[f"v{i}"]).when(two, interpolate(a["k"], a[f"v{i}"], b["k"], b[f"v{i}"], x))
    return near.select(image, *(at(i).alias(v) for i, v in enumerate(values)))


def point(table: DataFrame, asked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """asked with the table's value of equal keys; null where there is none."""
    return asked.join(table.select(*keys, value), keys, "left")


def look_up_crop(images: DataFrame, image: str, focal: str, crops: DataFrame, same: list[str], key: str, sides: list[str]) -> DataFrame:
    """image, sides: the crop of the two rows nearest by key among those equal in ``same`` (lens, width, height), between them by a line
    and rounded. One row alone must be strictly within 0.075 of the focal length; of two, as in :func:`look_up`."""
    keyed = crops.groupBy(*same).agg(F.collect_list(F.struct(F.col(key).alias("k"), *sides)).alias("_keyed"))
    near = images.select(image, *same, F.col(focal).alias("_x")).join(keyed, same, "left").withColumn("_near", _two_nearest(F.col("_keyed"), F.col("_x")))
    x, a, b = F.col("_x"), F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    one, two = b.isNull() & near_single(a["k"], x, strict=True), b.isNotNull() & in_range(a["k"], b["k"], x, 0.15)
    at = lambda c: F.when(one, a[c]).when(two, F.round(interpolate(a["k"], a[c].cast("double"), b["k"], b[c].cast("double"), x)).cast("int"))
    return near.select(image, *(at(c).alias(c) for c in sides))


def look_up_vignetting(images: DataFrame, image: str, lens: str, focal: str, aperture: str, table: DataFrame, values: list[str], weight: str, first: str = "focallength", second: str = "aperture") -> DataFrame:
    """image, values: from the weighted means at the two focal lengths nearest to the image's and, at each, the two nearest apertures:

    one row, near in both; two of one focal length, along the aperture; two of two, along the focal length, if the
    aperture there is near; three, by the plane through them; four, along the aperture of each, then along the focal
    length. An aperture of 0 is unknown: any will do, the smallest of each focal length is taken. Null where nothing fits.
    """
    means = weighted_mean(table, weight, values, lens, first, second).filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    names = [f"v{i}" for i in range(len(values))]
    lines = means.groupBy(lens, first).agg(F.collect_list(F.struct(F.col(second).alias("k"), *(F.col(v).alias(n) for v, n in zip(values, names, strict=True)))).alias("rows"))
    keyed = lines.groupBy(lens).agg(F.collect_list(F.struct(F.col(first).alias("k"), "rows")).alias("_keyed"))
    near = images.select(image, lens, F.col(focal).alias("_x"), F.col(aperture).alias("_y")).join(keyed, lens, "left")
    x, y = F.col("_x"), F.col("_y")
    near = near.withColumn("_lines", F.array_sort(_two_nearest(F.col("_keyed"), x), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1)))
    ordered = lambda rows: F.array_sort(_two_nearest(rows, y))
    flat = F.flatten(F.transform("_lines", lambda e: F.transform(ordered(e["rows"]), lambda r: F.struct(e["k"].alias("f"), r["k"].alias("a"), *(r[n].alias(n) for n in names)))))
    near = near.withColumn("_r", F.when(F.col("_lines").isNotNull(), flat)).withColumn("_n", F.coalesce(F.size("_r"), F.lit(0)))
    r = [F.get("_r", F.lit(k)) for k in range(4)]
    unknown = F.abs(y) < 0.001
    between = lambda a, b: (a["a"] - 0.3 <= y) & (y <= b["a"] + 0.3)
    along_y = lambda a, b, n: interpolate(a["a"], a[n], b["a"], b[n], y)
    along_x = lambda a, b, u, v: interpolate(a["f"], u, b["f"], v, x)
    # the range is asked of the nearer focal length first
    reach = lambda a, b: in_range(a["f"], b["f"], x, 0.15)

    def value(n: str) -> Column:
        one = F.when((F.abs(r[0]["f"] - x) <= 0.075 * x) & (unknown | (F.abs(r[0]["a"] - y) < 0.3)), r[0][n])
        level = F.abs(r[0]["f"] - r[1]["f"]) < 0.001
        same = F.when(unknown, r[0][n]).when(between(r[0], r[1]), along_y(r[0], r[1], n))
        there = interpolate(r[0]["f"], r[0]["a"], r[1]["f"], r[1]["a"], x)
        across = F.when(reach(r[0], r[1]) & (unknown | (F.abs(there - y) < 0.3)), along_x(r[0], r[1], r[0][n], r[1][n]))
        three = F.when(reach(r[0], r[2]), interpolate_plane(x, y, *((q["f"], q["a"], q[n]) for q in r[:3])))
        inside = between(r[0], r[1]) & between(r[2], r[3])
        four = F.when(unknown, along_x(r[0], r[2], r[0][n], r[2][n])).when(inside, along_x(r[0], r[2], along_y(r[0], r[1], n), along_y(r[2], r[3], n)))
        four = F.when(reach(r[0], r[2]), four)
        return F.when(F.col("_n") == 1, one).when(F.col("_n") == 2, F.when(level, same).otherwise(across)).when(F.col("_n") == 3, three).when(F.col("_n") == 4, four)

    return near.select(image, *(value(n).alias(v) for v, n in zip(values, names, strict=True)))


def save_crop(crops: DataFrame, rows: DataFrame, keys: list[str], sides: tuple[str, str, str, str]) -> DataFrame:
    """crops with rows in place of those of equal keys; a row with an empty rectangle (left, right, top, bottom) only takes them away."""
    left, right, top, bottom = sides
    empty = (F.col(left) >= F.col(right)) | (F.col(top) >= F.col(bottom))
    return crops.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.filter(~empty))


def populate(images: DataFrame, points: DataFrame, project: str = "project_id") -> dict[str, DataFrame]:
    """Rows for the lens tables from projects of two images or more and one lens part (column lens_part), by their first image:

    projection always; hfov where the mean error of the control points is under 15, and distortion if its coefficients are plausible, too;
    vignetting if all apertures agree within 0.05 and its coefficients add up to over 0.5 and at most 1.01. Weight 10.
    images: img_nr, lens, lens_part, focallength, projection, hfov, aperture, distance, dist (a, b, c), vig_coeff; points: error.
    """
    first = F.min_by(F.struct(*(c for c in images.columns if c != project)), "img_nr").alias("i")
    lenses = images.groupBy(project).agg(first, F.count("*").alias("n"), F.countDistinct("lens_part").alias("parts"), F.max("aperture").alias("hi"), F.min("aperture").alias("lo"))
    lenses = lenses.filter("n >= 2 AND parts = 1 AND i.lens <> '' AND i.focallength > 0")
    means = points.groupBy(project).agg(F.avg("error").alias("mean"))
    # a project without points has no error to speak against it
    known = lenses.join(means, project, "left").withColumn("good", F.coalesce(F.col("mean") < 15, F.lit(True)))
    a, b, c = (F.col("i.dist")[k] for k in range(3))
    total = F.aggregate("i.vig_coeff", F.lit(0.0), lambda s, x: s + x)
    key, weight = [F.col("i.lens").alias("lens"), F.col("i.focallength").alias("focallength")], F.lit(10).alias("weight")
    same = (F.abs(F.col("hi") - F.col("i.aperture")) < 0.05) & (F.abs(F.col("lo") - F.col("i.aperture")) < 0.05)
    return {
        "lens_projection": known.select(key[0], F.col("i.projection").alias("projection")).dropDuplicates(["lens"]),
        "lens_hfov": known.filter("good").select(*key, F.col("i.hfov").alias("hfov"), weight),
        "distortion": known.filter("good").filter((F.abs(a) + F.abs(b) + F.abs(c) > 0.001) & (F.abs(a + b + c) < 0.1)).select(*key, a.alias("a"), b.alias("b"), c.alias("c"), weight),
        "vignetting": known.filter(same & (total > 0.5) & (total <= 1.01)).select(*key, F.col("i.aperture").alias("aperture"), F.col("i.distance").alias("distance"), *(F.col("i.vig_coeff")[k].alias(n) for k, n in ((1, "vb"), (2, "vc"), (3, "vd"))), weight),
    }


def fill(images: DataFrame, found: DataFrame, image: str, value: str) -> DataFrame:
    """images with their own value, or else the one that was looked up."""
    return images.join(found.withColumnRenamed(value, "_found"), image, "left").withColumn(value, F.coalesce(value, "_found")).drop("_found")
