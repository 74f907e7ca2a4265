"""Overlap of images, shared points, stacks by links, and masks on long pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import once


def overlap_ratios(images: DataFrame, steps: int = 10, bin_size: float = 100.0) -> DataFrame:
    """i, j, ratio: share of i's sample grid (steps x steps cell centres) that lies in j; pairs without a hit are left out.

    images: img_nr and a rectangle (left, top, right, bottom; right and bottom excluded). Points and rectangles meet by the
    bins of the plane that they fall in, so images far apart are never compared.
    """
    cells = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    grid = images.select("*", cells.alias("_a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_b"))
    point = lambda low, high, k: F.col(low) + (F.col(high) - F.col(low)) * (F.col(k) + 0.5) / steps
    cell = lambda c: F.floor(c / bin_size)
    points = grid.select(F.col("img_nr").alias("i"), point("left", "right", "_a").alias("x"), point("top", "bottom", "_b").alias("y")).withColumn("bx", cell(F.col("x"))).withColumn("by", cell(F.col("y")))
    areas = images.select(F.col("img_nr").alias("j"), "left", "top", "right", "bottom", F.explode(F.sequence(cell(F.col("left")), cell(F.col("right")))).alias("bx"))
    areas = areas.select("*", F.explode(F.sequence(cell(F.col("top")), cell(F.col("bottom")))).alias("by"))
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    hits = points.join(areas, ["bx", "by"]).filter(inside & (F.col("i") != F.col("j")))
    return hits.groupBy("i", "j").agg((F.count("*") / F.lit(steps * steps)).alias("ratio"))


def symmetric_overlap(ratios: DataFrame) -> DataFrame:
    """i < j and the larger ratio of both directions."""
    return ratios.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("ratio").alias("ratio"))


def shared_point(images: DataFrame, pairs: DataFrame, steps: int = 11) -> DataFrame:
    """i, j, x, y: of i's grid points that lie in j, the one nearest to i's centre (ties: smaller y, then x)."""
    i = pairs.join(images.withColumnsRenamed({c: f"i_{c}" for c in images.columns}), F.col("i") == F.col("i_img_nr"))
    both = i.join(images, F.col("j") == F.col("img_nr"))
    at = lambda low, high, k: F.col(low) + (F.col(high) - F.col(low)) * F.col(k) / (steps - 1)
    grid = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_b"))
    p = grid.select("i", "j", at("i_left", "i_right", "_a").alias("x"), at("i_top", "i_bottom", "_b").alias("y"), "left", "top", "right", "bottom", ((F.col("i_left") + F.col("i_right")) / 2).alias("cx"), ((F.col("i_top") + F.col("i_bottom")) / 2).alias("cy"))
    p = p.filter((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    d = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    best = p.groupBy("i", "j").agg(F.min_by(F.struct("x", "y"), F.struct(F.round(d, 6), "y", "x")).alias("p"))
    return best.select("i", "j", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def lens_anchor(images: DataFrame, number: str, *same: str) -> DataFrame:
    """images with anchor: the first image equal to each in the attributes, null as equal to null (itself where it is the first).

    First images are aggregated before the shuffle, and joined back in a way that Spark can split: a common lens is no hot task.
    """
    first = images.groupBy(*same).agg(F.min(number).alias("anchor")).withColumnsRenamed({c: f"_{c}" for c in same})
    return images.join(first.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]).select(*images.columns, "anchor")


def lens_assigned(images: DataFrame, number: str, same: list[str], red: str, blue: str) -> DataFrame:
    """images with anchor, red and blue over the anchor's own (white balance stays an image's own, relative to its lens's first image)."""
    known = lens_anchor(images, number, *same)
    base = images.select(F.col(number).alias("anchor"), F.col(red).alias("_r"), F.col(blue).alias("_b"))
    ratio = lambda c, b: F.coalesce(F.try_divide(F.col(c), F.col(b)), F.lit(1.0)).alias(c)
    rest = [c for c in known.columns if c not in (red, blue)]
    return known.join(base.hint("merge"), "anchor").select(*rest, ratio(red, "_r"), ratio(blue, "_b"))


def possible_stacks(images: DataFrame, key: str, number: str, layer: Column) -> DataFrame:
    """stack: a new one begins at each member of layer 0, in order of number."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return images.withColumn("stack", F.sum((layer == 0).cast("int")).over(w))


def spread_masks(masks: DataFrame, members: DataFrame) -> DataFrame:
    """Masks for every image of the stack (or lens) of the image they are on; equal ones once. members: img_nr, part."""
    own = masks.join(members, "img_nr").drop("img_nr")
    return own.join(members, "part").drop("part").distinct()


def widest_gap(columns: DataFrame, column: str, full: int) -> DataFrame:
    """start, width of the longest run of columns (0 to full - 1, round the circle) without a row; one row, none if all are covered."""
    seen = columns.select((F.col(column) % full).alias("c")).distinct()
    # at most full rows, a fixed number
    w = Window.orderBy("c")
    gaps = seen.select("c", F.coalesce(F.lead("c").over(w), F.min("c").over(Window.partitionBy()) + full).alias("n")).select(((F.col("c") + 1) % full).alias("start"), (F.col("n") - F.col("c") - 1).alias("width"))
    return gaps.filter("width > 0").orderBy(F.col("width").desc(), "start").limit(1)


def threshold_masks(weights: DataFrame, threshold: float) -> DataFrame:
    """img, x, y, keep: weight over the threshold; where no image's is, the image of the largest weight (ties: the last)."""
    best = weights.groupBy("x", "y").agg(F.max(F.struct("weight", "img")).alias("b"))
    both = weights.join(best, ["x", "y"])
    return both.select("img", "x", "y", ((F.col("weight") > threshold) | ((F.col("b.weight") <= threshold) & (F.col("b.img") == F.col("img")))).alias("keep"))


def denoise(mask: DataFrame, width: int, height: int) -> DataFrame:
    """x, y, v (0 or 255): with over six white of its eight neighbours white, over six black black; borders stay."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    near = mask.select(F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("p"), F.col("v").alias("q")).groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count_if(F.col("q") == 255).alias("white"), F.count_if(F.col("q") == 0).alias("black"))
    inner = F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)
    new = F.when(inner & (F.col("white") > 6), 255).when(inner & (F.col("black") > 6), 0).otherwise(F.col("v"))
    return mask.join(near, ["x", "y"], "left").select("x", "y", new.alias("v"))


def radius_sample(pairs: DataFrame, radius: str, edge: str, bins: int = 10, n: int = 100, *keys: str) -> DataFrame:
    """Of each radius bin (0 to 1) the n pairs with the least edge value."""
    binned = pairs.withColumn("bin", F.least(F.floor(F.col(radius) * bins), F.lit(bins - 1)))
    w = Window.partitionBy(*keys, "bin").orderBy(edge, *[c for c in pairs.columns if c != edge])
    return binned.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def good_pairs(pairs: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Pairs whose largest components are in [1/255, 250/255] at both ends."""
    ok = lambda cs: F.greatest(*cs).between(1 / 255, 250 / 255)
    return pairs.filter(ok(a) & ok(b))


def monotone(values: Column) -> Column:
    """A look-up table made non-decreasing: each value the largest so far."""
    first = F.struct(F.lit(float("-inf")).alias("m"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct(F.greatest(acc["m"], x).alias("m"), F.concat(acc["out"], F.array(F.greatest(acc["m"], x))).alias("out"))
    return F.aggregate(values, first, step)["out"]


def covariance(df: DataFrame, *axes: str) -> DataFrame:
    """Mean products of all pairs of axes, in one row: columns a_b."""
    return df.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in axes for b in axes if a <= b))


def polygon_centre(poly: Column) -> Column:
    """Centroid struct<x, y> of array<struct<x, y>>; null for an area of 0."""
    part = lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"])

    def centre(poly: Column) -> Column:
        turned = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
        along = lambda c: F.aggregate(F.zip_with(poly, turned, lambda a, b: (a[c] + b[c]) * part(a, b)), F.lit(0.0), lambda s, x: s + x)
        area = F.nullif(polygon_area(poly) * 6, F.lit(0.0))
        return once(area, lambda area: F.when(area.isNotNull(), F.struct((along("x") / area).alias("x"), (along("y") / area).alias("y"))))

    return once(poly, centre)


def output_boxes(images: DataFrame, place, steps: int = 20) -> DataFrame:
    """img_nr, left, top, right, bottom of what an image covers in the panorama, from a grid of its points. place: (x, y) Columns to Columns, over
    the image's columns and x, y (pixels from its centre); null points are outside. Images without a point are left out."""
    grid = lambda name: F.explode(F.sequence(F.lit(0), F.lit(steps))).alias(name)
    each = images.select("*", grid("_a")).select("*", grid("_b"))
    x, y = place(((F.col("_a") / steps - 0.5) * F.col("width"), (F.col("_b") / steps - 0.5) * F.col("height")))
    found = each.select("img_nr", x.alias("_x"), y.alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    return found.groupBy("img_nr").agg(F.min("_x").alias("left"), F.min("_y").alias("top"), F.max("_x").alias("right"), F.max("_y").alias("bottom"))


def fitted(boxes: DataFrame) -> DataFrame:
    """One row: the centre and the size that hold all boxes (left, top, right, bottom) evenly about the middle: centre_x, centre_y, width, height."""
    return boxes.agg(
        ((F.min("left") + F.max("right")) / 2).alias("centre_x"), ((F.min("top") + F.max("bottom")) / 2).alias("centre_y"),
        (2 * F.greatest(F.max(F.abs("left")), F.max(F.abs("right")))).alias("width"), (2 * F.greatest(F.max(F.abs("top")), F.max(F.abs("bottom")))).alias("height"),
    )


def covered_columns(boxes: DataFrame, full: int) -> DataFrame:
    """column: of 0 to full - 1, those under some box; at most full rows are left after the first aggregation."""
    spans = boxes.select(F.explode(F.sequence(F.floor("left"), F.ceil("right") - 1)).alias("c")).select(F.pmod("c", F.lit(full)).alias("column"))
    return spans.distinct()


def largest_rectangle(bitmap: DataFrame, x: str, y: str, inside: Column) -> DataFrame:
    """left, top, right, bottom (right and bottom excluded), area: the largest rectangle of pixels that are all inside; of equal ones the first
    from the top, then from the left, then the one that ends higher. No row if none is.

    Each row of pixels knows how far every column reaches up; a rectangle's top side is some column's reach, so for each row the
    candidates are (column, its reach) widened to both sides. Rows are groups of the panorama's width, a fixed number.
    """
    import pandas as pd

    runs = bitmap.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.coalesce(inside, F.lit(False)).alias("ok"))
    w = Window.partitionBy("x").orderBy("y")
    runs = runs.withColumn("g", F.sum((~F.col("ok")).cast("int")).over(w)).filter("ok")
    reach = runs.withColumn("h", F.row_number().over(Window.partitionBy("x", "g").orderBy("y")))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        row, out, stack = int(group["y"].iloc[0]), (0, 0, 0, 0), []
        cells = [*zip(group["x"].tolist(), group["h"].tolist(), strict=True), (None, 0)]
        last = None
        for at, h in cells:
            if last is not None and at != last + 1:
                while stack:
                    left, high = stack.pop()
                    out = max(out, ((last + 1 - left) * high, -(row - high + 1), -left, last + 1))
            start = at
            while stack and stack[-1][1] > h:
                left, high = stack.pop()
                out = max(out, ((at - left) * high, -(row - high + 1), -left, at))
                start = left
            if at is not None:
                stack.append((start, h))
            last = at
        area, top, left, right = out
        return pd.DataFrame([(-left, -top, right, row + 1, area)], columns=["left", "top", "right", "bottom", "area"])

    found = reach.groupBy("y").applyInPandas(best, "left long, top long, right long, bottom long, area long")
    return found.orderBy(F.col("area").desc(), "top", "left", "bottom", "right").limit(1)


def levelled(axes: DataFrame) -> tuple[float, float, float] | None:
    """The direction least covered by the images' side axes (unit vectors x, y, z): the panorama's upright axis. None without images.

    The nine mean products are one row; its eigenvectors are found on the driver.
    """
    import numpy as np

    row = covariance(axes, "x", "y", "z").first()
    if row is None or row["x_x"] is None:
        return None
    m = np.array([[row["_".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    _, vectors = np.linalg.eigh(m)
    v = vectors[:, 0] * (1 if vectors[2, 0] >= 0 else -1)
    return tuple(float(c) for c in v)


def spread_masks_by_overlap(masks: DataFrame, overlaps: DataFrame, least: float = 0.0) -> DataFrame:
    """Masks also for images (i, j, ratio) that overlap their own by more than least; equal ones once."""
    e = overlaps.filter(F.col("ratio") > least)
    ways = e.select(F.col("i").alias("img_nr"), F.col("j").alias("_to")).union(e.select("j", "i"))
    other = masks.join(ways, "img_nr").withColumn("img_nr", F.col("_to")).select(*masks.columns)
    return masks.union(other).distinct()


def polygon_area(poly: Column) -> Column:
    """Signed area of array<struct<x, y>>."""

    def area(poly: Column) -> Column:
        turned = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
        parts = F.zip_with(poly, turned, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return once(poly, area)


def resample_polygon(poly: Column, longest: float) -> Column:
    """The polygon with edges cut into equal parts no longer than that."""
    turned = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2))) / longest).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["x"] + (b["x"] - a["x"]) * k / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / n).alias("y")))

    return F.flatten(F.zip_with(poly, turned, edge))
