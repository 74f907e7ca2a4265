"""Filters and pair rules of control points, images, lines and saved values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, point_edges
from .ranking import cell, row_numbers


def plain_points(points: DataFrame, mode: str = "mode") -> DataFrame:
    """Points of mode 0; 1 and 2 are horizontal and vertical ones, higher ones are numbered lines."""
    return points.filter(F.col(mode) == 0)


def both_active(points: DataFrame, images: DataFrame, one: str = "img1", other: str = "img2", number: str = "img_nr") -> DataFrame:
    """Points both ends of which are among images."""
    known = images.select(number).distinct()
    return points.join(known.select(F.col(number).alias(one)), one, "left_semi").join(known.select(F.col(number).alias(other)), other, "left_semi").select(*points.columns)


def over_threshold(df: DataFrame, value: str, limit: float) -> DataFrame:
    """Rows over a limit; below its absolute value if it is negative."""
    return df.filter(F.col(value) > limit if limit >= 0 else F.col(value) < -limit)


def in_region(points: DataFrame, at: tuple[Column, Column], width: float, height: float, region: tuple[float, float, float, float], inside: bool = True) -> DataFrame:
    """Points whose left end, brought to the panorama by ``at`` (pixels from its centre), is in the region (left, top, right, bottom; all
    included), or (not inside) isn't. A point that can't be brought there (null) is kept either way."""
    left, top, right, bottom = region
    x, y = at[0] + width / 2, at[1] + height / 2
    hit = x.between(left, right) & y.between(top, bottom)
    return points.filter(F.coalesce(hit if inside else ~hit, F.lit(True)))


def images_in_region(images: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Images whose rectangle (left, top, right, bottom; right and bottom excluded) meets the region."""
    left, top, right, bottom = region
    return images.filter((F.greatest("left", F.lit(left)) < F.least("right", F.lit(right))) & (F.greatest("top", F.lit(top)) < F.least("bottom", F.lit(bottom))))


def upright_lines(lines: DataFrame, angle: float = 0.0, longest_lean: float = 0.1, least_length: float = 20.0) -> DataFrame:
    """Lines (x1, y1, x2, y2) longer than that and nearly at right angles to the horizon of an image turned by angle (radians)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    return lines.filter((length > least_length) & (F.abs(dx * F.cos(F.lit(angle)) + dy * F.sin(F.lit(angle))) < longest_lean * length))


def vertical_points(lines: DataFrame, key: str, n: int, angle: float = 0.0) -> DataFrame:
    """lines (key, x1, y1, x2, y2, error) with merit: of each key the n of the lowest merit, error over the largest error plus what the length
    lacks of 500 pixels, among those whose error isn't over mean and deviation. A key's only line stays if it leans less than 0.05."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    stats = lines.groupBy(key).agg(F.count("*").alias("_n"), (F.avg("error") + F.stddev_samp("error")).alias("_limit"))
    # a table of one row a key is what a join holds: lines stream past it unsorted
    of = lambda facts: lines.join(facts.hint("shuffle_hash"), key)
    facts = lambda *more: (*(F.max(c).alias(c) for c in ("_n", "_limit")), *more)
    lone = F.col("_n") == 1
    within = ~lone & (F.col("error") <= F.col("_limit"))
    most = of(stats).groupBy(key).agg(*facts(F.max(F.when(within, F.col("error"))).alias("_most"))).filter(lone | (F.col("_most") > 0))
    merit = F.col("error") / F.col("_most") + 1 - F.least(length, F.lit(500.0)) / 500
    # lines of a key are dealt into slots: n slots hold n lines, so no line over the n-th least of the slots' minima is among the n first
    slots = 2 * max(n, 1)
    dealt = of(most).select(key, "_n", "_limit", "_most", F.when(within, merit).alias("merit"), F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.lit(slots)).alias("_slot"))
    least = F.array(*(F.min(F.when(F.col("_slot") == k, F.col("merit"))) for k in range(slots)))
    bound = dealt.groupBy(key).agg(*facts(F.max("_most").alias("_most"), F.get(F.array_sort(least), F.lit(n - 1)).alias("_bound")))
    lean = F.abs(dx * F.cos(F.lit(angle)) + dy * F.sin(F.lit(angle))) / F.nullif(length, F.lit(0.0))
    kept = of(bound).withColumn("merit", F.when(lone, 0.0).otherwise(merit))
    kept = kept.filter(F.when(lone, lean < 0.05).otherwise(within & F.coalesce(F.col("merit") <= F.col("_bound"), F.lit(True))))
    order = Window.partitionBy(key).orderBy("merit", "x1", "y1", "x2", "y2")
    return kept.withColumn("_r", F.row_number().over(order)).filter(lone | (F.col("_r") <= n)).select(*lines.columns, "merit")


def plausible(df: DataFrame, mean_error: str, distortion: list[str], vignetting: list[str]) -> DataFrame:
    """df with good_error (under 15), good_distortion (some, and together under 0.1) and good_vignetting (over 0.5, at most 1.01 together)."""
    total = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    some = sum((F.abs(F.col(c)) for c in distortion[1:]), F.abs(F.col(distortion[0])))
    v = total(vignetting)
    return df.withColumns({"good_error": F.col(mean_error) < 15, "good_distortion": (some > 0.001) & (F.abs(total(distortion)) < 0.1), "good_vignetting": (v > 0.5) & (v <= 1.01)})


def without_points(images: DataFrame, points: DataFrame, number: str = "img_nr") -> DataFrame:
    """Images no plain point touches."""
    ends = plain_points(points)
    ends = ends.select(F.col("img1").alias(number)).union(ends.select("img2"))
    return images.join(ends.distinct(), number, "left_anti")


def pairs_without_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (i, j) that no point joins, in either direction."""
    joined = points.select(F.least("img1", "img2").alias("_a"), F.greatest("img1", "img2").alias("_b")).distinct()
    return pairs.join(joined, (F.least("i", "j") == F.col("_a")) & (F.greatest("i", "j") == F.col("_b")), "left_anti")


def unconnected_overlaps(overlaps: DataFrame, points: DataFrame, least: float = 0.0, included: bool = False) -> DataFrame:
    """Pairs (i, j, ratio) that overlap by more than least (or, included, by least) and that no point joins."""
    enough = F.col("ratio") >= least if included else F.col("ratio") > least
    return pairs_without_points(overlaps.filter(enough), points)


def close_matches(left: DataFrame, right: DataFrame, same: list[str], near: str, tolerance: float, time: str, seconds: int) -> DataFrame:
    """Rows of right (columns with r_ before) for each of left that agree in ``same``, within tolerance in near, and within so many seconds in time.

    Times are dealt into bins of that length, and a row of left meets its own bin and both neighbours: no row meets all of its key.
    """
    bins = lambda df: F.floor(F.unix_seconds(df[time]) / seconds)
    r = right.withColumn("_bin", bins(right)).withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    around = left.withColumn("_bin", F.explode(F.array(*(bins(left) + k for k in (-1, 0, 1)))))
    agree = [F.col(c) == F.col(f"r_{c}") for c in same]
    joined = around.join(r.withColumnRenamed("_bin", "_r"), [F.col("_bin") == F.col("_r"), *agree])
    gap = F.abs(F.unix_seconds(time) - F.unix_seconds(f"r_{time}"))
    return joined.filter((F.abs(F.col(near) - F.col(f"r_{near}")) <= tolerance) & (gap <= seconds)).drop("_bin", "_r")


def focus_pairs(images: DataFrame, focus: int, number: str = "img_nr") -> DataFrame:
    """i, j (i < j): the focus image with every other one. Pairs without a focus are those that overlap, or banded ones: never all."""
    n = F.col(number)
    return images.filter(n != focus).select(F.least(n, F.lit(focus)).alias("i"), F.greatest(n, F.lit(focus)).alias("j"))


def match_sieve(matches: DataFrame, keys: list[str], x: str, y: str, score: list[str], columns: int = 5, rows: int = 5, n: int = 1) -> DataFrame:
    """Of each key the n best matches (largest score first) of each cell of a grid over the range of its own points."""
    ranges = matches.groupBy(*keys).agg(F.min(x).alias("_x0"), (F.max(x) - F.min(x) + 2).alias("_xs"), F.min(y).alias("_y0"), (F.max(y) - F.min(y) + 2).alias("_ys"))
    celled = matches.join(ranges, keys).withColumn("cell_x", cell(F.col(x), F.col("_x0"), F.col("_xs"), columns)).withColumn("cell_y", cell(F.col(y), F.col("_y0"), F.col("_ys"), rows))
    if n == 1:  # tasks keep each cell's best of their rows before these are shuffled
        rest = [c for c in matches.columns if c not in keys]
        best = celled.groupBy(*keys, "cell_x", "cell_y").agg(F.max_by(F.struct(*rest), F.struct(*score)).alias("_b"))
        return best.select(*(F.col(c) if c in keys else F.col("_b")[c].alias(c) for c in matches.columns), "cell_x", "cell_y")
    once = celled.drop("_x0", "_xs", "_y0", "_ys").dropDuplicates([*keys, "cell_x", "cell_y", *score])
    w = Window.partitionBy(*keys, "cell_x", "cell_y").orderBy(*(F.col(c).desc() for c in score))
    return once.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def multi_row_plan(images: DataFrame, stacks: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """step, i, j: pairs to match. Step 1: neighbours in a stack (stack, place, img_nr), and neighbours among the images
    of the layer (images: img_nr). Step 2, once points of step 1 are there: the first and last image of each component with each other and
    with those of the component after it, but for pairs of step 1. (Step 3, overlaps that no point joins, is :func:`unconnected_overlaps`.)

    In step 2 components meet along a chain in the order of their first images: that suffices to connect them all, and its
    pairs grow with the components, not with their square.
    """

    after = lambda by, order: F.lead("img_nr").over(Window.partitionBy(*by).orderBy(order))
    ordered = lambda df: df.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    inner = stacks.select(F.col("img_nr").alias("i"), after(["stack"], "place").alias("j")).filter("j IS NOT NULL")
    # neighbours in the layer, by ranks over ranges instead of one window over all
    placed = row_numbers(images.select("img_nr").distinct(), "_k", ["img_nr"])
    next_ = placed.select(F.col("img_nr").alias("j"), (F.col("_k") - 1).alias("_k"))
    layer = placed.join(next_, "_k").select(F.col("img_nr").alias("i"), "j")
    first = ordered(inner.union(layer)).distinct()
    if points is None:
        return first.select(F.lit(1).alias("step"), "i", "j")
    parts = components(images.select(F.col("img_nr").alias("node")), point_edges(points))
    ends = row_numbers(parts.groupBy("component").agg(F.min("node").alias("lo"), F.max("node").alias("hi")), "_k", ["component"])
    each = ends.select("_k", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("n"))
    # a component's ends, two at most, meet its own and the next one's
    near = each.select(F.explode(F.array("_k", F.col("_k") + 1)).alias("_k"), "n")
    pairs = near.join(each.withColumnRenamed("n", "m"), "_k").filter("n <> m").select(F.col("n").alias("i"), F.col("m").alias("j"))
    several = ends.agg((F.count("*") > 1).alias("_several"))
    second = ordered(pairs).distinct().join(first, ["i", "j"], "left_anti").join(F.broadcast(several), F.col("_several")).select("i", "j")  # one row
    return first.select(F.lit(1).alias("step"), "i", "j").union(second.select(F.lit(2).alias("step"), "i", "j"))
