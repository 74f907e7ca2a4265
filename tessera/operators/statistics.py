"""Aggregations and statistical cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def error_stats(df: DataFrame, error: str, *keys: str) -> DataFrame:
    """keys, n, min, max, mean, variance (sample). Without rows: minimum 1000000, maximum 0, no mean."""
    out = df.groupBy(*keys).agg(
        F.count(error).alias("n"), F.coalesce(F.min(error), F.lit(1_000_000.0)).alias("min"), F.coalesce(F.max(error), F.lit(0.0)).alias("max"),
        F.avg(error).alias("mean"), F.var_samp(error).alias("variance"),
    )
    return out


def own_points(points: DataFrame, image: int) -> DataFrame:
    """Points that count for an image's statistics: those with both ends in it (one end alone doesn't count)."""
    return points.filter((F.col("img1") == image) & (F.col("img2") == image))


def radii(points: DataFrame, images: DataFrame) -> DataFrame:
    """radius: of both ends of each point, the distance from its image's centre over half the image's height."""
    ends = points.select(F.col("img1").alias("img_nr"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(points.select("img2", "x2", "y2"))
    dx, dy, half = F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2, F.col("height") / 2
    return ends.join(images.select("img_nr", "width", "height").hint("merge"), "img_nr").select("img_nr", (F.sqrt(dx * dx + dy * dy) / F.nullif(half, F.lit(0.0))).alias("radius"))


def radial_stats(points: DataFrame, images: DataFrame) -> DataFrame:
    """n, min, max, mean, variance of the radii of all points, and their 0.1 and 0.9 quantiles by place; one row."""
    r = radii(points, images)
    one = r.select("radius", F.lit(0).alias("_all"))
    return error_stats(one, "radius", "_all").join(index_quantiles(one, "radius", {"q10": 0.1, "q90": 0.9}, "_all"), "_all").drop("_all")


def exposure_range(df: DataFrame, value: str, group: str, *keys: str) -> DataFrame:
    """keys, mean, range (largest less smallest, 0 without rows) and groups (how many different ones: lenses, stacks)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.max(value) - F.min(value), F.lit(0.0)).alias("range"), F.countDistinct(group).alias("groups"))


def boxes(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, left, right, top, bottom of a region's pixels (right and bottom included)."""
    return df.groupBy(*keys).agg(F.min(x).alias("left"), F.max(x).alias("right"), F.min(y).alias("top"), F.max(y).alias("bottom"))


def count_in_mask(df: DataFrame, mask: Column, *keys: str) -> DataFrame:
    """keys, n: pixels for which the mask holds; none counts as 0."""
    return df.groupBy(*keys).agg(F.count_if(F.coalesce(mask, F.lit(False))).alias("n"))


def paint(df: DataFrame, value: str, order: list[str], mask: Column, *keys: str) -> DataFrame:
    """keys and value of the last image in order (then of the largest value) whose mask holds there."""
    return df.filter(mask).groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def window_stats(df: DataFrame, x: str, y: str, value: str, half: int, *keys: str) -> DataFrame:
    """keys, x, y, n, mean, variance (of all, not of a sample) of the pixels within half of each pixel, borders cut: each pixel is sent to its
    neighbours as sums by row, then by column."""
    near = lambda c: F.explode(F.array(*(F.col(c) + k for k in range(-half, half + 1)))).alias(c)
    sums = [F.sum(n).alias(n) for n in ("_n", "_s", "_q")]
    v = F.col(value).cast("double")
    rows = df.select(*keys, near(x), y, F.lit(1).alias("_n"), v.alias("_s"), (v * v).alias("_q")).groupBy(*keys, x, y).agg(*sums)
    both = rows.select(*keys, x, near(y), "_n", "_s", "_q").groupBy(*keys, x, y).agg(*sums)
    mean = F.col("_s") / F.col("_n")
    out = df.select(*keys, x, y).distinct().join(both, [*keys, x, y])
    return out.select(*keys, x, y, F.col("_n").alias("n"), mean.alias("mean"), F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)).alias("variance"))


def best_scale(images: DataFrame, scale: Column, *keys: str) -> DataFrame:
    """keys, scale: the largest that any image needs, 0 at least; without images 1 (in one row, if there are no keys)."""
    return images.groupBy(*keys).agg(F.when(F.count("*") == 0, 1.0).otherwise(F.greatest(F.max(scale), F.lit(0.0))).alias("scale"))


def queue_counts(jobs: DataFrame, status: str, failed: str, *keys: str) -> DataFrame:
    """keys, n, failed: jobs, and those whose status is that."""
    return jobs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(status) == failed).alias("failed"))


def hdr_in_order(df: DataFrame, value: str, exposure: str, order: str, *keys: str) -> DataFrame:
    """:func:`hdr_average` as a reducer that takes samples one by one: where none has weight, the value of the sample whose exposure was last
    larger than the weight kept so far (which is the sample's weight, not its exposure)."""
    step = lambda acc, s: F.when(s["m"] > acc["w"], F.struct((0.5 - F.abs(s["m"] - 0.5)).alias("w"), s["v"].alias("v"))).otherwise(acc)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))
    samples = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(exposure).cast("double").alias("m"), F.col(value).cast("double").alias("v"))))
    w = hdr_weight(F.col(exposure))
    return df.groupBy(*keys).agg(F.when(F.sum(w) > 0, F.try_divide(F.sum(w * F.col(value)), F.sum(w))).otherwise(F.aggregate(samples, start, step)["v"]).alias("hdr"))


def index_quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys and, for each name in shares, the value at place floor(share * n) of the sorted values (from 0; no interpolation).

    Counts of distinct values are dealt by ranges of (keys, value), so a key with most of the rows is spread over tasks; each
    range is summed up apart and moved by the sizes of the key's ranges before it.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_s").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_p", before.alias("_before"), F.sum("_s").over(by).alias("_n"))
    local = ranged.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy(value)))
    ranked = local.join(sizes.withColumnsRenamed({k: f"_{k}" for k in [*keys, "_p"]}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "_p"]]).withColumn("_to", F.col("_to") + F.col("_before"))
    place = lambda q: F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
    hit = lambda q: (place(q) < F.col("_to")) & (place(q) >= F.col("_to") - F.col("_c"))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(hit(q), F.col(value))).alias(name) for name, q in shares.items()))


def weighted_mean(df: DataFrame, weight: str, values: list[str], *keys: str) -> DataFrame:
    """keys and sum(v*w)/sum(w) of each value, null where the weights add up to 0."""
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values))


def compact(df: DataFrame, weight: str, values: list[str], *keys: str) -> DataFrame:
    """One row a key: weighted means, and the new weight sum(w*w) div sum(w) (whole number)."""
    w = F.col(weight).cast("long")
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(v) * w), F.sum(w)).alias(v) for v in values), F.expr(f"sum(cast({weight} AS long) * cast({weight} AS long)) div nullif(sum(cast({weight} AS long)), 0)").alias(weight))


def over_limit(df: DataFrame, error: str, n: float, *keys: str) -> DataFrame:
    """Rows over their group's limit: the mean where the standard deviation exceeds it, else mean + n deviations.

    A group of one row has no deviation, so none of its rows is over a limit.
    """
    stats = df.groupBy(*keys).agg(F.avg(error).alias("_mean"), F.stddev_samp(error).alias("_sd"))
    limit = F.when(F.col("_sd") > F.col("_mean"), F.col("_mean")).otherwise(F.col("_mean") + n * F.col("_sd"))
    if keys:
        return df.join(stats.select(*keys, limit.alias("_limit")), list(keys)).filter(F.col(error) > F.col("_limit")).drop("_limit")
    # a single row of statistics
    return df.crossJoin(F.broadcast(stats.select(limit.alias("_limit")))).filter(F.col(error) > F.col("_limit")).drop("_limit")


def hdr_weight(v: Column) -> Column:
    """0.5 - |v - 0.5|."""
    return 0.5 - F.abs(v - 0.5)


def hdr_average(df: DataFrame, value: str, exposure: str, *keys: str) -> DataFrame:
    """Per pixel, the mean weighted by how well exposed a sample is; where no sample has weight, the least value
    if all are saturated, else the largest."""
    w = hdr_weight(F.col(exposure))
    return df.groupBy(*keys).agg(
        F.when(F.sum(w) > 0, F.try_divide(F.sum(w * F.col(value)), F.sum(w))).when(F.min(exposure) >= 1, F.min(value)).otherwise(F.max(value)).alias("hdr")
    )


def spread(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per pixel the summed distance from the mean; a lone sample is itself."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    return df.join(mean, list(keys)).groupBy(*keys).agg(F.when(F.max("_n") > 1, F.sum(F.abs(F.col(value) - F.col("_m")))).otherwise(F.max(value)).alias("spread"))


def integral(df: DataFrame, x: str, y: str, value: str, *keys: str) -> DataFrame:
    """Two-dimensional prefix sums: by row, then by column."""
    row = Window.partitionBy(*keys, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*keys, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_r", F.sum(value).over(row)).withColumn("integral", F.sum("_r").over(column)).drop("_r")


def line_fit(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, vertical (x hardly varies), slope and offset by least squares (null if vertical)."""
    still = F.var_pop(x) < 1e-5
    return df.groupBy(*keys).agg(still.alias("vertical"), F.when(~still, F.regr_slope(y, x)).alias("slope"), F.when(~still, F.regr_intercept(y, x)).alias("offset"))
