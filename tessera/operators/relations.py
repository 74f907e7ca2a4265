"""De-duplication, merging, updates, subsets and numbering of project tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import row_numbers


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def mirrored(points: DataFrame, image: int) -> DataFrame:
    """Control points of an image, turned so that it is side 1; a self-pair is not turned."""
    swap = {"img1": "img2", "img2": "img1", "x1": "x2", "x2": "x1", "y1": "y2", "y2": "y1"}
    turned = (F.col("img1") != image) & (F.col("img2") == image)
    columns = [F.when(turned, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in points.columns]
    return points.filter((F.col("img1") == image) | (F.col("img2") == image)).select(*columns)


def printed(x: Column, digits: int) -> Column:
    """x as printed to so many significant digits; zero and whole numbers of fewer digits, which most coordinates may be, are put together without the slow formatter."""
    whole = (x == F.floor(x)) & F.abs(x).between(1, 10 ** (digits - 1) - 1)
    short = F.rpad(F.concat(x.cast("long").cast("string"), F.lit(".")), F.when(x < 0, digits + 2).otherwise(digits + 1), "0")
    zero = x.cast("string") == "0.0"  # not -0.0
    return F.when(whole, short).when(zero, F.lit("0." + "0" * (digits - 1))).otherwise(F.format_string(f"%.{digits}g", x))


def distinct_points(points: DataFrame, digits: int = 6) -> DataFrame:
    """The first (by cp_id) of control points equal in mode and ordered ends, coordinates as printed to so many significant digits."""
    text = lambda c: printed(F.col(c), digits)
    turn = F.col("img1") > F.col("img2")
    end1, end2 = (F.concat_ws(",", F.col(f"img{k}").cast("string"), text(f"x{k}"), text(f"y{k}")) for k in (1, 2))
    key = F.concat_ws(";", F.col("mode").cast("string"), F.when(turn, end2).otherwise(end1), F.when(turn, end1).otherwise(end2))
    first = points.groupBy(key.alias("_key")).agg(F.min("cp_id").alias("cp_id"))
    return points.join(first.select("cp_id"), "cp_id", "left_semi")


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def local_number(df: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """number: place from 0 within the unordered pair."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return df.withColumn("number", F.row_number().over(w) - 1)


def merge_by_name(old: DataFrame, new: DataFrame, name: str, number: str) -> DataFrame:
    """new's rows with the number they get in old: that of the same name, else one after old's last, in new's order."""
    last = old.agg(F.coalesce(F.max(number), F.lit(-1)).alias("_last"))
    known = old.groupBy(name).agg(F.min(number).alias("_old"))
    found = new.join(known, name, "left")
    fresh = found.filter(F.col("_old").isNull())
    ranked = row_numbers(fresh, "_rank", [number, name])
    # last is a single row
    out = ranked.crossJoin(F.broadcast(last)).withColumn("merged", F.col("_last") + F.col("_rank") + 1).drop("_rank", "_last", "_old")
    return found.filter(F.col("_old").isNotNull()).withColumnRenamed("_old", "merged").unionByName(out)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def subset(points: DataFrame, images: DataFrame) -> DataFrame:
    """Control points with both ends among images (img_nr), renumbered densely in order of img_nr."""
    number = row_numbers(images.select("img_nr").distinct(), "_new", ["img_nr"])
    one = points.join(number.withColumnsRenamed({"img_nr": "img1", "_new": "_n1"}), "img1")
    both = one.join(number.withColumnsRenamed({"img_nr": "img2", "_new": "_n2"}), "img2")
    return both.withColumn("img1", F.col("_n1")).withColumn("img2", F.col("_n2")).drop("_n1", "_n2")


def renumber_lines(points: DataFrame, mode: str = "mode", first: int = 3) -> DataFrame:
    """Modes of numbered lines (over 2) become dense from first; the distinct modes alone are ranked."""
    ranks = points.filter(F.col(mode) > 2).select(mode).distinct()
    ranks = row_numbers(ranks, "_new", [mode])
    return points.join(ranks, mode, "left").withColumn(mode, F.coalesce(F.col("_new") + first, mode)).drop("_new")


def add_missing_masks(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of new that equal none of old."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def in_masks(points: DataFrame, masks: DataFrame) -> DataFrame:
    """Control points (cp_id, img1, x1, ...) an end of which is in a mask (img_nr, poly array of x and y) of its image."""
    ends = points.select("cp_id", F.col("img1").alias("img_nr"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(points.select("cp_id", "img2", "x2", "y2"))
    turns = F.zip_with("poly", F.concat(F.slice("poly", 2, F.size("poly")), F.slice("poly", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def wind(acc: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (F.col("x") - a["x"]) * (b["y"] - a["y"])
        up = (a["y"] <= F.col("y")) & (b["y"] > F.col("y")) & (side > 0)
        down = (a["y"] > F.col("y")) & (b["y"] <= F.col("y")) & (side < 0)
        return acc + up.cast("int") - down.cast("int")

    inside = ends.join(masks, "img_nr").filter((F.size("poly") > 2) & (F.aggregate(turns, F.lit(0), wind) != 0))
    return points.join(inside.select("cp_id"), "cp_id", "left_semi")
