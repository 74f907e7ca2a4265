"""Edits of projects: pure functions on their tables (images, points, masks, links, options).

A project is a bundle of tables. Images are numbered by img_nr from 0 without gaps; points name images by img1 and img2; links hold
(var, img_nr, anchor): the image has its value of that variable from the anchor, which is the first image of its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import components
from .ranking import row_numbers
from .relations import add_missing_masks, distinct_points, merge_by_name

ENDS = ("img1", "img2")


def renumbered(table: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    """table with img_nr columns replaced by numbers (old, new); rows of images that have no new number are left out."""
    for c in columns:
        table = table.join(numbers.select(F.col("old").alias(c), F.col("new").alias("_new")), c).withColumn(c, F.col("_new")).drop("_new")
    return table


def remove_image(table: DataFrame, number: int, *columns: str) -> DataFrame:
    """table (images, points, masks) without rows that name the image in one of columns; higher numbers fall by one."""
    for c in columns:
        table = table.filter(F.col(c) != number)
    return table.withColumns({c: F.when(F.col(c) > number, F.col(c) - 1).otherwise(F.col(c)) for c in columns})


def remaining_reference(reference: Column, count: Column) -> Column:
    """A reference image after a removal: 0 if its number is out of range (it isn't lowered otherwise)."""
    return F.when(reference >= count, 0).otherwise(reference)


def swap_images(table: DataFrame, one: int, other: int, *columns: str) -> DataFrame:
    """table with the two images' numbers exchanged in columns."""
    return table.withColumns({c: F.when(F.col(c) == one, other).when(F.col(c) == other, one).otherwise(F.col(c)) for c in columns})


def move_image(table: DataFrame, one: int, to: int, *columns: str) -> DataFrame:
    """table with image ``one`` at place ``to``, those between moved up or down by one."""

    def moved(c: str) -> Column:
        n = F.col(c)
        step = F.when(n.between(one + 1, to), n - 1) if one < to else F.when(n.between(to, one - 1), n + 1)
        return F.when(n == one, to).otherwise(F.coalesce(step, n))

    return table.withColumns({c: moved(c) for c in columns})


def subset_links(links: DataFrame, images: DataFrame) -> DataFrame:
    """Links among the images (img_nr) of a subset, renumbered: the first image of each class that is left is its anchor."""
    number = row_numbers(images.select("img_nr").distinct(), "new", ["img_nr"]).withColumnRenamed("img_nr", "old")
    members = links.select("var", "anchor", "img_nr").union(links.select("var", "anchor", F.col("anchor"))).distinct()
    kept = members.join(number.withColumnRenamed("old", "img_nr"), "img_nr")
    first = kept.groupBy("var", "anchor").agg(F.min("new").alias("first"))
    # anchors are as many as classes: a hot class is aggregated before it is shuffled
    return kept.join(first.hint("merge"), ["var", "anchor"]).filter("new <> first").select("var", F.col("new").alias("img_nr"), F.col("first").alias("anchor"))


def subset_reference(reference: int, images: DataFrame) -> DataFrame:
    """reference: the reference image's number in a subset of images (img_nr), 0 if it isn't among them; one row."""
    return images.select("img_nr").distinct().agg(F.coalesce(F.count(F.when(F.col("img_nr") < reference, 1)) * F.max((F.col("img_nr") == reference).cast("long")), F.lit(0)).alias("reference"))


def stacks(images: DataFrame, links: DataFrame, var: str = "y") -> DataFrame:
    """img_nr, stack: images linked by var are one stack; stacks are numbered from 0 by their first image."""
    e = links.filter(F.col("var") == var).select(F.col("img_nr").alias("a"), F.col("anchor").alias("b"))
    parts = components(images.select(F.col("img_nr").alias("node")), e)
    numbers = row_numbers(parts.select("component").distinct(), "stack", ["component"])
    return parts.join(numbers, "component").select(F.col("node").alias("img_nr"), "stack")


def unlinked_subset(points: DataFrame, stack_of: DataFrame) -> DataFrame:
    """Plain points (mode 0) between stacks (img_nr, stack), with stacks as images; those within one stack are left out."""
    numbers = stack_of.select(F.col("img_nr").alias("old"), F.col("stack").alias("new"))
    return renumbered(points.filter("mode = 0"), numbers, *ENDS).filter("img1 <> img2")


def update_linked(images: DataFrame, links: DataFrame, var: str, column: str, values: DataFrame) -> DataFrame:
    """images with column set to values (img_nr, value) and, with each of them, in all images linked with it by var. Where several images of
    a class are given, the one of the highest number wins."""
    classes = links.filter(F.col("var") == var).select("img_nr", "anchor")
    own = images.select("img_nr").join(classes, "img_nr", "left").select("img_nr", F.coalesce("anchor", "img_nr").alias("_class"))
    new = values.join(own, "img_nr").groupBy("_class").agg(F.max_by("value", "img_nr").alias("_value"))
    both = own.join(new.hint("merge"), "_class").select("img_nr", F.struct("_value").alias("_set"))
    return images.join(both, "img_nr", "left").withColumn(column, F.when(F.col("_set").isNotNull(), F.col("_set._value")).otherwise(F.col(column))).drop("_set")


def update_crop_factor(images: DataFrame, crop: Column, focal: Column, hfov: Column) -> DataFrame:
    """images with a new crop factor; the focal length (from the old one) stays, so hfov changes. focal and hfov: Columns over
    images and ``_focal``."""
    return images.withColumn("_focal", focal).withColumn("crop_factor", crop).withColumn("hfov", hfov).drop("_focal")


def apply_template(images: DataFrame, template: DataFrame, own: list[str]) -> DataFrame:
    """images with the template's columns by img_nr, but for their own ones (the file name, say). ValueError unless both have
    the same number of images."""
    n, m = images.count(), template.count()
    if n != m:
        raise ValueError(f"the project has {n} images, the template {m}")
    return images.select("img_nr", *own).join(template.drop(*own), "img_nr").select(*(c for c in images.columns))


def translated(images: DataFrame, by: dict[str, float], links: DataFrame | None = None) -> DataFrame:
    """images (img_nr) with columns moved by what ``by`` adds to each. links: img_nr, name, anchor: a linked column takes the moved value of its anchor, so that
    it isn't moved by each image that shares it."""
    for name, step in by.items():
        if links is None:
            images = images.withColumn(name, F.col(name) + step)
            continue
        tied = links.filter(F.col("name") == name).select("img_nr", F.col("anchor").alias("_a"))
        first = images.select(F.col("img_nr").alias("_a"), F.col(name).alias("_v"))
        both = images.join(tied, "img_nr", "left").join(first, "_a", "left")
        images = both.withColumn(name, F.coalesce("_v", F.col(name)) + step).select(*images.columns)
    return images


def move_masks(masks: DataFrame, scale: float = 1.0, turn: int = 0, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """masks with corners scaled, then turned by whole right angles within an image of the (scaled) size."""

    def corner(q: Column) -> Column:
        x, y = q["x"] * scale, q["y"] * scale
        x, y = {0: (x, y), 1: (height - y, x), 2: (width - x, height - y), 3: (y, width - x)}[turn % 4] if turn % 4 else (x, y)
        return F.struct(x.alias("x"), y.alias("y"))

    return masks.withColumn("poly", F.transform("poly", corner))


def clip_masks(masks: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """masks cut to a rectangle, side by side: a corner inside stays, an edge that crosses a side gives its point there; masks with
    fewer than three corners left are left out."""
    sides = [("x", left, 1), ("x", right, -1), ("y", top, 1), ("y", bottom, -1)]
    poly = F.col("poly")
    for axis, limit, sign in sides:
        poly = _cut_side(poly, axis, limit, sign)
    # as rows of its own, so that what uses the cut polygon doesn't compute it again
    return masks.withColumn("poly", F.explode(F.filter(F.array(poly), lambda p: F.size(p) >= 3)))


def _cut_side(poly: Column, axis: str, limit: Column, sign: int) -> Column:
    """poly without what is on the far side of a line across an axis."""
    other = "y" if axis == "x" else "x"

    def cut_(corners: Column) -> Column:
        after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))

        def edge(a: Column, b: Column) -> Column:
            in_a, in_b = (a[axis] - limit) * sign >= 0, (b[axis] - limit) * sign >= 0
            along = a[other] + (b[other] - a[other]) * (limit - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
            at = {axis: limit.cast("double"), other: along}
            cross = F.struct(at["x"].alias("x"), at["y"].alias("y"))
            keep = F.struct(b["x"].alias("x"), b["y"].alias("y"))
            none = F.array().cast("array<struct<x:double,y:double>>")
            return F.when(in_a & in_b, F.array(keep)).when(in_a, F.array(cross)).when(in_b, F.array(cross, keep)).otherwise(none)

        return F.flatten(F.zip_with(corners, after, edge))

    # bound once, so that the four sides' expressions don't multiply
    return F.get(F.transform(F.array(poly), cut_), F.lit(0))


def merge_projects(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Images, points, masks and links of two projects as one: new's images get old's number by file name, or come after its last one;
    masks that old's image hasn't come in; numbered line points (modes over 2) go on after old's; points equal but for their
    direction are kept once. images: img_nr, filename, ...; points: cp_id, img1, ...; masks: img_nr, mask_type, poly; links: var, img_nr, anchor."""
    number = merge_by_name(old["images"], new["images"].select("img_nr", "filename"), "filename", "img_nr").select(F.col("img_nr").alias("old"), F.col("merged").alias("new"))
    columns = old["images"].columns
    fresh = renumbered(new["images"].join(old["images"].select("filename"), "filename", "left_anti"), number, "img_nr").select(*columns)
    masks = add_missing_masks(old["masks"], renumbered(new["masks"], number, "img_nr").select(*old["masks"].columns).distinct(), ["img_nr", "mask_type", "poly"])
    # a single row
    last = old["points"].agg(F.greatest(F.coalesce(F.max("mode"), F.lit(2)), F.lit(2)).alias("_last"), F.coalesce(F.max("cp_id"), F.lit(-1)).alias("_id"))
    lines = renumbered(new["points"], number, *ENDS).crossJoin(F.broadcast(last))
    mode = F.when(F.col("mode") > 2, F.col("mode") + F.col("_last") - 2).otherwise(F.col("mode")).cast(dict(old["points"].dtypes)["mode"])
    lines = lines.withColumn("mode", mode).withColumn("cp_id", F.col("cp_id") + F.col("_id") + 1).select(*old["points"].columns)
    points = distinct_points(cut(old["points"].unionByName(lines)))  # they are grouped and looked up: made once
    links = old["links"].unionByName(renumbered(new["links"], number, "img_nr", "anchor").select(*old["links"].columns))
    return {"images": old["images"].unionByName(fresh), "points": points, "masks": masks, "links": normal_links(links)}


def normal_links(links: DataFrame) -> DataFrame:
    """links with the first image of each class as the anchor of the others: what is linked in any number of steps is one class."""
    pair = lambda c: F.struct("var", F.col(c).alias("n"))
    e = links.filter("img_nr <> anchor").select(pair("img_nr").alias("a"), pair("anchor").alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    both = components(nodes, e)
    return both.filter("node <> component").select(F.col("node.var").alias("var"), F.col("node.n").alias("img_nr"), F.col("component.n").alias("anchor"))


def link(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links with pairs (var, img_nr, anchor) added."""
    return normal_links(links.unionByName(pairs.select(*links.columns)))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links without images (var, img_nr); where an anchor goes, the next image of its class takes its place."""
    members = links.select("var", "anchor", "img_nr").union(links.select("var", "anchor", F.col("anchor"))).distinct()
    left = members.join(gone.select("var", "img_nr").distinct(), ["var", "img_nr"], "left_anti")
    first = left.groupBy("var", "anchor").agg(F.min("img_nr").alias("_first"))
    return left.join(first.hint("merge"), ["var", "anchor"]).filter("img_nr <> _first").select("var", "img_nr", F.col("_first").alias("anchor")).select(*links.columns)


def new_part(links: DataFrame, variables: list[str], members: DataFrame) -> DataFrame:
    """links with the images of members (img_nr) as a part (a lens or stack) of their own: taken out of their classes in all
    variables of the group, and linked with the first of them."""
    spark = links.sparkSession
    names = spark.createDataFrame([(v,) for v in variables], "var string")
    each = members.select("img_nr").distinct().join(F.broadcast(names), F.lit(True))  # a few names
    first = members.agg(F.min("img_nr").alias("anchor"))
    pairs = each.crossJoin(F.broadcast(first)).filter("img_nr <> anchor")  # one row
    return unlink(links, each).unionByName(pairs.select(*links.columns))


def change_part(links: DataFrame, variables: list[str], member: int, to: int) -> DataFrame:
    """links with image ``member`` in the part of image ``to``, for each variable in which that part is linked at all."""
    spark = links.sparkSession
    names = F.col("var").isin(variables)
    out = unlink(links, spark.createDataFrame([(v, member) for v in variables], "var string, img_nr long"))
    linked = links.filter(names & ((F.col("img_nr") == to) | (F.col("anchor") == to))).select("var").distinct()
    return link(out, linked.select("var", F.lit(member).cast("long").alias("img_nr"), F.lit(to).cast("long").alias("anchor")))


def reference_images(images: DataFrame, links: DataFrame, reference: int, var: str = "y") -> DataFrame:
    """img_nr: the reference image and those linked with it by var."""
    classes = links.filter(F.col("var") == var).select("img_nr", "anchor")
    own = images.select("img_nr").join(classes, "img_nr", "left").select("img_nr", F.coalesce("anchor", "img_nr").alias("_class"))
    return own.join(F.broadcast(own.filter(F.col("img_nr") == reference).select("_class")), "_class", "left_semi").select("img_nr")


def fixed_stacks(images: DataFrame, length: int, lenses: int = 1) -> DataFrame:
    """img_nr, stack: every ``length`` images (at most all of them) from the first one on; with more than one lens, or a length under 2,
    each image is its own."""
    n = max(1, length if lenses < 2 else 1)  # a length over the number of images gives one stack as it is
    return images.select("img_nr", F.floor(F.col("img_nr") / n).alias("stack"))


def has_possible_stacks(images: DataFrame, layers: DataFrame, project: str = "project_id") -> DataFrame:
    """project, possible: exposures (ev) span 1.2 or more; there are several layers, fewer than images, of which the images are
    a multiple; and the image whose number is that of the layers is in layer 0. layers: project, img_nr, layer (at a limit of 0.3)."""
    spans = images.groupBy(project).agg((F.max("ev") - F.min("ev")).alias("span"), F.count("*").alias("n"))
    counts = layers.groupBy(project).agg(F.countDistinct("layer").alias("k"))
    first = layers.filter("layer = 0").select(project, "img_nr")
    both = spans.join(counts, project)
    hit = both.join(first, [both[project] == first[project], F.col("k") == F.col("img_nr")], "left_semi").select(project, F.lit(True).alias("_hit"))
    ok = (F.col("span") >= 1.2) & (F.col("k") >= 2) & (F.col("k") != F.col("n")) & (F.col("n") % F.col("k") == 0) & F.col("_hit").isNotNull()
    return both.join(hit, project, "left").select(project, ok.alias("possible"))
