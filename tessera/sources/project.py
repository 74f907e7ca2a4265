"""Project files: one line an entry, told by its first letters; parameters are letters with a value, or quoted text.

Lines keep no order in Spark, so control points and images are numbered when a file is read: a file
is read as one text value (files are small, projects many), and its lines are exploded with their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import natural_key
from ..operators.ranking import row_numbers


def read_lines(spark: SparkSession, path: str, pattern: str = "*.pto") -> DataFrame:
    """project_id (the file), place, line: of all files below path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("project_id"), F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).filter("line <> ''")


def parameter(line: Column, name: str) -> Column:
    """Text of the first parameter that begins with name: to the closing quote, or to the next space; null if there is none."""
    found = F.regexp_extract(line, f' {name}(?:"([^"]*)"|(\\S*))', 1)
    plain = F.regexp_extract(line, f' {name}("[^"]*"|\\S*)', 1)
    return F.when(line.rlike(f" {name}"), F.when(plain.startswith('"'), found).otherwise(plain))


def number(line: Column, name: str, default: float | None = None) -> Column:
    """A parameter as a number; a link (=N) or nothing gives the default."""
    return F.coalesce(parameter(line, name).try_cast("double"), F.lit(default).cast("double"))


def link(line: Column, name: str) -> Column:
    """The image a parameter is linked with (=N), else -1."""
    return F.coalesce(F.regexp_extract(parameter(line, name), r"^=(\d+)$", 1).try_cast("int"), F.lit(-1))


def numbers(text: Column, kind: str = "int") -> Column:
    """An array from comma-separated numbers; null unless all of them are."""
    found = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast(kind))
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)


def crop_of(line: Column) -> Column:
    """left, right, top, bottom of an image line's crop (S, else C); null without four numbers."""
    found = F.coalesce(numbers(parameter(line, "S")), numbers(parameter(line, "C")))
    return F.when(F.size(found) == 4, found)


#: Parameters of an image line that may be links, with their defaults.
LINKABLE = {"v": 51.0, "a": 0.0, "b": 0.0, "c": 0.0, "Va": 1.0, "Vb": 0.0, "Vc": 0.0, "Vd": 0.0, "Eev": 0.0}


def images(lines: DataFrame) -> DataFrame:
    """Image lines: an ``o`` line takes the place of the ``i`` line of its number. A link takes the value of the (earlier) image it names."""
    numbered = lines.filter(F.col("line").rlike("^[io] ")).withColumn("_kind", F.substring("line", 1, 1))
    w = Window.partitionBy("project_id", "_kind").orderBy("place")
    numbered = numbered.withColumn("img_nr", F.row_number().over(w) - 1)
    one = numbered.groupBy("project_id", "img_nr").agg(F.max_by("line", "_kind").alias("line"))
    line = F.col("line")
    own = one.select(
        "project_id", "img_nr", parameter(line, "n").alias("filename"), number(line, "w").cast("int").alias("width"), number(line, "h").cast("int").alias("height"), number(line, "f", 0).cast("int").alias("projection"),
        *(number(line, k, 0).alias(name) for k, name in (("r", "roll"), ("p", "pitch"), ("y", "yaw"))), number(line, "Vm", 5).cast("int").alias("vig_mode"), crop_of(line).alias("crop"),
        F.map_from_arrays(F.array(*(F.lit(k) for k in LINKABLE)), F.array(*(number(line, k, d) for k, d in LINKABLE.items()))).alias("_own"),
        F.map_from_arrays(F.array(*(F.lit(k) for k in LINKABLE)), F.array(*(link(line, k) for k in LINKABLE))).alias("links"),
    )
    # links name an earlier image; each variable looks its anchor up
    flat = own.select("project_id", "img_nr", F.explode("_own").alias("k", "v")).join(own.select("project_id", "img_nr", F.explode("links").alias("k", "to")), ["project_id", "img_nr", "k"])
    anchor = flat.select("project_id", F.col("img_nr").alias("to"), "k", F.col("v").alias("_linked"))
    value = flat.join(anchor, ["project_id", "to", "k"], "left").withColumn("v", F.when(F.col("to") >= 0, F.col("_linked")).otherwise(F.col("v")))
    values = value.groupBy("project_id", "img_nr").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_v"))
    reset = F.col("vig_mode") != 5
    both = own.drop("_own").join(values, ["project_id", "img_nr"])
    vig = F.when(reset, F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)))).otherwise(F.array(*(F.col("_v")[k] for k in ("Va", "Vb", "Vc", "Vd"))))
    return both.select("project_id", "img_nr", "filename", "width", "height", "projection", F.col("_v")["v"].alias("hfov"), F.col("_v")["Eev"].alias("ev"), "roll", "pitch", "yaw", F.array(*(F.col("_v")[k] for k in "abc")).alias("dist"), "vig_mode", vig.alias("vig_coeff"), "crop", "links")


def control_points(lines: DataFrame) -> DataFrame:
    c = lines.filter(F.col("line").startswith("c "))
    line = F.col("line")
    w = Window.partitionBy("project_id").orderBy("place")
    whole = {"img1": "n", "img2": "N"}
    points = {"x1": "x", "y1": "y", "x2": "X", "y2": "Y"}
    return c.select("project_id", (F.row_number().over(w) - 1).cast("long").alias("cp_id"), *(number(line, k).cast("int").alias(c) for c, k in whole.items()), *(number(line, k).alias(c) for c, k in points.items()), number(line, "t", 0).cast("int").alias("mode"))


def output(lines: DataFrame) -> DataFrame:
    """project_id and the panorama's projection, width, height, hfov, exposure, mode (0: normal range), pixel type, region (left, right, top,
    bottom) and format, of its ``p`` line (the last one); interpolation and gamma of its ``m`` line."""
    last = lambda kind: F.max_by(F.when(F.col("line").startswith(kind), F.col("line")), F.when(F.col("line").startswith(kind), F.col("place")))
    both = lines.filter(F.col("line").rlike("^[pm] ")).groupBy("project_id").agg(last("p ").alias("p"), last("m ").alias("m"))
    p, m = F.col("p"), F.col("m")
    whole = lambda k, d=None: number(p, k, d).cast("int")
    region = numbers(parameter(p, "S"))
    return both.select(
        "project_id", whole("f").alias("projection"), whole("w").alias("width"), whole("h").alias("height"), number(p, "v").alias("hfov"), number(p, "E").alias("exposure"), whole("R", 0).alias("mode"),
        parameter(p, "T").alias("pixel_type"), F.when(F.size(region) == 4, region).alias("region"), parameter(p, "n").alias("format"), number(m, "i").cast("int").alias("interpolation"), number(m, "g", 1).alias("gamma"),
    )


def to_optimise(lines: DataFrame) -> DataFrame:
    """project_id, img_nr, name: variables to fit, of the ``v`` lines; names without a number count for image 0 if they are one letter, else not."""
    words = lines.filter(F.col("line").rlike("^v(\\s|$)")).select("project_id", F.explode(F.split(F.trim(F.substring("line", 2, 1 << 30)), r"\s+")).alias("w"))
    w = F.when(F.length("w") == 1, F.concat("w", F.lit("0"))).otherwise(F.col("w"))
    named = words.select("project_id", F.regexp_extract(w, r"^(\D+)(\d+)$", 2).try_cast("int").alias("img_nr"), F.regexp_extract(w, r"^(\D+)(\d+)$", 1).alias("name"))
    return named.filter("img_nr IS NOT NULL").distinct()


def option(options_: DataFrame, name: str, kind: str, default: str) -> DataFrame:
    """project_id, name: an option's value by project, the default where it isn't of that kind; projects without it are left out."""
    return options_.filter(F.col("name") == name).select("project_id", F.coalesce(F.col("value").try_cast(kind), F.lit(default).cast(kind)).alias(name))


def optimised(lines: DataFrame) -> DataFrame:
    """project_id, img_nr, name, value: what an optimiser's output script says of its images' variables (links take their anchor's value)."""
    i = images(lines)
    values = F.map_from_arrays(F.array(*(F.lit(k) for k in ("v", "r", "p", "y", "a", "b", "c", "Eev"))), F.array(F.col("hfov"), F.col("roll"), F.col("pitch"), F.col("yaw"), *(F.col("dist")[k] for k in range(3)), F.col("ev")))
    return i.select("project_id", "img_nr", F.explode(values).alias("name", "value"))


def masks(lines: DataFrame) -> DataFrame:
    k = lines.filter(F.col("line").startswith("k "))
    values = F.transform(F.split(F.trim(parameter(F.col("line"), "p")), r"\s+"), lambda x: x.try_cast("double"))
    poly = F.transform(F.sequence(F.lit(0), F.expr("size(_p) div 2") - 1), lambda i: F.struct(F.element_at("_p", (2 * i + 1).cast("int")).alias("x"), F.element_at("_p", (2 * i + 2).cast("int")).alias("y")))
    return k.withColumn("_p", values).filter("size(_p) >= 2").select("project_id", number(F.col("line"), "i").cast("int").alias("img_nr"), number(F.col("line"), "t", 0).cast("int").alias("mask_type"), poly.alias("poly"))


def options(lines: DataFrame) -> DataFrame:
    """project_id, name, value of the option comments (``#word_name value``)."""
    o = lines.filter(F.col("line").rlike(r"^#\w+_\w+"))
    return o.select("project_id", F.regexp_extract("line", r"^#[a-z]+_(\w+)", 1).alias("name"), F.trim(F.regexp_extract("line", r"^#\S+\s+(.*)$", 1)).alias("value"))


def point_lines(points: DataFrame) -> DataFrame:
    """project_id, cp_id, line: control points as text."""
    text = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    return points.select("project_id", "cp_id", F.format_string("c n%d N%d x%s y%s X%s Y%s t%d", "img1", "img2", text("x1"), text("y1"), text("x2"), text("y2"), "mode").alias("line"))


def _plain(c: Column) -> Column:
    """A number as text, without needless zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", c.cast("double")), r"0+$", ""), r"\.$", "")


def _parameters(pairs: list[tuple[str, Column]]) -> Column:
    """" k1v1 k2v2": null values are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f" {k}"), v), F.lit("")) for k, v in pairs))


def image_lines(images_: DataFrame, kind: str = "i") -> DataFrame:
    """project_id, img_nr, line: images as text; a linked variable names its anchor, but in stitcher scripts (kind "o"), where all have values."""
    own = {"v": "hfov", "Eev": "ev", **{k: F.col("dist")[n] for n, k in enumerate("abc")}, **{k: F.col("vig_coeff")[n] for n, k in enumerate(("Va", "Vb", "Vc", "Vd"))}}
    column = lambda c: F.col(c) if isinstance(c, str) else c

    def linkable(k: str) -> Column:
        to, value = F.coalesce(F.col("links")[k], F.lit(-1)), _plain(column(own[k]))
        return value if kind == "o" else F.when(to >= 0, F.concat(F.lit("="), to.cast("string"))).otherwise(value)

    crop = F.when(F.size("crop") == 4, F.array_join("crop", ","))
    pairs = [("w", F.col("width").cast("string")), ("h", F.col("height").cast("string")), ("f", F.col("projection").cast("string")), *((k, linkable(k)) for k in own), *((k, _plain(F.col(c))) for k, c in (("r", "roll"), ("p", "pitch"), ("y", "yaw"))), ("S", crop), ("Vm", F.col("vig_mode").cast("string"))]
    return images_.select("project_id", "img_nr", F.concat(F.lit(kind), _parameters(pairs), F.coalesce(F.concat(F.lit(' n"'), "filename", F.lit('"')), F.lit(""))).alias("line"))


def mask_lines(masks_: DataFrame) -> DataFrame:
    corners = F.array_join(F.transform("poly", lambda q: F.concat_ws(" ", _plain(q["x"]), _plain(q["y"]))), " ")
    return masks_.select("project_id", "img_nr", F.format_string('k i%d t%d p"%s"', "img_nr", "mask_type", corners).alias("line"))


def output_lines(output_: DataFrame) -> DataFrame:
    """project_id, part (0: p line, 1: m line), line."""
    text = lambda c: F.col(c).cast("string")
    quoted = F.concat(F.lit('"'), "format", F.lit('"'))
    p = [("f", text("projection")), ("w", text("width")), ("h", text("height")), ("v", _plain(F.col("hfov"))), ("E", _plain(F.col("exposure"))), ("R", text("mode")), ("T", F.col("pixel_type")), ("S", F.when(F.size("region") == 4, F.array_join("region", ","))), ("n", quoted)]
    m = [("g", _plain(F.col("gamma"))), ("i", text("interpolation"))]
    return output_.select("project_id", F.posexplode(F.array(F.concat(F.lit("p"), _parameters(p)), F.concat(F.lit("m"), _parameters(m)))).alias("part", "line"))


def project_lines(tables: dict[str, DataFrame], prefix: str = "option") -> DataFrame:
    """project_id, place, line: a whole project as text: output, images, points, variables to fit, masks, options (those tables that are given)."""
    place = lambda section, n: (F.lit(section).cast("long") * (1 << 40) + n).alias("place")
    parts = {
        "output": lambda t: output_lines(t).select("project_id", place(0, F.col("part")), "line"),
        "images": lambda t: image_lines(t).select("project_id", place(1, F.col("img_nr")), "line"),
        "optimise": lambda t: t.select("project_id", place(2, F.col("img_nr")), F.format_string("v %s%d", "name", "img_nr").alias("line")),
        "points": lambda t: point_lines(t).select("project_id", place(3, F.col("cp_id")), "line"),
        "masks": lambda t: mask_lines(t).select("project_id", place(4, F.col("img_nr")), "line"),
        "options": lambda t: t.select("project_id", place(5, F.lit(0)), F.format_string(f"#{prefix}_%s %s", "name", "value").alias("line")),
    }
    out = None
    for name, make in parts.items():
        if name in tables:
            lines = make(tables[name])
            out = lines if out is None else out.union(lines)
    return out


def stitcher_lines(output_: DataFrame, images_: DataFrame) -> DataFrame:
    """project_id, place, line: a stitcher's script: the output line, and images with values in the place of links."""
    p = output_lines(output_).filter("part = 0").select("project_id", F.lit(0).cast("long").alias("place"), "line")
    return p.union(image_lines(images_, "o").select("project_id", (F.col("img_nr") + 1).cast("long"), "line"))


def coordinates(lines: DataFrame, with_image: bool = False) -> DataFrame:
    """place, img_nr (null for pairs), x, y of lines that hold two numbers (three, the first an image, with_image); others are left out."""
    parts = F.split(F.trim("line"), r"\s+")
    n = 3 if with_image else 2
    get = lambda k, kind: F.get(parts, F.lit(k)).try_cast(kind)
    image = get(0, "int") if with_image else F.lit(None).cast("int")
    found = lines.filter(F.size(parts) == n).select("place", image.alias("img_nr"), get(n - 2, "double").alias("x"), get(n - 1, "double").alias("y"))
    return found.filter("x IS NOT NULL AND y IS NOT NULL" + (" AND img_nr IS NOT NULL" if with_image else ""))


def image_list(files: DataFrame) -> DataFrame:
    """img_nr, filename, width, height: files (filename, width, height, bits) that could be decoded (a size is known) and have more than one bit a
    pixel, numbered from 0 in natural order."""
    good = files.filter("width > 0 AND height > 0 AND bits > 1").dropDuplicates(["filename"])
    return row_numbers(good.withColumn("_key", natural_key(F.col("filename"))), "img_nr", ["_key", "filename"]).select("img_nr", "filename", "width", "height")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes project_id, place, line as text: a folder for each project, its lines in order."""
    lines.repartition("project_id").sortWithinPartitions("project_id", "place").select("project_id", F.col("line").alias("value")).write.partitionBy("project_id").text(path)
