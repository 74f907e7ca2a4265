"""Lens tables and feature files as text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import LENS, LENS_VERSION, PHOTO_PAIRS


def read_lens_blocks(spark: SparkSession, path: str) -> DataFrame:
    """table, columns, values, place: rows of the TABLE=...; COLUMNS=a;b ... ENDTABLE blocks of a text file.

    A row with another number of values than its block has columns is left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
    w = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda name: F.last(F.when(F.col("line").startswith(f"{name}="), F.substring_index("line", "=", -1)), ignorenulls=True).over(w)
    open_ = F.last(F.when(F.col("line").startswith("TABLE="), F.lit(1)).when(F.col("line") == "ENDTABLE", F.lit(0)), ignorenulls=True).over(w)
    rows = lines.select("place", "line", head("TABLE").alias("table"), F.split(head("COLUMNS"), ";").alias("columns"), open_.alias("_open"))
    rows = rows.filter("_open = 1 AND columns IS NOT NULL").filter(~F.col("line").rlike("^(TABLE|COLUMNS)=")).withColumn("values", F.split("line", ";"))
    return rows.filter(F.size("values") == F.size("columns")).select("table", "columns", "values", "place")


def value_of(name: str, kind: str = "string") -> Column:
    """A value of a block's row by its column's name, whatever the case and order; null if there is none or it isn't of the kind."""
    at = F.array_position(F.transform("columns", lambda c: F.lower(c)), name.lower())
    return F.when(at > 0, F.element_at("values", at.cast("int"))).try_cast(kind)


def lens_table(blocks: DataFrame, table: str, name: str) -> DataFrame:
    """A lens table (a name of ``LENS``) from the blocks called table. Rows without a key are left out; a missing weight is 10."""
    schema, keys = LENS[name]
    columns = [tuple(c.split()) for c in schema.split(", ")]
    rows = blocks.filter(F.col("table") == table).select(*(value_of(c, kind).alias(c) for c, kind in columns))
    rows = rows.na.drop(subset=keys)
    return rows.na.fill({"weight": 10}) if "weight" in rows.columns else rows


def write_lens_table(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("sep", ";").csv(path)


def write_lens_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Lens tables (names of ``LENS``) as Parquet below path, each in a folder and exchanged whole (tables may read what they replace), with the version of the whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        replace_table(rows, f"{path}/{name}")
    replace_table(spark.range(1).select(F.lit(LENS_VERSION).alias("version")), f"{path}/version")


def open_lens_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All lens tables of a folder; those that aren't there yet are empty. ValueError for a newer version."""
    there = lambda name: _exists(spark, f"{path}/{name}")
    if there("version") and (v := spark.read.parquet(f"{path}/version").first().version) > LENS_VERSION:
        raise ValueError(f"lens tables of version {v}")
    return {name: spark.read.schema(kind).parquet(f"{path}/{name}") if there(name) else spark.createDataFrame([], kind) for name, (kind, _) in LENS.items()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_table(rows: DataFrame, path: str) -> None:
    """path with rows in place of what it held, whole or not at all: they are written beside it, then the folders are exchanged by
    renames. rows may read from path. (A store without atomic renames has a moment without the table between the two.)"""
    spark = rows.sparkSession
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    jvm = spark.sparkContext._jvm
    p = {k: jvm.org.apache.hadoop.fs.Path(v) for k, v in (("at", path), ("new", new), ("old", old))}
    fs = p["at"].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p["at"].getParent())
    if fs.exists(p["at"]) and not fs.rename(p["at"], p["old"]):
        raise OSError(f"can't move {path}")
    if not fs.rename(p["new"], p["at"]):
        fs.rename(p["old"], p["at"])
        raise OSError(f"can't replace {path}")
    fs.delete(p["old"], True)


def append_weighted(table: DataFrame, rows: DataFrame, weight: int = 10) -> DataFrame:
    """table with rows added; those without a weight get the usual one."""
    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(None).cast("int"))
    return table.unionByName(rows.withColumn("weight", F.coalesce("weight", F.lit(weight))).select(*table.columns))


def keypoint_lines(keypoints: DataFrame, images: DataFrame, kind: str = "text") -> DataFrame:
    """img_nr, place, line: feature files of images (img_nr, filename, width, height): "text" (count, length, points, file name, size), "ellipses" (length,
    count, points as ellipses) or "xml". keypoints: img_nr, kp_id, x, y, scale, orientation, score, vec."""
    n = lambda c: F.col(c).cast("string")
    counts = keypoints.groupBy("img_nr").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"))
    both = images.join(counts, "img_nr", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("dims", F.coalesce("dims", F.lit(0)))
    vec = F.transform("vec", lambda x: x.cast("string"))
    inverse = (1.0 / F.pow(2.5 * F.col("scale"), F.lit(2.0))).cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    descriptor = F.concat(tag("Dim", F.size("vec").cast("string")), tag("Descriptor", F.array_join(F.transform("vec", lambda x: F.concat(F.lit("<int>"), (x * 256).cast("string"), F.lit("</int>"))), "")))
    head, point, foot = {
        "text": ([n("n"), n("dims")], F.concat_ws(" ", n("y"), n("x"), n("scale"), n("orientation"), n("score"), F.array_join(vec, " ")), [F.col("filename"), F.concat_ws(" ", n("width"), n("height"))]),
        "ellipses": ([n("dims"), n("n")], F.concat_ws(" ", n("x"), n("y"), inverse, F.lit("0"), inverse, F.array_join(vec, " ")), []),
        "xml": (
            [F.lit('<?xml version="1.0" encoding="utf-8"?>'), F.concat(F.lit("<KeypointXMLList>"), tag("XDim", n("width")), tag("YDim", n("height")), tag("ImageFile", F.col("filename")), F.lit("<Arr>"))],
            F.concat(F.lit("<KeypointN>"), tag("X", n("x")), tag("Y", n("y")), tag("Scale", n("scale")), tag("Orientation", n("orientation")), F.when(F.size("vec") > 0, descriptor).otherwise(""), F.lit("</KeypointN>")),
            [F.lit("</Arr></KeypointXMLList>")],
        ),
    }[kind]
    fixed = lambda cells, at: both.select("img_nr", F.posexplode(F.array(*cells)).alias("k", "line")).select("img_nr", (F.col("k") + at).cast("long").alias("place"), "line")
    middle = keypoints.select("img_nr", (F.col("kp_id") + len(head)).cast("long").alias("place"), point.alias("line"))
    out = fixed(head, 0).union(middle)
    return out.union(fixed(foot, 1 << 40)) if foot else out


def read_rig(spark: SparkSession, path: str) -> DataFrame:
    """file, shot, bracket, yaw, pitch, roll of the shots of a motorised head's XML files (a pict with a position each)."""
    kind = "_id int, _bracket int, position struct<_yaw: double, _pitch: double, _roll: double>"
    shots = spark.read.format("xml").option("rowTag", "pict").schema(kind).load(path)
    return shots.select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("shot"), F.coalesce("_bracket", F.lit(1)).alias("bracket"), *(F.col(f"position._{c}").alias(c) for c in ("yaw", "pitch", "roll")))


def read_rig_header(spark: SparkSession, path: str) -> DataFrame:
    """file, crop_factor, lens_type, focallength of the same files' headers."""
    kind = "camera struct<sensor: struct<_coef: double>>, lens struct<_type: string, focal: double>"
    heads = spark.read.format("xml").option("rowTag", "header").schema(kind).load(path)
    return heads.select(F.col("_metadata.file_path").alias("file"), F.col("camera.sensor._coef").alias("crop_factor"), F.lower(F.trim("lens._type")).alias("lens_type"), F.col("lens.focal").alias("focallength"))


#: Lines of a job in a batch file, after the first one (the next id).
JOB = ("path", "prefix", "id", "status", "skip")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """file, place, path, prefix (null: no stitching), id, status, skip: jobs of batch files, in their order; unfinished ones at the end are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("l"))
    jobs = F.floor((F.size("l") - 1) / len(JOB)).cast("int")
    each = text.select("file", "l", F.explode(F.when(jobs > 0, F.sequence(F.lit(0), jobs - 1))).alias("place"))
    at = lambda k: F.get("l", 1 + len(JOB) * F.col("place") + k)
    return each.select("file", "place", at(0).alias("path"), F.nullif(at(1), F.lit("")).alias("prefix"), at(2).try_cast("long").alias("id"), at(3).try_cast("int").alias("status"), (at(4) == "T").alias("skip"))


def job_lines(jobs: DataFrame) -> DataFrame:
    """file, place, line: the text of batch files."""
    n = F.col("place") * len(JOB)
    cells = F.array("path", F.coalesce("prefix", F.lit("")), F.col("id").cast("string"), F.col("status").cast("string"), F.when(F.col("skip"), "T").otherwise("F"))
    rest = jobs.select("file", F.posexplode(cells).alias("k", "line"), n.alias("n")).select("file", (F.col("n") + F.col("k") + 1).cast("long").alias("place"), "line")
    return jobs.groupBy("file").agg((F.max("id") + 1).cast("string").alias("line")).select("file", F.lit(0).cast("long").alias("place"), "line").union(rest)


def read_photo_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Photometric pairs: 16 numbers a row; other rows are left out."""
    return spark.read.schema(PHOTO_PAIRS).option("sep", " ").option("mode", "DROPMALFORMED").csv(path)


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """file, kp_id, y, x, scale, orientation, score, vec: of feature files whose first line holds the count and the descriptor's length."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("l"))
    dims = F.split(F.element_at("l", 1), r"\s+")[1].try_cast("int")
    rows = lines.select("file", dims.alias("dims"), F.posexplode("l").alias("place", "line")).filter("place > 0").withColumn("kp_id", F.col("place") - 1)
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    rows = rows.withColumn("v", v).filter(F.size("v") == F.col("dims") + 5)
    return rows.select("file", "kp_id", *(F.col("v")[k].alias(c) for k, c in enumerate(("y", "x", "scale", "orientation", "score"))), F.slice("v", F.lit(6), F.size("v") - 5).alias("vec"))
