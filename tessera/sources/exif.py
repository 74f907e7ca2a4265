"""Cameras' settings from the heads of JPEG and TIFF files, as a Spark data source: ``spark.read.format("exif").load(folder)``.

A file's directories are read by ranges: in a JPEG file the segments before the picture's data, in a TIFF file the two directories. Pixels are never
read. The columns are those of ``FIELDS``; with ``.schema(...)`` only the named ones are read. A tag that isn't there is null. A file that isn't an image or whose
directories are damaged gives a row with ``error`` set and the tags read so far.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalar import exif_crop

# Tags of the first directory and of the camera's own, their column and its type.
IMAGE_TAGS = {0x0100: ("width", "long"), 0x0101: ("height", "long"), 0x010F: ("make", "string"), 0x0110: ("model", "string"), 0x0112: ("orientation", "long")}
CAMERA_TAGS = {
    0x829A: ("exposure_time", "double"), 0x829D: ("f_number", "double"), 0x8827: ("iso", "double"), 0x9003: ("date", "string"),
    0x9201: ("shutter_speed", "double"), 0x9202: ("aperture", "double"), 0x9206: ("distance", "double"), 0x920A: ("focal_length", "double"),
    0xA002: ("pixels_x", "long"), 0xA003: ("pixels_y", "long"), 0xA20E: ("per_unit_x", "double"), 0xA20F: ("per_unit_y", "double"), 0xA210: ("unit", "long"),
    0xA402: ("exposure_mode", "long"), 0xA405: ("focal_length_35", "long"), 0xA434: ("lens", "string"),
}
CAMERA_DIRECTORY = 0x8769
#: Code and bytes of each type of value.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
FIELDS = {name: kind for name, kind in (*IMAGE_TAGS.values(), *CAMERA_TAGS.values())} | {"pano": "map<string,string>", "error": "string"}
SCHEMA = "path string, " + ", ".join(f"{c} {k}" for c, k in FIELDS.items())
#: Larger directories and values are damage.
MOST_ENTRIES, MOST_BYTES = 4096, 65536
FILES_A_TASK = 256
PANO = re.compile(rb"""GPano:(\w+)(?:\s*=\s*["']([^"']*)["']|\s*>([^<]*)<)""")


class Damaged(ValueError):
    """A file whose directories can't be read on."""


def _take(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) < n:
        raise Damaged(f"ends within {n} bytes at {at}")
    return got


def _value(f: BinaryIO, base: int, order: str, kind: int, count: int, inline: bytes) -> Any:
    code = TYPES[kind]
    n = struct.calcsize(order + code) * count
    if n > MOST_BYTES:
        raise Damaged(f"a value of {n} bytes")
    raw = inline[:n] if n <= 4 else _take(f, base + struct.unpack(order + "I", inline)[0], n)
    if code == "s":
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
    numbers = struct.unpack(order + code[0] * (n // struct.calcsize(code[0])), raw)
    if len(code) == 2:
        return numbers[0] / numbers[1] if numbers and numbers[1] else None
    return numbers[0] if numbers else None


def _directory(f: BinaryIO, base: int, order: str, offset: int, tags: dict[int, tuple[str, str]], out: dict[str, Any]) -> int | None:
    """Puts the tags' values in out; the offset of the camera's directory."""
    count = struct.unpack(order + "H", _take(f, base + offset, 2))[0]
    if count > MOST_ENTRIES:
        raise Damaged(f"a directory of {count} entries")
    entries = _take(f, base + offset + 2, 12 * count)
    further = None
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * k)
        inline = entries[12 * k + 8 : 12 * k + 12]
        if tag == CAMERA_DIRECTORY:
            further = struct.unpack(order + "I", inline)[0]
        elif tag in tags and kind in TYPES:
            name, of = tags[tag]
            value = _value(f, base, order, kind, n, inline)
            if value is not None and isinstance(value, str) == (of == "string"):
                out[name] = {"string": str, "long": int, "double": float}[of](value)
    return further


def _tiff(f: BinaryIO, base: int, out: dict[str, Any]) -> None:
    head = _take(f, base, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        raise Damaged("no byte order")
    further = _directory(f, base, order, struct.unpack(order + "I", head[4:])[0], IMAGE_TAGS, out)
    if further:
        _directory(f, base, order, further, CAMERA_TAGS, out)


def _jpeg(f: BinaryIO, out: dict[str, Any]) -> None:
    at, size = 2, {}
    while True:
        mark, code, length = struct.unpack(">BBH", _take(f, at, 4))
        if mark != 0xFF or length < 2:
            raise Damaged(f"no segment at {at}")
        if code == 0xFF:  # a filling byte
            at += 1
            continue
        if code in (0xDA, 0xD9):
            break
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            size["height"], size["width"] = struct.unpack(">HH", _take(f, at + 5, 4))
        elif code == 0xE1:
            segment = _take(f, at + 4, length - 2)
            if segment.startswith(b"Exif\0\0"):
                _tiff(io.BytesIO(segment), 6, out)
            elif segment.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                out["pano"] = {k.decode(): (a or b).decode("utf-8", "replace") for k, a, b in PANO.findall(segment)} or None
        at += 2 + length
    out.update(size)  # the picture's own size, whatever its tags say


def read_head(f: BinaryIO) -> dict[str, Any]:
    """The fields of an open file."""
    out: dict[str, Any] = {}
    try:
        start = _take(f, 0, 4)
        if start[:2] == b"\xff\xd8":
            _jpeg(f, out)
        elif start in (b"II*\0", b"MM\0*"):
            _tiff(f, 0, out)
        else:
            out["error"] = "neither JPEG nor TIFF"
    except (Damaged, OSError, struct.error, OverflowError) as e:
        out["error"] = str(e)
    return out


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeadReader(DataSourceReader):
    def __init__(self, where: str, columns: list[str]):
        self.where, self.columns = where, columns

    def _system(self) -> tuple[pafs.FileSystem, str]:
        where = self.where if "://" in self.where else re.sub("^file:", "", self.where)
        return pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where)

    def partitions(self) -> list[Files]:
        system, root = self._system()
        at = system.get_file_info(root)
        if at.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.where)
        found = [at] if at.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        paths = sorted(i.path for i in found if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_")))
        return [Files(paths[k : k + FILES_A_TASK]) for k in range(0, len(paths), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        only_path = self.columns == ["path"]
        for path in partition.paths:
            row: dict[str, Any] = {}
            if not only_path:
                with system.open_input_file(path) as f:
                    row = read_head(f)
            row["path"] = path
            yield tuple(row.get(c) for c in self.columns)


class ExifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeadReader:
        unknown = [c for c in schema.fieldNames() if c != "path" and c not in FIELDS]
        if unknown:
            raise ValueError(f"no such fields: {unknown}")
        return HeadReader(unquote(self.options["path"]), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the format "exif" known to a session."""
    spark.dataSource.register(ExifSource)


def parsed(df: DataFrame, head: str) -> DataFrame:
    """df without column ``head`` (the first bytes of a file, or all), and with the fields. A null head gives nulls only."""
    others = [c for c in df.columns if c != head]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), *(f"{c} {k}" for c, k in FIELDS.items())])
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = [{} if b is None else read_head(io.BytesIO(b)) for b in t.column(head).to_pylist()]
            fields = [pa.array([list(r[c].items()) if isinstance(r.get(c), dict) else r.get(c) for r in found], kinds[k]) for c, k in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in others), *fields], [*others, *FIELDS])

    return df.select(*others, head).mapInArrow(rows, schema)


def encoded(tags: dict[str, Any], order: str = "<", jpeg: tuple[int, int] | None = None) -> bytes:
    """A file's head with the given fields; within a JPEG file's segments if its width and height are given. Numbers that aren't whole are stored as millionths."""
    codes = {name: (tag, kind) for part in (IMAGE_TAGS, CAMERA_TAGS) for tag, (name, kind) in part.items()}
    body = b""

    def directory(names: list[str], at: int, extra: list[tuple[int, int, int, bytes]]) -> bytes:
        entries, behind = list(extra), at + 2 + 12 * (len(names) + len(extra)) + 4
        data = b""
        for name in names:
            tag, kind = codes[name]
            if kind == "string":
                raw = tags[name].encode() + b"\0"
                row = (tag, 2, len(raw), raw)
            elif kind == "long":
                row = (tag, 4, 1, struct.pack(order + "I", tags[name]))
            else:
                row = (tag, 5, 1, struct.pack(order + "II", round(tags[name] * 1_000_000), 1_000_000))
            if len(row[3]) > 4:
                row, data = (*row[:3], struct.pack(order + "I", behind + len(data))), data + row[3] + b"\0" * (len(row[3]) % 2)
            entries.append(row)
        packed = b"".join(struct.pack(order + "HHI", *e[:3]) + e[3].ljust(4, b"\0") for e in sorted(entries))
        return struct.pack(order + "H", len(entries)) + packed + b"\0\0\0\0" + data

    given = [n for n in codes if tags.get(n) is not None]
    first, second = ([n for n in given if codes[n][0] in part] for part in (IMAGE_TAGS, CAMERA_TAGS))
    size = len(directory(first, 8, [(CAMERA_DIRECTORY, 4, 1, b"\0" * 4)]))
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    body += directory(first, 8, [(CAMERA_DIRECTORY, 4, 1, struct.pack(order + "I", 8 + size))]) + directory(second, 8 + size, [])
    if jpeg is None:
        return body
    segment = b"Exif\0\0" + body
    frame = struct.pack(">BHHB", 8, jpeg[1], jpeg[0], 3) + bytes(9)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\2"


def camera(df: DataFrame) -> DataFrame:
    """df with what the project's images take from the fields: exposure_s, aperture_f, speed, roll, focal_mm, focal_35_mm, crop, projection, hfov_deg, shift_e.

    Exposure and aperture come from their logarithmic tags where the plain ones are missing; what is known nowhere is 0. roll is 0 if the tags' shape
    isn't the picture's (somebody turned it). crop: of both focal lengths; 1 if only that for 35 mm is there; else of the focal plane's resolution, and 0 where that says under 0.1 or nothing.
    A picture twice as wide as high, or marked as such and of the size it names, is equirectangular.
    """
    c = F.col
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    number = lambda k: F.expr(f"try_cast(pano['{k}'] AS double)")
    shape = F.abs(c("pixels_x") / F.nullif(c("pixels_y"), F.lit(0)) - c("width") / c("height")) > 0.1
    roll = F.when(F.coalesce((c("pixels_x") != 0) & shape, F.lit(False)), 0).otherwise(F.when(c("orientation") == 3, 180).when(c("orientation") == 6, 90).when(c("orientation") == 8, 270).otherwise(0))
    own, full = zero(c("focal_length")), zero(c("focal_length_35").cast("double"))
    plane = exif_crop(c("pixels_x"), c("pixels_y"), c("per_unit_x"), c("per_unit_y"), c("unit"), c("width"), c("height"))
    crop = F.when((own > 0) & (full > 0), full / F.nullif(own, F.lit(0.0))).when(full > 0, 1.0).otherwise(F.when(plane >= 0.1, plane).otherwise(0.0))
    marked: Column = (F.lower(F.expr("pano['ProjectionType']")) == "equirectangular") & (number("CroppedAreaImageWidthPixels") == c("width")) & (number("CroppedAreaImageHeightPixels") == c("height"))
    marked = F.coalesce(marked & (number("FullPanoWidthPixels") > 0) & number("FullPanoHeightPixels").isNotNull() & number("CroppedAreaTopPixels").isNotNull(), F.lit(False))
    double = F.coalesce(c("width") == 2 * c("height"), F.lit(False))
    return df.select(
        "*", zero(F.coalesce("exposure_time", F.pow(F.lit(2.0), -c("shutter_speed")))).alias("exposure_s"), zero(F.coalesce("f_number", F.pow(F.lit(2.0), c("aperture") / 2))).alias("aperture_f"),
        zero(c("iso")).alias("speed"), roll.alias("roll"), F.when((full > 0) & (own <= 0), full).otherwise(own).alias("focal_mm"), full.alias("focal_35_mm"), zero(crop).alias("crop"),
        F.when(marked | double, "equirectangular").alias("projection"), F.when(marked, F.round(360 * c("width") / number("FullPanoWidthPixels"), 3)).when(double, 360.0).alias("hfov_deg"),
        F.when(marked, F.round(-number("CroppedAreaTopPixels") - (c("height") - number("FullPanoHeightPixels")) / 2, 4)).alias("shift_e"),
    )
