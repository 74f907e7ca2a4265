"""Pixel tables by square tiles: what a task holds is one tile, with its surroundings or with the rows that ask for it.

Pixels: img, x, y, v. Pixels that aren't there, or are null, count as zero; rows without img, x or y are left out, and a place
that is there more than once has one of its values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

TILE = 256
#: Rows that ask for one tile go to tasks in parts of about this many, each with its own copy of the tile.
MOST_ASKED = 4096


def named(pixels: DataFrame) -> DataFrame:
    kept = pixels.select("img", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    return kept.filter("img IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")


def sizes(pixels: DataFrame) -> DataFrame:
    """img, w, h: places from 0 to the largest x and y of any row."""
    return pixels.filter("img IS NOT NULL").groupBy("img").agg((F.max("x") + 1).cast("long").alias("w"), (F.max("y") + 1).cast("long").alias("h"))


def _cells(place: str, reach: Column, tile: int) -> Column:
    return F.explode(F.sequence(F.floor((F.col(place) - reach) / tile), F.floor((F.col(place) + reach) / tile)))


def numbers(t: pa.Table, c: str, of: type = np.float64) -> np.ndarray:
    return np.asarray(t.column(c).combine_chunks(), of)


def block(t: pa.Table, left: int, top: int, width: int, height: int) -> np.ndarray:
    """The values (rows by columns) of a table of x, y, v."""
    out = np.zeros((height, width))
    out[numbers(t, "y", np.int64) - top, numbers(t, "x", np.int64) - left] = numbers(t, "v")
    return out


def summed(v: np.ndarray) -> np.ndarray:
    """Sums of all values above and to the left, with a first row and column of zeros."""
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    np.cumsum(np.cumsum(v, axis=0), axis=1, out=out[1:, 1:])
    return out


def boxes(table: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Sums over boxes, ends included, of the part that the table covers."""
    h, w = table.shape
    a, b = np.clip(x0, 0, w - 1), np.clip(x1 + 1, 0, w - 1)
    c, d = np.clip(y0, 0, h - 1), np.clip(y1 + 1, 0, h - 1)
    return table[d, b] + table[c, a] - table[d, a] - table[c, b]


def with_surroundings(pixels: DataFrame, halo: int, tile: int, answer: Callable[[np.ndarray, int, int, int, int, int, int], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """img and ``fields``: answer(values, left, top, tx, ty, w, h) of each tile with ``halo`` pixels on all sides. A pixel goes to the tiles whose
    surroundings it is in, at most four while the halo is under half a tile."""
    given = named(pixels)
    kind = dict(given.dtypes)["img"]
    dealt = given.join(sizes(pixels), "img").withColumn("tx", _cells("x", F.lit(halo), tile)).withColumn("ty", _cells("y", F.lit(halo), tile))
    inside = (F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") * tile < F.col("w")) & (F.col("ty") * tile < F.col("h"))

    def one(t: pa.Table) -> pa.Table:
        tx, ty, w, h = (int(t.column(c)[0].as_py()) for c in ("tx", "ty", "w", "h"))
        left, top = max(tx * tile - halo, 0), max(ty * tile - halo, 0)
        right, bottom = min((tx + 1) * tile + halo, w), min((ty + 1) * tile + halo, h)
        near = t.filter(pa.array((numbers(t, "x", np.int64) >= left) & (numbers(t, "y", np.int64) >= top)))
        out = answer(block(near, left, top, right - left, bottom - top), left, top, tx, ty, w, h)
        n = len(next(iter(out.values())))
        return pa.table({"img": pa.array([t.column("img")[0].as_py()] * n, t.schema.field("img").type), **out})

    return dealt.filter(inside).groupBy("img", "tx", "ty").applyInArrow(one, f"img {kind}, {fields}")


def asking(pixels: DataFrame, asked: DataFrame, reach: Column, answer: Callable[[np.ndarray, int, int, pa.Table], pa.Array], kind: str, tile: int = TILE) -> DataFrame:
    """Columns of ``asked`` (img, x, y and others) and ``part``, of type ``kind``: answer(values, left, top, rows) of each tile that a row's places
    within ``reach`` of (x, y) lie in; nothing for tiles without pixels. A tile that many rows ask for is copied, for some thousands of them each."""
    columns = asked.columns
    asked = cut(asked)  # it is counted and dealt: once made, also where it is a search of its own
    places = asked.withColumn("_r", reach).withColumn("tx", _cells("x", F.col("_r"), tile)).withColumn("ty", _cells("y", F.col("_r"), tile)).drop("_r")
    crowd = places.groupBy("img", "tx", "ty").agg(F.ceil(F.count("*") / MOST_ASKED).cast("int").alias("_n"))
    keys = ["img", "tx", "ty"]
    spread = places.join(crowd, keys).withColumn("_k", F.pmod(F.hash(*columns), F.col("_n"))).drop("_n")
    held = named(pixels).withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile)).join(crowd, keys)
    held = held.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + f", part {kind}"

    def one(rows: pa.Table, source: pa.Table) -> pa.Table:
        if rows.num_rows and source.num_rows:
            left, top = (int(rows.column(c)[0].as_py()) * tile for c in ("tx", "ty"))
            return rows.select(columns).append_column("part", answer(block(source, left, top, tile, tile), left, top, rows))
        return rows.select(columns).slice(0, 0).append_column("part", pa.array([], answer_type))

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    answer_type = to_arrow_type(_parse_datatype_string(kind))
    return spread.groupBy(*keys, "_k").cogroup(held.groupBy(*keys, "_k")).applyInArrow(one, schema)
