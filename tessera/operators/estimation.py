"""Estimation over groups that have no relational form: a group is one pair, or one project, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .consensus import Homography, Line, consensus, near
from .statistics import line_fit


def solve_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3x3 homography of points a to b by least squares (last coefficient 1); None if they don't determine it."""
    n = len(a)
    m = np.zeros((2 * n, 8))
    m[0::2, 0:2], m[0::2, 2] = a, 1
    m[1::2, 3:5], m[1::2, 5] = a, 1
    m[0::2, 6:8], m[1::2, 6:8] = -a * b[:, :1], -a * b[:, 1:]
    x, _, rank, _ = np.linalg.lstsq(m, b.reshape(-1), rcond=None)
    return np.append(x, 1.0).reshape(3, 3) if rank == 8 else None


def ransac(matches: DataFrame, keys: list[str], rounds: int = 1000, distance: float = 50.0, sample: int = 5, least: int = 6, seed: int = 1) -> DataFrame:
    """Matches (keys, id, x1, y1, x2, y2) that fit their group's best homography; groups with under ``least`` matches, or
    more than half of them outliers, are dropped. Draws follow from the ids and the seed, so results repeat."""
    model = Homography(sample)
    found = consensus(matches, keys, "id", model, distance, rounds, seed)
    return near(matches, keys, found.filter((2 * F.col("inliers") >= F.col("n")) & (F.col("inliers") >= least)), model, distance)


def tries_needed(sure: float, outliers: float, sample: int) -> int:
    """Draws after which one is free of outliers with that probability."""
    clean = (1 - outliers) ** sample
    return 1 if clean >= 1 else int(np.ceil(np.log(1 - sure) / np.log(1 - clean)))


def ransac_line(points: DataFrame, keys: list[str], distance: float, sure: float = 0.999, outliers: float = 0.3, seed: int = 1) -> DataFrame:
    """keys, slope, offset, n, inliers: the line through two drawn points (x, y) that most points are near, then by least squares over
    those. Groups of under two points, or without a line that isn't vertical, have none."""
    model = Line()
    # equal points are told apart by their number among them, so that draws don't depend on how rows came
    twin = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy(F.lit(0)))
    numbered = cut(points.withColumn("_id", F.struct("x", "y", twin.alias("k"))))
    found = cut(consensus(numbered, keys, "_id", model, distance, tries_needed(sure, outliers, 2), seed))
    fit = line_fit(near(points, keys, found, model, distance), "x", "y", *keys)
    return fit.join(found.select(*keys, "n", "inliers"), keys).filter("inliers >= 2").select(*keys, "slope", "offset", "n", "inliers")


def greedy_stacks(overlaps: DataFrame, images: DataFrame, key: str = "project_id", threshold: float = 0.7) -> DataFrame:
    """key, img_nr, stack: the smallest image left opens a stack and takes all left that overlap it by more than threshold.

    overlaps: key, i, j, ratio. A project is one group.
    """

    def stack(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        close: dict[int, set[int]] = {}
        for i, j, r in right[["i", "j", "ratio"]].itertuples(index=False):
            if r > threshold:
                close.setdefault(int(i), set()).add(int(j))
                close.setdefault(int(j), set()).add(int(i))
        todo, out, number = sorted(set(left["img_nr"])), [], 0
        while todo:
            seed = todo[0]
            mine = {seed} | (close.get(seed, set()) & set(todo))
            out += [(keys[0], m, number) for m in sorted(mine)]
            todo = [x for x in todo if x not in mine]
            number += 1
        return pd.DataFrame(out, columns=[key, "img_nr", "stack"])

    kind = dict(images.dtypes)[key]
    return images.groupBy(key).cogroup(overlaps.groupBy(key)).applyInPandas(stack, f"{key} {kind}, img_nr long, stack long")


def greedy_layers(images: DataFrame, key: str = "project_id", limit: float = 0.5) -> DataFrame:
    """key, img_nr, layer: the smallest image left opens a layer and takes all left whose exposure differs from its own by less than limit."""

    rows = images.select(key, F.struct(F.col("img_nr").cast("long").alias("n"), F.col("ev").cast("double").alias("ev")).alias("_i"))
    projects = rows.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_i"))
    kind = dict(images.dtypes)[key]

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_i")
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            flat = lists.flatten()
            number, ev = flat.field("n"), np.asarray(flat.field("ev"), np.float64)
            project, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(ev), np.int64)
            todo, at = np.arange(len(ev)), 0
            while len(todo):  # a layer of every project at once
                first = np.flatnonzero(np.concatenate([[True], np.diff(project[todo]) > 0]))
                seed = np.repeat(ev[todo[first]], np.diff(np.append(first, len(todo))))
                mine = np.abs(ev[todo] - seed) < limit
                mine[first] = True
                out[todo[mine]] = at
                todo, at = todo[~mine], at + 1
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(project)), number, pa.array(out)], [key, "img_nr", "layer"])

    return projects.mapInArrow(layers, f"{key} {kind}, img_nr long, layer long")


def deghost(pixels: DataFrame, sigma: float = 30.0, rounds: int = 4) -> DataFrame:
    """img, x, y, v (0 to 255), weight: weights that fall where an image differs from its neighbourhood in all images.

    Start 1 - t^16 with t = v/127.5 - 1; each round multiplies by the mean of a Gaussian of differences over the
    eight neighbours of all images, weighted by last round's weights; the centre pixel itself is left out.
    """
    t = F.col("v") / 127.5 - 1
    now = pixels.select("img", "x", "y", "v", (1 - F.pow(t, F.lit(16))).alias("w"))
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    for _ in range(rounds):
        near = now.select(F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("p"), F.col("v").alias("vq"), F.col("w").alias("wq"))
        near = near.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), "vq", "wq")
        d = F.col("v") - F.col("vq")
        kernel = F.exp(-(d * d) / (2 * sigma * sigma))
        sums = now.join(near, ["x", "y"]).groupBy("img", "x", "y").agg(F.try_divide(F.sum(F.col("wq") * kernel), F.sum("wq")).alias("m"))
        now = cut(now.join(sums, ["img", "x", "y"], "left").select("img", "x", "y", "v", (F.col("w") * F.coalesce("m", F.lit(1.0))).alias("w")))
    most = now.agg(F.max("w").alias("_most"))
    return now.crossJoin(F.broadcast(most)).select("img", "x", "y", "v", F.coalesce(F.try_divide(F.col("w") * 255, F.col("_most")), F.lit(0.0)).alias("weight"))
