"""Streaming forms of the session and statistics operators: an extension, as images come in while a project is shot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, time: str, value: str, window: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """start, keys, n, mean, largest of each window; rows later than ``late`` behind the newest are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "mean", "largest")


def session_groups(stream: DataFrame, time: str, gap: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """keys, first, n: sessions of rows at most gap apart."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("session_window.start").alias("first"), "n")
