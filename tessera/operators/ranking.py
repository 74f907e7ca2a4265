"""Top-k, sieves and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def top(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each key; Spark keeps n a task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def cell(x: Column, low: Column | float, size: Column | float, cells: int) -> Column:
    """Whole-number grid cell of x in [low, low + size)."""
    return F.floor((x - low) * cells / size).cast("int")


def sieve(df: DataFrame, x: Column, y: Column, width: float, height: float, columns: int, rows: int, n: int, score: list[str]) -> DataFrame:
    """The n best rows of each cell of a grid, by score (largest first); rows of equal scores count once."""
    celled = df.withColumn("cell_x", cell(x, 0.0, width, columns)).withColumn("cell_y", cell(y, 0.0, height, rows))
    once = celled.dropDuplicates(["cell_x", "cell_y", *score])
    return top(once, n, ["cell_x", "cell_y"], [F.col(c).desc() for c in score])


def median_row(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The row at place n div 2 (from 0) of each key by value; the first where all values are equal."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_flat", F.min(value).over(w) == F.max(value).over(w))
    return placed.filter(F.col("_i") == F.when(F.col("_flat"), 0).otherwise(F.expr("_n div 2"))).drop("_i", "_n", "_flat")


def nearest(df: DataFrame, n: int, value: str, target: float, keys: list[str] | None = None) -> DataFrame:
    """The n rows nearest to target by value (ties: the smaller value), with their rank; of each key, if any."""
    order = [F.abs(F.col(value) - target), F.col(value)]
    if keys:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    some = df.orderBy(*order).limit(n)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def row_numbers(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """name: place from 0 in the whole table's order. Ranges of rows are numbered apart and moved by the sizes of those before."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def page(df: DataFrame, order: list[Column], skip: int, n: int) -> DataFrame:
    """n rows after the first ``skip`` in order."""
    return df.orderBy(*order).offset(skip).limit(n)


def sorted_points(points: DataFrame, column: str, down: bool, ties: list[str]) -> DataFrame:
    """points in order of a column, up or down; equal ones by ties."""
    return points.orderBy(F.col(column).desc() if down else F.col(column), *ties)


def seeded_sample(df: DataFrame, n: int, keys: list[str], row: list[str], seed: int = 1) -> DataFrame:
    """n rows of each of keys by a hash of the row and a seed: the same draw wherever the rows are."""
    return top(df, n, keys, [F.xxhash64(F.lit(seed), *row), *(F.col(c) for c in row)])


def within(df: DataFrame, distance: str, most: float, n: int | None, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows nearer than most (strictly) and, of each key, the n nearest (all without n): the results of a radius search."""
    near = df.filter(F.col(distance) < most)
    return near if n is None else top(near, n, keys, [F.col(distance), *(F.col(c) for c in ties)])
