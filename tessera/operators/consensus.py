"""Sample consensus: the model, solved from a few drawn rows, that most rows of a group agree with. For any model, in groups of any size.

A draw takes the rows of a group whose hashes with the draw's number are least, so it is the same however rows are dealt. A group of up to ``LOCAL`` rows is
one task's work. In a larger one, tasks send their least rows for each draw, the draws are solved from these, and all models are scored
against blocks of ``BLOCK`` rows, whose counts are added up. Both ways give the same model.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LOCAL, BLOCK = 20_000, 4096
#: Draws that are solved or scored at once, at least; in small groups as many as make so many pairs of a draw and a row.
DRAWS, PAIRS = 50, 200_000


class Model(Protocol):
    """columns: of a row; sample: rows of a draw; size: numbers of a solution."""

    columns: tuple[str, ...]
    sample: int
    size: int

    def solve(self, draws: np.ndarray) -> np.ndarray:
        """Solutions (draw, size) of draws (draw, row, column); NaN where a draw determines none."""
        ...

    def error(self, solutions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How far each row is from each solution (solution, row); dimensions before these are those of both."""
        ...

    def error_column(self, solution: Column) -> Column:
        """:meth:`error` of a row and its own solution (array), without Python."""
        ...


def _triangle(a: np.ndarray, columns: int) -> None:
    """The first columns of many systems (row, column, system) made triangular in place by Householder's reflections, which the others follow. What is under the
    diagonal isn't cleared."""
    for c in range(columns):
        v = a[c:, c].copy()
        norm = np.sqrt(functools.reduce(np.add, v * v))
        half = norm * (norm + np.abs(v[0]))
        a[c, c] = -np.copysign(norm, v[0])
        v[0] -= a[c, c]
        others = a[c:, c + 1 :]
        w = functools.reduce(np.add, (by * row for by, row in zip(v, others, strict=True)))  # in one order, whatever the number of systems
        w *= np.where(half > 0, 1 / half, 0.0)
        for by, row in zip(v, others, strict=True):
            row -= by * w


def _back(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions (column, system) of triangular systems (row, column, system) and right sides (row, system)."""
    x = np.empty(b.shape)
    for c in range(len(b) - 1, -1, -1):
        rest = b[c]
        for k in range(c + 1, len(b)):
            rest = rest - a[c, k] * x[k]
        x[c] = rest / a[c, c]
    return x


def _least_squares(m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions (system, column) of many small systems m x = b by Householder's reflections, all systems at once, and which are far from undetermined."""
    rows, columns = m.shape[1:]
    if rows < columns:
        return np.zeros((len(m), columns)), np.zeros(len(m), bool)
    a = np.ascontiguousarray(np.concatenate([m, b[..., None]], axis=2).transpose(1, 2, 0))
    with np.errstate(all="ignore"):
        _triangle(a, columns)
        x = _back(a[:columns, :columns], a[:columns, columns])
    size = np.abs(a[np.arange(columns), np.arange(columns)])
    return x.T.copy(), size.min(axis=0) > 1e-8 * size.max(axis=0)


class Homography:
    """x1, y1 to x2, y2 by nine numbers, the last one 1; least squares over the sample."""

    columns, size = ("x1", "y1", "x2", "y2"), 9

    def __init__(self, sample: int = 5):
        self.sample = sample

    def solve(self, draws: np.ndarray) -> np.ndarray:
        k, n = draws.shape[:2]
        x, y, u, v = points = np.ascontiguousarray(draws.transpose(2, 1, 0), np.float64)
        if n < 4:
            h, rest = np.empty((9, k)), np.arange(k)
        else:
            # equations of u and of v differ in their right sides and in the two columns that they share: both are made triangular by the same
            # reflections of (x, y, 1), and the rows that these leave determine the shared numbers
            a, h = np.empty((n, 9, k)), np.empty((9, k))
            a[:, 0], a[:, 1], a[:, 2], a[:, 5], a[:, 8] = x, y, 1, u, v
            a[:, 3], a[:, 4], a[:, 6], a[:, 7] = -x * u, -y * u, -x * v, -y * v
            with np.errstate(all="ignore"):
                _triangle(a, 3)
                shared = np.concatenate([a[3:, 3:6], a[3:, 6:9]])
                _triangle(shared, 2)
                h[6:8], h[8] = _back(shared[:2, :2], shared[:2, 2]), 1
                for at in (3, 6):
                    h[at - 3 : at] = _back(a[:3, :3], a[:3, at + 2] - a[:3, at] * h[6] - a[:3, at + 1] * h[7])
                size = np.abs([a[0, 0], a[1, 1], a[2, 2], shared[0, 0], shared[1, 1]])
                below = np.abs(x * h[6] + y * h[7] + 1)
                sure = (size.min(axis=0) > 1e-8 * size.max(axis=0)) & (below.min(axis=0) > 1e-6 * np.maximum(1, below.max(axis=0)))
            rest = np.flatnonzero(~sure)
        # near to undetermined, or a drawn row lies where the solution has no value (there rounding decides): by singular values
        if len(rest):
            h[:, rest] = self._by_singular_values(points[:, :, rest].transpose(2, 1, 0)).T
        return h.T

    @staticmethod
    def _by_singular_values(draws: np.ndarray) -> np.ndarray:
        a, b = draws[..., :2], draws[..., 2:]
        k, n = a.shape[:2]
        m = np.zeros((k, 2 * n, 8))
        m[:, 0::2, 0:2], m[:, 0::2, 2] = a, 1
        m[:, 1::2, 3:5], m[:, 1::2, 5] = a, 1
        m[:, 0::2, 6:8], m[:, 1::2, 6:8] = -a * b[..., :1], -a * b[..., 1:]
        u, s, v = np.linalg.svd(m, full_matrices=False)
        full = s[:, -1] > s[:, 0] * np.finfo(float).eps * max(m.shape[1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (v.transpose(0, 2, 1) @ ((u.transpose(0, 2, 1) @ b.reshape(k, 2 * n, 1)) / s[..., None]))[..., 0]
        x[~full] = np.nan
        return np.concatenate([x, np.ones((k, 1))], axis=1)

    def error(self, solutions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        h = [solutions[..., :, None, i] for i in range(9)]
        x, y, u, v = (rows[..., None, :, i] for i in range(4))
        with np.errstate(all="ignore"):
            z = h[6] * x + h[7] * y + h[8]
            return np.hypot((h[0] * x + h[1] * y + h[2]) / z - u, (h[3] * x + h[4] * y + h[5]) / z - v)

    def error_column(self, solution: Column) -> Column:
        x, y, u, v = (F.col(c).cast("double") for c in self.columns)
        h = [F.get(solution, F.lit(i)) for i in range(9)]
        z = h[6] * x + h[7] * y + h[8]
        return F.hypot(F.try_divide(h[0] * x + h[1] * y + h[2], z) - u, F.try_divide(h[3] * x + h[4] * y + h[5], z) - v)

    def agree(self, solutions: np.ndarray, rows: np.ndarray, distance: float) -> np.ndarray:
        """How many rows have an :meth:`error` under distance (..., solution), for solutions of (..., solution, 9) and rows of (..., row, 4). Differences times the
        denominator are products of matrices, without a division or a root. Where one is so near to the bound that rounding might decide, error does."""
        n = rows.shape[-2]
        place = np.concatenate([rows[..., :2], np.ones((*rows.shape[:-1], 1))], axis=-1)
        f = np.zeros((*rows.shape[:-2], 3 * n, 9))
        f[..., :n, :3] = f[..., n : 2 * n, 3:6] = place
        f[..., :n, 6:], f[..., n : 2 * n, 6:], f[..., 2 * n :, 6:] = -place * rows[..., 2:3], -place * rows[..., 3:], distance * place
        with np.errstate(all="ignore"):
            most = np.abs(solutions).max(axis=-1)
            g = f @ solutions.swapaxes(-1, -2)
            g *= g
            apart, bound = g[..., :n, :], g[..., 2 * n :, :]
            apart += g[..., n : 2 * n, :]
            apart -= bound
            count = (apart < 0).sum(axis=-2)
            bound *= 1e-9
            bound += np.square(1e-8 * most * np.abs(f).max(axis=(-1, -2))[..., None])[..., None, :]
            unsure = ~(np.abs(apart, out=apart) > bound).all(axis=-2)
        count[np.isnan(most)] = 0
        at = np.nonzero(unsure & ~np.isnan(most))
        count[at] = (self.error(solutions[at][:, None], rows[at[:-1]]) < distance).sum(axis=-1).reshape(-1)
        return count


class Line:
    """y by x: slope and offset; a row's distance is taken along y."""

    columns, sample, size = ("x", "y"), 2, 2

    def solve(self, draws: np.ndarray) -> np.ndarray:
        (x0, y0), (x1, y1) = draws[:, 0].T, draws[:, 1].T
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(x0 == x1, np.nan, (y1 - y0) / np.where(x0 == x1, 1.0, x1 - x0))
        return np.column_stack([slope, y0 - slope * x0])

    def error(self, solutions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.abs(rows[..., None, :, 1] - solutions[..., 1:] - solutions[..., :1] * rows[..., None, :, 0])

    def error_column(self, solution: Column) -> Column:
        x, y = (F.col(c).cast("double") for c in self.columns)
        return F.abs(y - F.get(solution, F.lit(1)) - F.get(solution, F.lit(0)) * x)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finisher of splitmix64 (fixed constants)."""
    x, shifted = x.copy(), np.empty_like(x)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= np.right_shift(x, np.uint64(by), out=shifted)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def _ordered(hashes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Each draw's order of rows (..., draw, row), as hashes; dimensions before the rows are groups."""
    return _mix(hashes.astype(np.int64).view(np.uint64)[..., None, :] ^ _mix(draws.astype(np.uint64) + np.uint64(1))[:, None])


def _picked(hashes: np.ndarray, draws: np.ndarray, sample: int) -> np.ndarray:
    """Numbers (group, draw, sample) of each draw's rows, those with the least hashes of (group, row), in order."""
    g, n = hashes.shape
    if n == sample:
        return np.tile(np.arange(n), (g, len(draws), 1))
    # rows' numbers take the place of the lowest bits, so values are parted instead of their indexes; where those bits decide, indexes are
    low = np.uint64((1 << (n - 1).bit_length()) - 1)
    coded = _ordered(hashes, draws).reshape(-1, n)
    coded &= ~low
    coded |= np.arange(n, dtype=np.uint64)
    coded.partition(sample, axis=1)
    picks = (coded[:, :sample] & low).astype(np.int64)
    for k in np.flatnonzero((functools.reduce(np.maximum, coded[:, :sample].T) ^ coded[:, sample]) <= low):
        group, draw = divmod(k, len(draws))
        picks[k] = np.argpartition(_ordered(hashes[group], draws[draw : draw + 1])[0], sample - 1)[:sample]
    picks.sort(axis=1)
    return picks.reshape(g, len(draws), sample)


def _array(table: pa.Table, name: str, kind: type) -> np.ndarray:
    column = table.column(name)
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, kind)


def _rows(table: pa.Table, model: Model) -> np.ndarray:
    return np.column_stack([_array(table, c, np.float64) for c in model.columns])


def _agree(model: Model, solutions: np.ndarray, rows: np.ndarray, distance: float) -> np.ndarray:
    """How many rows (..., row, column) each solution (..., solution, number) is near to; NaN is near to none."""
    if hasattr(model, "agree"):
        return model.agree(solutions, rows, distance)
    with np.errstate(invalid="ignore"):
        return (model.error(solutions, rows) < distance).sum(axis=-1)


def _best(model: Model, rows: np.ndarray, hashes: np.ndarray, distance: float, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Best solutions (group, number) of groups of one size, and how many of (group, row, column) each is near to. Rows are in order of their hashes (group, row)."""
    groups, n, columns = rows.shape
    best, most, todo, at = np.zeros((groups, model.size)), np.zeros(groups, np.int64), np.arange(groups), 0
    while at < draws and len(todo):
        # the first draws often end it; later ones are taken in larger parts where rows are few
        which = np.arange(at, min(at + (max(DRAWS, PAIRS // (2 * n)) if at else DRAWS), draws))
        part = max(1, PAIRS // (n * len(which)))
        for mine in (todo[k : k + part] for k in range(0, len(todo), part)):
            picks = (_picked(hashes[mine], which, model.sample) + np.arange(len(mine))[:, None, None] * n).reshape(-1, model.sample)
            again = slice(None)
            if math.comb(n, model.sample) < 4 * len(which):  # equal samples are solved once
                picks, again = np.unique(picks, axis=0, return_inverse=True)
            values = np.ascontiguousarray(rows[mine].reshape(-1, columns).T)
            solutions = model.solve(values.take(np.ascontiguousarray(picks.T), axis=1, mode="clip").transpose(2, 1, 0)).T[:, again].reshape(model.size, len(mine), len(which)).transpose(1, 2, 0)
            agree = _agree(model, solutions, rows[mine], distance)
            first, found = agree.argmax(axis=1), agree.max(axis=1)
            better = np.flatnonzero(found > most[mine])
            best[mine[better]], most[mine[better]] = solutions[better, first[better]], found[better]
        todo, at = todo[most[todo] < n], which[-1] + 1  # no later draw is better than one that all rows are near to
    return best, most


def consensus(rows: DataFrame, keys: list[str], identity: str, model: Model, distance: float, draws: int, seed: int = 1) -> DataFrame:
    """keys, solution, inliers, n: each group's solution that is nearer than ``distance`` to most of its rows (ties: the earlier draw). Rows of a group differ in
    ``identity``. A group with fewer rows than a sample, or without a draw that determines a solution, has none. Equal samples are solved once."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    of_key = lambda t, n: {k: pa.concat_arrays([t.column(k).combine_chunks().slice(0, 1)] * n) if n else t.column(k).combine_chunks().slice(0, 0) for k in keys}
    rows = rows.filter(functools.reduce(Column.__and__, (F.col(k).isNotNull() for k in keys)))
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    values = rows.select(*keys, F.xxhash64(identity, F.lit(seed)).alias("_h"), *(F.col(c).cast("double").alias(c) for c in model.columns))
    result = f"{named}, solution array<double>, inliers long, n long"

    def several(table: pa.Table) -> pa.Table:
        code = np.zeros(table.num_rows, np.int64)
        for k in keys:  # numbers of the keys so far, so that codes stay small
            encoded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(encoded.dictionary) + np.asarray(encoded.indices, np.int64), return_inverse=True)[1]
        x, h = _rows(table, model), _array(table, "_h", np.int64)
        order = np.lexsort((*x.T, h, code))  # hashes decide and then values, not how rows came
        x, h, sizes = x[order], h[order], np.bincount(code)
        starts, best, most = np.cumsum(sizes) - sizes, np.zeros((len(sizes), model.size)), np.zeros(len(sizes), np.int64)
        for n in np.unique(sizes[sizes >= model.sample]):  # groups of one size at once
            mine = np.flatnonzero(sizes == n)
            at = starts[mine, None] + np.arange(n)
            best[mine], most[mine] = _best(model, x[at], h[at], distance, draws)
        some = np.flatnonzero(most)
        solutions = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * model.size, pa.int32()), pa.array(best[some].ravel()))
        return pa.table({**{k: table.column(k).take(pa.array(order[starts[some]])) for k in keys}, "solution": solutions, "inliers": most[some], "n": sizes[some]})

    # small groups go to Python together, about LOCAL rows at once
    few, many = sizes.agg(F.sum(F.when(F.col("_n") <= LOCAL, F.col("_n"))), F.count_if(F.col("_n") > LOCAL)).first()
    buckets = max(1, (few or 0) // LOCAL)
    alone = values.join(sizes.filter(F.col("_n") > LOCAL), keys, "left_anti") if many else values
    # draws take long for the bytes of their rows, by which a shuffle would make few and uneven tasks
    tasks = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism))
    small = alone.withColumn("_k", F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition(tasks, "_k").groupBy("_k").applyInArrow(several, result)
    if not many:
        return small

    large = cut(values.join(sizes.filter(F.col("_n") > LOCAL), keys))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code = np.unique(np.column_stack([_array(table.set_column(0, "c", table.column(k).combine_chunks().dictionary_encode().indices), "c", np.int64) for k in keys]), axis=0, return_inverse=True)[1]
            h = _array(table, "_h", np.int64)
            for g in np.unique(code):
                mine = np.flatnonzero(code == g)
                s = min(model.sample, len(mine))
                for at in range(0, draws, DRAWS):
                    which = np.arange(at, min(at + DRAWS, draws))
                    of = _ordered(h[mine], which)
                    pick = np.argpartition(of, s - 1, axis=1)[:, :s] if s < len(mine) else np.tile(np.arange(s), (len(which), 1))
                    take = table.take(pa.array(mine[pick].ravel())).drop_columns(["_n"]).combine_chunks()
                    part = np.repeat(which, s)
                    place = np.take_along_axis(of, pick, axis=1).ravel()
                    yield take.append_column("_draw", pa.array(part, pa.int32())).append_column("_place", pa.array(place.view(np.int64), pa.int64())).to_batches()[0]

    kind = f"{named}, _h long, {', '.join(f'{c} double' for c in model.columns)}, _draw int, _place long"
    # places are unsigned: the sign bit is turned so that their order stays
    unsigned = F.col("_place").bitwiseXOR(F.lit(-(1 << 63)))
    drawn = large.mapInArrow(least, kind).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_draw").orderBy(unsigned))).filter(F.col("_k") <= model.sample)

    def solved(table: pa.Table) -> pa.Table:
        x, draw, h = _rows(table, model), _array(table, "_draw", np.int64), _array(table, "_h", np.int64)
        order = np.lexsort((h, draw))
        solutions = model.solve(x[order].reshape(-1, model.sample, len(model.columns)))
        return pa.table({**of_key(table, 1), "_all": pa.array([solutions.astype(np.float64).tobytes()], pa.binary())})

    solutions = cut(drawn.groupBy(*keys).applyInArrow(solved, f"{named}, _all binary"))
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    dealt = large.withColumn("_b", F.pmod(F.xxhash64("_h"), blocks).cast("int"))
    sent = solutions.join(sizes, keys).select(*keys, "_all", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"))

    def scored(block: pa.Table, all_: pa.Table) -> pa.Table:
        if not block.num_rows or not all_.num_rows:
            return pa.table({**of_key(block if block.num_rows else all_, 0), "_draw": pa.array([], pa.int32()), "_c": pa.array([], pa.int64())})
        s = np.frombuffer(all_.column("_all")[0].as_py(), np.float64).reshape(-1, model.size)
        x = _rows(block, model)
        agree = np.concatenate([_agree(model, s[at : at + DRAWS], x, distance) for at in range(0, len(s), DRAWS)])
        return pa.table({**of_key(block, len(agree)), "_draw": pa.array(np.arange(len(agree)), pa.int32()), "_c": pa.array(agree, pa.int64())})

    counts = dealt.groupBy(*keys, "_b").cogroup(sent.groupBy(*keys, "_b")).applyInArrow(scored, f"{named}, _draw int, _c long")
    totals = counts.groupBy(*keys, "_draw").agg(F.sum("_c").alias("_c"))
    best = totals.groupBy(*keys).agg(F.max(F.struct("_c", (-F.col("_draw")).alias("_d"))).alias("_best")).filter("_best._c > 0")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_pylist()
            rows_ = [np.frombuffer(b, np.float64).reshape(-1, model.size)[a].tolist() for a, b in zip(at, batch.column("_all").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(rows_, pa.list_(pa.float64())), batch.column("inliers"), batch.column("n")], [*keys, "solution", "inliers", "n"])

    picked = best.join(solutions, keys).join(sizes, keys).select(*keys, (-F.col("_best._d")).alias("_at"), "_all", F.col("_best._c").alias("inliers"), F.col("_n").alias("n"))
    return small.unionByName(picked.mapInArrow(chosen, result))


def near(rows: DataFrame, keys: list[str], found: DataFrame, model: Model, distance: float) -> DataFrame:
    """Rows of groups in found (keys, solution) that are nearer than ``distance`` to the group's solution."""
    joined = rows.join(found.select(*keys, F.col("solution").alias("_solution")), keys).select(*rows.columns, "_solution")
    return joined.filter(model.error_column(F.col("_solution")) < distance).select(*rows.columns)  # NaN is over every distance
