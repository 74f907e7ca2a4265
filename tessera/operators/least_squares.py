"""Robust least squares of all groups at once, by damped rounds over tables (Levenberg-Marquardt).

A group (a project, or a pair of images) has items with numbered slots; a slot is fixed or belongs to a variable, and slots of one variable
share its value. An observation names two items of its group. Observations are packed once, where they are: a pack holds rows of the same two
items. A round joins packs with their items' values and sums the normal
equations: each task adds up JᵀJ, Jᵀr and r² of its packs by the variables of their two items and sends one row for each pair of variables it
met, so what is shuffled depends on the variables, not on the observations, and a group that holds most observations is split like any
other. Damping, acceptance and roll-back are arithmetic on one small row a group. Groups that are done take no part in later rounds.

Where all groups together have few items and variables (``LOCAL_ITEMS``, ``LOCAL_ENTRIES``), the driver keeps these small rows: a round sends the values to the tasks and
gets the summed equations back, one query a round. With more of either the rows are a table, and a round is a few queries over it. Both take the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Residuals (rows by any number) of rows: values of the first and second item (rows by slots; one row if all rows share it) and the data columns by name.
#: A method ``slopes(p, q, data, used)`` may give them with their derivatives (used slots by residuals by rows) or None; else differences are taken.
Residuals = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], np.ndarray]

START_DAMPING = 1e-3
MOST_DAMPING = 1e12
#: A group is done once a step lowers its cost by less than this share, or its steps are shorter than this share of its values.
SETTLED, SHORT = 1e-10, 1e-9
#: Or once its mean square is below this.
TINY = 1e-18
#: Rows of a pack at most, rows that a task holds while it packs them, and rows of a pack that is worked on by itself.
PACK, HELD, ALONE = 4096, 200_000, 256
#: Rows of smaller packs that are worked on together.
ROWS = 4096
#: Values of up to this many items go to every task; beyond it packs are shuffled to them.
FEW_ITEMS = 50_000
#: A data column of this name says how many observations a row stands for.
STANDS_FOR = "_stands_for"
#: Items, and entries of all groups' normal equations, up to which the driver makes the steps.
LOCAL_ITEMS, LOCAL_ENTRIES = 5_000, 50_000


class Packs(NamedTuple):
    """rows: group, i, j, _n, _data: the data columns named, each as ``_n`` doubles, one after another."""

    rows: DataFrame
    names: list[str]


def huber(x: np.ndarray, sigma: float) -> np.ndarray:
    """Signed residuals, beyond sigma as the root of sigma (2 |x| - sigma): their squares grow linearly there."""
    size = np.abs(x)
    return np.where(size <= sigma, x, np.sign(x) * np.sqrt(np.maximum(sigma * (2 * size - sigma), 0)))


def packed(observations: DataFrame) -> Packs:
    """Observations (group, i, j and data columns) in packs. Tasks pack the rows that they hold; nothing is shuffled."""
    names = [c for c in observations.columns if c not in ("group", "i", "j")]
    kinds = dict(observations.dtypes)
    keys = ("group", "i", "j")

    def packs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        code = np.zeros(table.num_rows, np.int64)
        for c in keys:
            column = pa.concat_arrays(table.column(c).chunks).dictionary_encode()
            code = code * len(column.dictionary) + np.asarray(column.indices, np.int64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(starts, len(code)))
        starts = np.concatenate([np.arange(a, a + n, PACK) for a, n in zip(starts, sizes, strict=True)]) if sizes.max() > PACK else starts
        ends = np.append(starts[1:], len(code))
        data = np.array([np.asarray(table.column(n), np.float64)[order] for n in names]).reshape(len(names), len(code))
        first = table.select(keys).take(pa.array(order[starts]))
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // (16 * PACK))) + 1):
            blobs = pa.array([data[:, starts[k] : ends[k]].tobytes() for k in part], pa.binary())
            some = first.slice(part[0], len(part)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(some.column(c).chunks) for c in keys), pa.array((ends - starts)[part], pa.int32()), blobs], [*keys, "_n", "_data"])

    def all_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD:
                yield from packs(held)
                held, n = [], 0
        if n:
            yield from packs(held)

    known = observations.select(*keys, *names).dropna(subset=list(keys))  # rows without items have no part
    return Packs(known.mapInArrow(all_packs, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _n int, _data binary"), names)


def kept(observations: DataFrame) -> Packs:
    """Packs that are made once, for all rounds."""
    packs = packed(observations)
    return Packs(cut(packs.rows), packs.names)


def _derivatives(of: Residuals, p: np.ndarray, q: np.ndarray, data: dict[str, np.ndarray], used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (n, r) and their derivatives (used slots, r, n), central differences unless the residuals know them."""
    if hasattr(of, "slopes"):
        known = of.slopes(p, q, data, used)
        if known is not None:
            return known
    every = lambda r: r if len(r) == n else np.broadcast_to(r, (n, r.shape[1]))
    r = every(of(p, q, data))
    slots = p.shape[1]
    out = np.zeros((len(used), r.shape[1], n))
    for k, s in enumerate(used):
        at = [p, q]
        side, c = divmod(int(s), slots)
        here = at[side][:, c]
        h = 1e-5 * np.maximum(1.0, np.abs(here))
        ends = []
        for sign in (1, -1):
            moved = at[side].copy()
            moved[:, c] = here + sign * h
            ends.append(every(of(*(moved if k_ == side else at[k_] for k_ in (0, 1)), data)))
        out[k] = ((ends[0] - ends[1]) / (2 * h)[:, None]).T
    return r, out


class Values(NamedTuple):
    """Items' values and numbers, a row an item, and each item's row by group and item."""

    row: dict[tuple, int]
    values: np.ndarray
    numbers: np.ndarray


def _normal(rows: DataFrame, of: Residuals, names: list[str], kind: str, items: Broadcast[Values] | None = None) -> DataFrame:
    """group, p, q, v: each task's sums of JᵀJ (p, q), Jᵀr (p, -1), r² (-1, -1) and the number of rows (-2, -2). rows: packs, joined with
    their items' values unless items has them; packs of other items have no part."""

    def known(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        if items is None:
            p, q = (np.asarray(batch.column(c).flatten(), np.float64).reshape(batch.num_rows, -1) for c in ("p", "q"))
            number = np.concatenate([np.asarray(batch.column(c).flatten(), np.int64).reshape(batch.num_rows, -1) for c in ("np", "nq")], axis=1)
            return batch, p, q, number
        row, values, numbers = items.value
        group = batch.column("group").to_pylist()
        at = np.array([[row.get((g, x), -1) for g, x in zip(group, batch.column(c).to_pylist(), strict=True)] for c in ("i", "j")])
        kept = np.flatnonzero((at >= 0).all(axis=0))
        i, j = at[:, kept]
        return batch.take(pa.array(kept)), values[i], values[j], np.concatenate([numbers[i], numbers[j]], axis=1)

    def sums(p: np.ndarray, q: np.ndarray, number: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries (pack, p, q, v) of packs, one or some; p, q, number: a row a pack."""
        n, used = int(sizes.sum()), np.flatnonzero((number >= 0).any(axis=0))
        columns = dict(zip(names, data, strict=True))
        if len(sizes) == 1:
            r, j = _derivatives(of, p, q, columns, used, n)
            flat = j.reshape(len(used), -1)
            jj, jr, rr = (flat @ flat.T)[None], (flat @ r.T.reshape(-1))[None], np.array([(r * r).sum()])
        else:
            r, j = _derivatives(of, np.repeat(p, sizes, axis=0), np.repeat(q, sizes, axis=0), columns, used, n)
            j, starts = j.transpose(2, 1, 0), np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts, axis=0)
            jj, jr, rr = add(np.einsum("nra,nrb->nab", j, j)), add(np.einsum("nra,nr->na", j, r)), add((r * r).sum(axis=1))
        if STANDS_FOR in columns:
            sizes = np.add.reduceat(columns[STANDS_FOR], np.cumsum(sizes) - sizes)
        numbers = number[:, used]
        a, b = np.broadcast_to(numbers[:, :, None], jj.shape), np.broadcast_to(numbers[:, None, :], jj.shape)
        both, some = (a >= 0) & (b >= 0), numbers >= 0
        k, minus = np.arange(len(sizes)), np.full(len(sizes), -1)
        return (
            np.concatenate([np.nonzero(both)[0], np.nonzero(some)[0], k, k]), np.concatenate([a[both], numbers[some], minus, minus - 1]),
            np.concatenate([b[both], np.full(some.sum(), -1), minus, minus - 1]), np.concatenate([jj[both], jr[some], rr, sizes]),
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, p, q, number = known(batch)
            if not batch.num_rows:
                continue
            groups = batch.column("group").dictionary_encode()
            code = np.asarray(groups.indices, np.int64)
            sizes, blobs = np.asarray(batch.column("_n"), np.int64), batch.column("_data")
            small = np.flatnonzero(sizes < ALONE)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[small]) // ROWS)) + 1
            parts = [*([k] for k in np.flatnonzero(sizes >= ALONE)), *(x for x in np.split(small, cuts) if len(x))]
            out = []
            for part in parts:
                part = np.asarray(part)
                data = np.concatenate([np.frombuffer(blobs[int(k)].as_buffer(), np.float64).reshape(len(names), sizes[k]) for k in part], axis=1)
                of_pack, *entries = sums(p[part], q[part], number[part], sizes[part], data)
                out.append((code[part][of_pack], *entries))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            frame = pd.DataFrame(dict(zip("gpqv", columns, strict=True))).groupby(["g", "p", "q"], sort=False, as_index=False)["v"].sum()
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(frame["g"])), pa.array(frame["p"], pa.int32()), pa.array(frame["q"], pa.int32()), pa.array(frame["v"], pa.float64())], ["group", "p", "q", "v"])

    return rows.mapInArrow(summed, f"group {kind}, p int, q int, v double")


def valued(slots: DataFrame, state: DataFrame) -> DataFrame:
    """group, item, values, numbers (-1: fixed): an item's slots in order, variables with their values in state."""
    known = slots.join(state.select("group", "x"), "group")
    now = F.when(F.col("number") < 0, F.col("value")).otherwise(F.get("x", "number"))
    rows = known.groupBy("group", "item").agg(F.array_sort(F.collect_list(F.struct("slot", now.alias("value"), "number"))).alias("_s"))
    return rows.select("group", "item", F.transform("_s", lambda s: s.value).alias("values"), F.transform("_s", lambda s: s.number).alias("numbers"))


def few_items(slots: DataFrame) -> bool:
    """Whether the values of all items may go to every task."""
    return slots.select("group", "item").distinct().count() <= FEW_ITEMS


def with_items(observations: DataFrame, items: DataFrame, few: bool = False) -> DataFrame:
    """Observations (group, i, j and data) with both items' values (p, q) and numbers (np, nq)."""
    sent = F.broadcast if few else lambda df: df
    first = items.select("group", F.col("item").alias("i"), F.col("values").alias("p"), F.col("numbers").alias("np"))
    second = items.select("group", F.col("item").alias("j"), F.col("values").alias("q"), F.col("numbers").alias("nq"))
    return observations.join(sent(first), ["group", "i"]).join(sent(second), ["group", "j"])


def numbered(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots (group, item, slot, variable, value) with the variable's number in its group (-1 where variable is null), and group, variable, number,
    value of the variables; a variable starts with the value of its first item."""
    free = slots.filter(F.col("variable").isNotNull())
    starts = free.groupBy("group", "variable").agg(F.min(F.struct("item", "slot", "value")).alias("_f"))
    number = F.row_number().over(Window.partitionBy("group").orderBy("variable")) - 1
    variables = cut(starts.select("group", "variable", number.alias("number"), F.col("_f.value").alias("value")))
    with_number = slots.join(variables.select("group", "variable", "number"), ["group", "variable"], "left")
    return cut(with_number.withColumn("number", F.coalesce("number", F.lit(-1)))), variables


def normal_sums(terms: list[tuple[DataFrame | Packs, Residuals]], slots: DataFrame, state: DataFrame, few: bool | None = None) -> DataFrame:
    """group, p, q, v: the normal equations at the state's values (see ``_normal``), summed over all terms. few: see :func:`few_items`."""
    kind = dict(slots.dtypes)["group"]
    items = valued(slots, state)
    few = few_items(slots) if few is None else few
    parts = []
    for observations, of in terms:
        packs = observations if isinstance(observations, Packs) else packed(observations)
        rows = with_items(packs.rows, items, few).select("group", "p", "q", "np", "nq", "_n", "_data")
        parts.append(_normal(rows, of, packs.names, kind))
    return _added(parts)


def _added(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    return both.groupBy("group", "p", "q").agg(F.sum("v").alias("v"))


_STATE = "x array<double>, best array<double>, normal array<double>, gradient array<double>, cost double, start double, expected double, damping double, factor double, rounds int, n long, done boolean"


def _solve(normal: np.ndarray, gradient: np.ndarray, damping: float) -> np.ndarray:
    scale = np.diag(normal).copy()
    scale[scale <= 0] = 1.0
    return np.linalg.lstsq(normal + damping * np.diag(scale), -gradient, rcond=None)[0]


def _step(state: dict, sums: pd.DataFrame | dict[str, np.ndarray], rounds: int) -> dict:
    """The group's next state, from the sums at its candidate x: the candidate is taken if its cost is lower, else the
    step is made again with more damping. Damping is relative to the diagonal."""
    s = dict(state)
    m = len(s["x"])
    kept = sums["q"] >= 0
    new, slope = np.zeros((m, m)), np.zeros(m)
    new[sums["p"][kept], sums["q"][kept]] = sums["v"][kept]
    grad = (sums["p"] >= 0) & (sums["q"] == -1)
    slope[sums["p"][grad]] = sums["v"][grad]
    cost = float(sums["v"][(sums["p"] == -1)].sum())
    s["n"] = int(sums["v"][sums["p"] == -2].sum())
    s["rounds"] += 1
    first = s["best"] is None
    if first:
        s["start"] = cost
    if first or cost < s["cost"]:
        if not first:
            gain = (s["cost"] - cost) / max(s["expected"], 1e-300)
            s["damping"] *= max(1 / 3, 1 - (2 * gain - 1) ** 3)
            s["factor"] = 2.0
            s["done"] = s["cost"] - cost <= SETTLED * s["cost"]
        s["best"], s["normal"], s["gradient"], s["cost"] = list(s["x"]), new.ravel().tolist(), slope.tolist(), cost
    else:
        s["damping"] *= s["factor"]
        s["factor"] *= 2
    s["done"] = bool(s["done"] or m == 0 or s["cost"] <= TINY * s["n"])
    if not s["done"]:
        best, gradient = np.array(s["best"]), np.array(s["gradient"])
        step = _solve(np.array(s["normal"]).reshape(m, m), gradient, s["damping"])
        s["expected"] = float(-step @ gradient - 0.5 * step @ np.array(s["normal"]).reshape(m, m) @ step) * 2
        s["x"] = (best + step).tolist()
        s["done"] = bool(np.abs(step).max() <= SHORT * (np.abs(best).max() + SHORT) or s["damping"] > MOST_DAMPING or s["rounds"] >= rounds)
    if s["done"]:
        s["x"] = s["best"]
    return s


def minimise(terms: list[tuple[DataFrame | Packs, Residuals]], slots: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """slots with fitted values, and group, cost, start_cost, n, rounds.

    terms: observations (group, i, j, data columns; or their packs, cut by the caller) and their residuals; slots: group, item, slot (0 and up, the same for each item), variable
    (null: fixed), value. Groups without variables keep their values; groups without observations keep them, too, and have no cost.
    """
    slots, variables = numbered(slots)
    terms = [(o if isinstance(o, Packs) else kept(o), of) for o, of in terms]
    entries = variables.groupBy("group").agg(F.pow(F.count("*") + 2, F.lit(2)).alias("_e")).agg(F.sum("_e")).first()[0] or 0
    n_items = slots.select("group", "item").distinct().count()
    if n_items <= LOCAL_ITEMS and entries <= LOCAL_ENTRIES:
        return _minimise_few(terms, slots, variables, rounds)
    few = n_items <= FEW_ITEMS
    kind = dict(slots.dtypes)["group"]
    starts = variables.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "value"))), lambda s: s.value).alias("x"))
    groups = slots.select("group").distinct().join(starts, "group", "left")
    none = lambda of: F.lit(None).cast(of)
    state = groups.select(
        "group", F.coalesce("x", F.array().cast("array<double>")).alias("x"), none("array<double>").alias("best"), none("array<double>").alias("normal"), none("array<double>").alias("gradient"),
        none("double").alias("cost"), none("double").alias("start"), none("double").alias("expected"), F.lit(START_DAMPING).alias("damping"), F.lit(2.0).alias("factor"), F.lit(0).alias("rounds"), none("long").alias("n"), F.lit(False).alias("done"),
    )
    state = cut(state)

    def advance(key: tuple, held: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        row = held.iloc[0].to_dict()
        if not len(sums):
            return held.assign(done=True)
        row = {k: (None if v is None or (np.isscalar(v) and pd.isna(v)) else v) for k, v in row.items()}
        return pd.DataFrame([_step(row, sums.reset_index(drop=True), rounds)])[list(held.columns)]

    while True:
        live = state.filter(~F.col("done"))
        sums = normal_sums(terms, slots, live, few)
        moved = live.groupBy("group").cogroup(sums.groupBy("group")).applyInPandas(advance, f"group {kind}, {_STATE}")
        state = cut(state.filter("done").unionByName(moved))
        if not state.filter(~F.col("done")).head(1):
            break
    fitted = state.select("group", F.coalesce("best", "x").alias("x"))
    return cut(_with_values(slots, fitted)), state.select("group", "cost", F.col("start").alias("start_cost"), "n", "rounds")


def _with_values(slots: DataFrame, fitted: DataFrame) -> DataFrame:
    return slots.join(fitted, "group").select("group", "item", "slot", "variable", F.when(F.col("number") < 0, F.col("value")).otherwise(F.get("x", "number")).alias("value"))


def _minimise_few(terms: list[tuple[Packs, Residuals]], slots: DataFrame, variables: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """:func:`minimise` for few items and variables, whose values and sums the driver holds."""
    spark, kind = slots.sparkSession, dict(slots.dtypes)["group"]
    held = slots.select("group", "item", "slot", "number", "value").toArrow().sort_by([("slot", "ascending")]).to_pydict()
    row: dict[tuple, int] = {}
    at = np.array([row.setdefault(key, len(row)) for key in zip(held["group"], held["item"], strict=True)], np.int64)
    width = max(held["slot"], default=-1) + 1
    fixed, numbers = np.zeros((len(row), width)), np.full((len(row), width), -1)
    fixed[at, held["slot"]], numbers[at, held["slot"]] = np.array(held["value"], np.float64), held["number"]
    blank = {"best": None, "normal": None, "gradient": None, "cost": None, "start": None, "expected": None, "damping": START_DAMPING, "factor": 2.0, "rounds": 0, "n": None, "done": False}
    state: dict = {g: {"x": [], **blank} for g in dict.fromkeys(held["group"])}
    started = variables.select("group", "number", "value").toArrow().sort_by([("number", "ascending")]).to_pydict()
    for g, value in zip(started["group"], started["value"], strict=True):
        state[g]["x"].append(value)
    while True:
        live = {key: k for key, k in row.items() if not state[key[0]]["done"]}
        if not live:
            break
        values = fixed.copy()
        for (g, _), k in live.items():
            free = numbers[k] >= 0
            values[k, free] = np.array(state[g]["x"])[numbers[k, free]]
        sent = spark.sparkContext.broadcast(Values(live, values, numbers))
        found = _added([_normal(packs.rows, of, packs.names, kind, sent) for packs, of in terms]).toArrow()
        sent.destroy()
        of_group: dict = {}
        for n, g in enumerate(found.column("group").to_pylist()):
            of_group.setdefault(g, []).append(n)
        p, q, v = (found.column(c).to_numpy() for c in "pqv")
        for g in {g for g, _ in live}:
            some = of_group.get(g)
            state[g] = {**state[g], "done": True} if some is None else _step(state[g], {"p": p[some], "q": q[some], "v": v[some]}, rounds)
    double = lambda x: None if x is None else float(x)
    done = [(g, [float(x) for x in (s["x"] if s["best"] is None else s["best"])], double(s["cost"]), double(s["start"]), s["n"], s["rounds"]) for g, s in state.items()]
    ended = spark.createDataFrame(done, f"group {kind}, x array<double>, cost double, start_cost double, n long, rounds int")
    return cut(_with_values(slots, F.broadcast(ended.select("group", "x")))), ended.drop("x")
