"""Photometric arithmetic as Columns: response tables, exposure, vignetting and white balance. A table is an array of doubles over 0 to 1."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Value, col, once, vignetting


def gamma_table(gamma: float, size: int = 1024) -> Column:
    """The values k/(size - 1) to the power of gamma."""
    with np.errstate(divide="ignore"):
        return F.lit(((np.arange(size) / (size - 1)) ** gamma).tolist())


def look_up(table: Column, value: Column) -> Column:
    """The table at value (0 to 1; others count as the nearest end), between entries by a line."""
    def between(table: Column, at: Column, low: Column) -> Column:
        a, b = F.get(table, low), F.coalesce(F.get(table, low + 1), F.get(table, low))
        return a + (at - low) * (b - a)

    def found(table: Column) -> Column:
        last = F.size(table) - 1
        at = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * last
        return once(at, lambda at: once(F.least(F.floor(at).cast("int"), F.greatest(last - 1, F.lit(0))), lambda low: between(table, at, low)))

    return once(table, found)


def resize_table(table: Column, size: int) -> Column:
    """The table with another number of entries."""
    return once(table, lambda table: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: look_up(table, k / (size - 1))))


def invert_table(table: Column, value: Column) -> Column:
    """Where in a non-decreasing table the value is reached (0 to 1), between entries by a line; the ends for values beyond."""
    def between(table: Column, value: Column, low: Column) -> Column:
        a, b = F.get(table, low), F.get(table, low + 1)
        step = F.when(b > a, F.least(F.greatest((value - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return (low + step) / F.nullif(F.size(table) - 1, F.lit(0))

    def found(table: Column, value: Column) -> Column:
        at = F.aggregate(table, F.lit(0), lambda n, x: n + (x <= value).cast("int")) - 1  # the last entry that isn't over it
        return once(F.least(F.greatest(at, F.lit(0)), F.greatest(F.size(table) - 2, F.lit(0))), lambda low: between(table, value, low))

    return once(table, lambda table: once(value, lambda value: found(table, value)))


def basis_table(mean: Column, basis: list[Column], weights: list[Value]) -> Column:
    """A response from a mean curve and weighted basis curves (empirical models of responses have five); the curves are the caller's."""
    out = mean
    for curve, w in zip(basis, weights, strict=True):
        out = F.zip_with(out, F.transform(curve, _times(w)), lambda a, b: a + b)
    return out


def _times(w: Value) -> Callable[[Column], Column]:
    return lambda x: col(w) * x


def respond(value: Column, radius: Column, vig: tuple[float, float, float, float], exposure: Value, balance: Value = 1.0, table: Column | None = None) -> Column:
    """What a camera records: value times vignetting, exposure and white balance, through the response table, if there is one."""
    light = value * vignetting(radius, vig) * col(exposure) * col(balance)
    return light if table is None else look_up(table, light)


def unrespond(value: Column, radius: Column, vig: tuple[float, float, float, float], exposure: Value, balance: Value = 1.0, table: Column | None = None) -> Column:
    """The inverse of :func:`respond`; null where vignetting, exposure or balance are 0."""
    light = value if table is None else invert_table(table, value)
    return light / F.nullif(vignetting(radius, vig) * col(exposure) * col(balance), F.lit(0.0))


def corrected(value: Column, by: Column, how: str, mean: Value = 1.0, gamma: float = 1.0, gain: Value = 1.0, offset: Value = 0.0) -> Column:
    """Vignetting correction of a value: gamma undone, divided by a factor ("divide") or by a flat field over its mean ("flat"), or
    a term added ("add"); then brightness (gain and offset)."""
    linear = F.pow(value, F.lit(gamma))
    fixed = {
        "divide": lambda: linear / F.nullif(by, F.lit(0.0)),
        "flat": lambda: linear / F.nullif(by / col(mean), F.lit(0.0)),
        "add": lambda: linear + by,
    }[how]()
    return fixed * col(gain) + col(offset)


def well_exposed(value: Column, low: float, high: float) -> Column:
    """Neither too dark nor too bright; both ends count."""
    return value.between(low, high)
