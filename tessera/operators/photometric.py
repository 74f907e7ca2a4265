"""The photometric fit: exposure, white balance, vignetting and response of all projects' images from pairs of pixels.

Pairs: group, i, j (images), x1, y1, x2, y2 (offsets from the image centres over half the diagonal) and r1, g1, b1, r2, g2, b2 (values from 0 to 1).
Images: group, img, stack, lens, and the columns of ``PARAMETERS``, missing ones with their neutral values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .least_squares import Packs, huber, kept, minimise, normal_sums

#: Exposure value, balance of red and blue, vignetting coefficients and centre, weights of a response's basis curves; with their neutral values.
PARAMETERS = {"Eev": 0.0, "Er": 1.0, "Eb": 1.0, "Va": 1.0, "Vb": 0.0, "Vc": 0.0, "Vd": 0.0, "Vx": 0.0, "Vy": 0.0, "Ra": 0.0, "Rb": 0.0, "Rc": 0.0, "Rd": 0.0, "Re": 0.0}
NAMES = list(PARAMETERS)
EXPOSURE, BALANCE, VIGNETTING, RESPONSE = ("Eev",), ("Er", "Eb"), ("Vb", "Vc", "Vd"), ("Ra", "Rb", "Rc", "Rd", "Re")
SIGMA = 5 / 255
#: Beyond these a fit isn't believed: light left in a corner, and balance.
LEAST_CORNER, MOST_BALANCE = 0.7, 3.0


def _light(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each channel's light is multiplied by before the response (rows by 3)."""
    r2 = (x - p[:, 7]) ** 2 + (y - p[:, 8]) ** 2
    common = (p[:, 3] + r2 * (p[:, 4] + r2 * (p[:, 5] + r2 * p[:, 6]))) * np.exp2(-p[:, 0])
    return np.column_stack([common * p[:, 1], common, common * p[:, 2]])


def _light_slopes(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> Callable[[str], dict[int, np.ndarray]]:
    """Derivatives of :func:`_light` by a parameter, of the channels that it moves; a linear response has none."""
    dx, dy = x - p[:, 7], y - p[:, 8]
    r2, exposure = dx * dx + dy * dy, np.exp2(-p[:, 0])
    powers = p[:, 3] + r2 * (p[:, 4] + r2 * (p[:, 5] + r2 * p[:, 6]))
    balance = (p[:, 1], 1.0, p[:, 2])
    inward = -2 * (p[:, 4] + r2 * (2 * p[:, 5] + 3 * r2 * p[:, 6]))

    def of(name: str) -> dict[int, np.ndarray]:
        if name in ("Er", "Eb"):
            return {0 if name == "Er" else 2: powers * exposure}
        every = {"Eev": lambda: -np.log(2) * powers, "Va": lambda: 1.0, "Vb": lambda: r2, "Vc": lambda: r2 * r2, "Vd": lambda: r2 * r2 * r2, "Vx": lambda: inward * dx, "Vy": lambda: inward * dy}
        if name not in every:
            return {}
        slope = every[name]() * exposure
        return {c: slope * balance[c] for c in range(3)}

    return of


def _tables(p: np.ndarray, curves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The response tables of rows, before they are made monotone: the distinct ones, and which one each row has."""
    weights, which = np.unique(p[:, 9:14], axis=0, return_inverse=True)
    return curves[0] + weights[:, : len(curves) - 1] @ curves[1:], which


def _mapped(values: np.ndarray, tables: np.ndarray, which: np.ndarray, inverse: bool) -> np.ndarray:
    out, at = np.empty_like(values), np.linspace(0, 1, tables.shape[1])
    for k, table in enumerate(np.maximum.accumulate(tables, axis=1)):
        rows = which == k
        # an inverse needs rising values: level stretches give way by a hair
        out[rows] = np.interp(values[rows], table + 1e-12 * np.arange(len(table)), at) if inverse else np.interp(values[rows], at, table)
    return out


class PairResiduals:
    """Differences of a pair's values from what each image would record of the other's light, weighted by Huber's rule (sigma 0: plain)."""

    def __init__(self, curves: np.ndarray | None, sigma: float = SIGMA):
        self.curves, self.sigma = curves, sigma

    def __call__(self, p: np.ndarray, q: np.ndarray, data: dict[str, np.ndarray]) -> np.ndarray:
        one, two = (np.column_stack([data[f"{c}{k}"] for c in "rgb"]) for k in (1, 2))
        f, g = _light(p, data["x1"], data["y1"]), _light(q, data["x2"], data["y2"])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.curves is None:
                e, d = one - two / g * f, two - one / f * g
            else:
                (s, a), (t, b) = _tables(p, self.curves), _tables(q, self.curves)
                a, b = np.broadcast_to(a, len(one)), np.broadcast_to(b, len(one))
                e = one - _mapped(_mapped(two, t, b, True) / g * f, s, a, False)
                d = two - _mapped(_mapped(one, s, a, True) / f * g, t, b, False)
        both = np.nan_to_num(np.concatenate([e, d], axis=1), nan=1e6, posinf=1e6, neginf=-1e6)
        return huber(both, self.sigma) if self.sigma else both

    def slopes(self, p: np.ndarray, q: np.ndarray, data: dict[str, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if self.curves is not None:
            return None
        one, two = (np.array([data[f"{c}{k}"] for c in "rgb"]) for k in (1, 2))
        f, g = _light(p, data["x1"], data["y1"]).T, _light(q, data["x2"], data["y2"]).T
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            e, d = one - two / g * f, two - one / f * g
            by = [(-two / g, one / f * (g / f)), (two / g * (f / g), -one / f)]  # of e and d, by f and by g
            r = np.nan_to_num(np.concatenate([e, d]), nan=1e6, posinf=1e6, neginf=-1e6)
            bent = huber(r, self.sigma) if self.sigma else r
            scale = np.where(np.abs(r) > self.sigma, self.sigma / np.abs(bent), 1.0) if self.sigma else np.ones_like(r)
            scale[~np.isfinite(np.concatenate([e, d]))] = 0.0
            by = [np.concatenate(x) * scale for x in by]
            out = np.zeros((len(used), *r.shape))
            light = [_light_slopes(v, data[f"x{k}"], data[f"y{k}"]) for k, v in ((1, p), (2, q))]
            for k, s in enumerate(used):
                side, slot = divmod(int(s), len(NAMES))
                for c, slope in light[side](NAMES[slot]).items():
                    out[k, c], out[k, 3 + c] = by[side][c] * slope, by[side][3 + c] * slope
        return bent.T, np.nan_to_num(out, copy=False, nan=0.0, posinf=0.0, neginf=0.0)


class FallingResponse:
    """One residual an image: how far its response falls anywhere, as a sum of squares times the table's length."""

    def __init__(self, curves: np.ndarray):
        self.curves = curves

    def __call__(self, p: np.ndarray, q: np.ndarray, data: dict[str, np.ndarray]) -> np.ndarray:
        tables, which = _tables(p, self.curves)
        fall = np.maximum(tables[:, :-1] - tables[:, 1:], 0)
        return ((fall * fall).sum(axis=1) * tables.shape[1])[which][:, None]


def variables(images: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """group, item, slot, variable, value for :func:`minimise`.

    chosen: for each parameter to fit, the column that names who shares it: the image for a value of its own, the lens for
    a linked one, null where it stays as it is.
    """
    slots = []
    for n in NAMES:
        shared = chosen.get(n)
        name = F.lit(None).cast("string") if shared is None else F.when(shared.isNotNull(), F.concat_ws("|", F.lit(n), shared.cast("string")))
        slots.append(F.struct(F.lit(NAMES.index(n)).alias("slot"), name.alias("variable"), (F.coalesce(F.col(n), F.lit(PARAMETERS[n])) if n in images.columns else F.lit(PARAMETERS[n])).cast("double").alias("value")))
    return images.select("group", F.col("img").alias("item"), F.explode(F.array(*slots)).alias("_s")).select("group", "item", "_s.*")


def fit(pairs: DataFrame | Packs, images: DataFrame, chosen: dict[str, Column], curves: np.ndarray | None = None, sigma: float = SIGMA, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """images with fitted parameters (all of ``PARAMETERS``), and group, error (root mean square of the plain residuals), n, rounds.

    curves: a response's mean and basis curves, one a row, equally long; None: a linear response. Values of 0 and 1 are compared like any others.
    """
    pairs = pairs if isinstance(pairs, Packs) else kept(pairs)
    fitted, found = _fitted(pairs, images, chosen, curves, sigma, rounds)
    return fitted, found.join(plain_error(pairs, fitted, curves), "group", "left").select("group", "error", "n", "rounds", "cost", "start_cost")


def _fitted(pairs: Packs, images: DataFrame, chosen: dict[str, Column], curves: np.ndarray | None, sigma: float = SIGMA, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    images = cut(images)
    terms: list = [(pairs, PairResiduals(curves, sigma))]
    if curves is not None:
        terms.append((images.select("group", F.col("img").alias("i"), F.col("img").alias("j")), FallingResponse(curves)))
    slots, found = minimise(terms, variables(images, chosen), rounds)
    values = slots.groupBy("group", F.col("item").alias("img")).agg(*(F.max(F.when(F.col("slot") == k, F.col("value"))).alias(n) for k, n in enumerate(NAMES)))
    return cut(images.drop(*NAMES).join(values, ["group", "img"])), found


def plain_error(pairs: DataFrame | Packs, images: DataFrame, curves: np.ndarray | None = None) -> DataFrame:
    """group, error: the root mean square of a group's residuals without Huber's rule."""
    slots = variables(images, {}).withColumn("number", F.lit(-1))
    state = images.select("group").distinct().withColumn("x", F.array().cast("array<double>"))
    sums = normal_sums([(pairs, PairResiduals(curves, 0.0))], slots, state)
    of = lambda k: F.sum(F.when(F.col("p") == k, F.col("v")))
    return sums.groupBy("group").agg(F.sqrt(of(-1) / (6 * of(-2))).alias("error"))


def _own(reference: str) -> Column:
    """Who shares an exposure: the image's stack, but nobody in the reference image's stack."""
    return F.when(F.col("stack") != F.col(reference), F.col("stack"))


def smart_fit(pairs: DataFrame, images: DataFrame, balance: bool, exposure: bool = True, curves: np.ndarray | None = None, reference: int = 0) -> DataFrame:
    """images with fitted parameters and the kept ``stages``: exposure first; then vignetting, where a group has several stacks, taken back if
    a corner keeps less than 0.7 of the light; then response (with curves) and, if wanted, white balance. If
    that gives such a corner or a balance over 3, it is taken back and fitted once more without what went wrong.

    All groups go through a stage together; each has its own variables and its own roll-back. The reference image (``img``), or the
    first one, keeps its exposure and balance; images of a stack share them; images of a lens share vignetting and response.
    """
    by_group = images.groupBy("group").agg(F.countDistinct("stack").alias("_stacks"), F.coalesce(F.max(F.when(F.col("img") == reference, F.struct(F.lit(0).alias("o"), "stack"))), F.min(F.struct(F.col("img").alias("o"), F.col("stack")))).alias("_r"))
    now = images.join(by_group.select("group", "_stacks", F.col("_r.stack").alias("_ref")), "group")
    now = cut(now.select("group", "img", "stack", "lens", "_stacks", "_ref", *((F.coalesce(F.col(n).cast("double"), F.lit(v)) if n in images.columns else F.lit(v)).alias(n) for n, v in PARAMETERS.items())))
    pairs = kept(pairs)  # packed once for all stages
    off = F.lit(False)
    vig, resp, wb = F.col("_stacks") > 1, F.lit(curves is not None), F.lit(balance)

    def staged(rows: DataFrame, exp: bool, vig: Column, resp: Column, wb: Column) -> DataFrame:
        shared: dict[str, Column] = {}
        if exp:
            shared |= dict.fromkeys(EXPOSURE, _own("_ref"))
        shared |= dict.fromkeys(VIGNETTING, F.when(vig, F.col("lens"))) | dict.fromkeys(BALANCE, F.when(wb, _own("_ref")))
        if curves is not None:
            shared |= dict.fromkeys(RESPONSE[: len(curves) - 1], F.when(resp, F.col("lens")))
        return _fitted(pairs, rows, shared, curves)[0]

    def dark(rows: DataFrame) -> DataFrame:
        """group, _dark: whether the first image's corner is too dark, _odd: whether a balance is too strong."""
        corner = F.min_by(F.col("Va") + F.col("Vb") + F.col("Vc") + F.col("Vd"), "img") < LEAST_CORNER
        return rows.groupBy("group").agg(corner.alias("_dark"), F.max((F.col("Er") > MOST_BALANCE) | (F.col("Eb") > MOST_BALANCE)).alias("_odd"))

    def back(before: DataFrame, after: DataFrame, bad: Column, verdict: DataFrame) -> DataFrame:
        """Rows of after, of groups that are bad rows of before; with the verdict."""
        keep = after.join(verdict, "group").filter(~bad)
        return cut(keep.unionByName(before.join(verdict, "group").filter(bad)))

    if exposure:
        now = staged(now, True, off, off, off)
    after = staged(now, exposure, vig, off, off)
    now = back(now, after, F.col("_dark"), dark(after)).withColumnRenamed("_dark", "_no_vig").drop("_odd")
    vig = vig & ~F.col("_no_vig")
    after = staged(now, exposure, vig, resp, wb)
    verdict = dark(after)
    bad = F.col("_dark") | F.col("_odd")
    now = back(now, after, bad, verdict)
    again = staged(now.filter(bad), exposure, vig & ~F.col("_dark"), resp, wb & ~F.col("_odd"))
    done = now.filter(~bad).unionByName(again)
    stages = F.concat_ws(" ", *([F.lit("exposure")] if exposure else []), F.when(vig & ~F.col("_dark"), F.lit("vignetting")), F.when(resp, F.lit("response")), F.when(wb & ~F.col("_odd"), F.lit("balance")))
    return done.select("group", "img", "stack", "lens", *NAMES, stages.alias("stages"))
