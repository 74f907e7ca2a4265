"""Point transforms and predicates as Columns. A transform takes and gives (x, y); :func:`chain` composes them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import once

Point = tuple[Column, Column]
Transform = Callable[[Point], Point]


def chain(point: Point, *steps: Transform) -> Point:
    for step in steps:
        point = step(point)
    return point


def resize(sx: float, sy: float) -> Transform:
    return lambda p: (p[0] * sx, p[1] * sy)


def shear(a: float, b: float) -> Transform:
    return lambda p: (p[0] + a * p[1], p[1] + b * p[0])


def shift(dx: float, dy: float) -> Transform:
    return lambda p: (p[0] + dx, p[1] + dy)


def turn_erect(half_turn: float, by: float) -> Transform:
    """Turns a panorama horizontally: x is wrapped to one turn about the middle."""

    def step(p: Point) -> Point:
        x = p[0] + by
        full = 2 * half_turn
        return x - full * F.floor((x + half_turn) / full), p[1]

    return step


def radial(c: tuple[float, float, float, float], scale: float, most: float = 1000.0) -> Transform:
    """Radial polynomial c0 + c1 r + c2 r² + c3 r³ with r over scale; beyond most a fixed factor."""

    def step(p: Point) -> Point:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1]) / scale
        factor = F.when(r < most, c[0] + r * (c[1] + r * (c[2] + r * c[3]))).otherwise(1000.0)
        return p[0] * factor, p[1] * factor

    return step


def undo_radial(c: tuple[float, float, float, float], scale: float, rounds: int = 12) -> Transform:
    """Inverse of :func:`radial` by a fixed number of Newton steps."""

    def step(p: Point) -> Point:

        def undone(target: Column) -> Column:
            def newton(r: Column, _: Column) -> Column:
                value = r * (c[0] + r * (c[1] + r * (c[2] + r * c[3]))) - target
                slope = c[0] + r * (2 * c[1] + r * (3 * c[2] + r * 4 * c[3]))
                return once(slope, lambda slope: r - value / F.when(F.abs(slope) < 1e-12, 1e-12).otherwise(slope))

            r = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), target, newton)
            return F.when(target == 0, 1.0).otherwise(r / F.nullif(target, F.lit(0.0)))

        factor = once(F.sqrt(p[0] * p[0] + p[1] * p[1]) / scale, undone)
        return p[0] * factor, p[1] * factor

    return step


def vertical(c: tuple[float, float, float, float], scale: float) -> Transform:
    """The radial polynomial along y alone, in |y| over scale; x stays."""

    def step(p: Point) -> Point:
        r = F.abs(p[1]) / scale
        return p[0], p[1] * (c[0] + r * (c[1] + r * (c[2] + r * c[3])))

    return step


def undo_vertical(c: tuple[float, float, float, float], scale: float, rounds: int = 12) -> Transform:
    """Inverse of :func:`vertical`, by the Newton steps of :func:`undo_radial` on the y axis."""
    undo = undo_radial(c, scale, rounds)
    return lambda p: (p[0], undo((F.lit(0.0), p[1]))[1])


def deregister(c: tuple[float, float, float], scale: float) -> Transform:
    """Moves x by |y| (c0 + c1 r + c2 r²), r being |y| over scale."""

    def step(p: Point) -> Point:
        r = F.abs(p[1]) / scale
        return p[0] + F.abs(p[1]) * (c[0] + r * (c[1] + r * c[2])), p[1]

    return step


def radial_shift(c: tuple[float, float, float, float], scale: float, dx: float, dy: float, most: float = 1000.0) -> Transform:
    """:func:`radial`, then a shift."""
    return lambda p: chain(p, radial(c, scale, most), shift(dx, dy))


def shift_scale_rotate(dx: float, dy: float, scale: float, angle: float) -> Transform:
    """Moves by -(dx, dy), turns by angle (radians) and scales."""
    cos, sin = math.cos(angle), math.sin(angle)

    def step(p: Point) -> Point:
        x, y = p[0] - dx, p[1] - dy
        return (x * cos - y * sin) * scale, (x * sin + y * cos) * scale

    return step


def _turned(m: list[list[float]], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)


def persp_sphere(m: list[list[float]], d: float) -> Transform:
    """Turns the viewing ray of a point (equal angles) by the matrix m."""

    def step(p: Point) -> Point:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1])
        s = F.when(r == 0, 0.0).otherwise(F.sin(r / d) / F.nullif(r, F.lit(0.0)))
        x, y, z = _turned(m, (s * p[0], s * p[1], F.cos(r / d)))
        q = F.sqrt(x * x + y * y)
        t = F.when(q == 0, 0.0).otherwise(d * F.atan2(q, z) / F.nullif(q, F.lit(0.0)))
        return t * x, t * y

    return step


def persp_rect(m: list[list[float]], d: float, dx: float = 0.0, dy: float = 0.0) -> Transform:
    """Turns the ray of a point of a plane at distance d, moved by (dx, dy), and meets the plane again; null where it doesn't."""

    def step(p: Point) -> Point:
        x, y, z = _turned(m, (p[0] + dx, p[1] + dy, F.lit(float(d))))
        z = F.nullif(z, F.lit(0.0))
        return x * d / z, y * d / z

    return step


def rect_to_erect(d: float) -> Transform:
    def step(p: Point) -> Point:
        return d * F.atan2(p[0], F.lit(d)), d * F.atan2(p[1], F.sqrt(d * d + p[0] * p[0]))

    return step


def erect_to_rect(d: float) -> Transform:
    def step(p: Point) -> Point:
        a, b = p[0] / d, p[1] / d
        x = d * F.tan(a)
        return x, F.tan(b) * d / F.cos(a)

    return step


def pano_to_erect(d: float) -> Transform:
    return lambda p: (p[0], d * F.atan(p[1] / d))


def erect_to_pano(d: float) -> Transform:
    return lambda p: (p[0], d * F.tan(p[1] / d))


def rect_to_pano(d: float) -> Transform:
    def step(p: Point) -> Point:
        x = d * F.atan(p[0] / d)
        return x, p[1] * F.cos(x / d)

    return step


def pano_to_rect(d: float) -> Transform:
    return lambda p: (d * F.tan(p[0] / d), p[1] / F.cos(p[0] / d))


#: The transverse cylinder is computed as the upright one, as the programs that write such projects do.
transpano_to_erect, erect_to_transpano = pano_to_erect, erect_to_pano


def sphere_to_rect(d: float) -> Transform:
    """Fisheye (equal angles) to a plane; a point at a right angle or beyond goes far out."""

    def step(p: Point) -> Point:
        theta = F.sqrt(p[0] * p[0] + p[1] * p[1]) / d
        rho = F.when(theta >= math.pi / 2, 1.6e16).when(theta == 0, 1.0).otherwise(F.tan(theta) / F.nullif(theta, F.lit(0.0)))
        return rho * p[0], rho * p[1]

    return step


def rect_to_sphere(d: float) -> Transform:
    def step(p: Point) -> Point:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1]) / d
        theta = F.when(r == 0, 1.0).otherwise(F.atan(r) / F.nullif(r, F.lit(0.0)))
        return theta * p[0], theta * p[1]

    return step


def pano_to_sphere(d: float) -> Transform:
    def step(p: Point) -> Point:
        s = d * F.sin(p[0] / d)
        r = F.sqrt(s * s + p[1] * p[1])
        theta = F.when(r == 0, 1.0).otherwise(d * F.atan2(r, d * F.cos(p[0] / d)) / F.nullif(r, F.lit(0.0)))
        return theta * s, theta * p[1]

    return step


def sphere_to_pano(d: float) -> Transform:
    def step(p: Point) -> Point:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1])
        s = F.when(r == 0, 1.0 / d).otherwise(F.sin(r / d) / F.nullif(r, F.lit(0.0)))
        x, z = s * p[0], F.cos(r / d)
        return d * F.atan2(x, z), d * s * p[1] / F.nullif(F.sqrt(x * x + z * z), F.lit(0.0))

    return step


def erect_to_sphere_cp(d: float, b: float) -> Transform:
    """Polar form about the upper pole: the angle from x, the radius from y moved by b (both over a right angle)."""

    def step(p: Point) -> Point:
        phi, theta = -p[0] / (d * math.pi / 2), -(p[1] + b) / (math.pi / 2)
        return theta * F.cos(phi), theta * F.sin(phi)

    return step


def sphere_cp_to_erect(d: float, b: float) -> Transform:
    return lambda p: (d * F.atan2(p[1], -p[0]), F.sqrt(p[0] * p[0] + p[1] * p[1]) - b)


def pano_to_sphere_cp(d: float) -> Transform:
    def step(p: Point) -> Point:
        phi, theta = -p[0] / (d * math.pi / 2), math.pi / 2 + F.atan(p[1] / (d * math.pi / 2))
        return d * theta * F.cos(phi), d * theta * F.sin(phi)

    return step


def sphere_cp_to_mirror(d: float, b: float) -> Transform:
    """A mirror ball of radius b seen from afar, for a ray at the angle r / d."""

    def step(p: Point) -> Point:
        phi, rho = F.atan2(p[1], p[0]), b * F.sin(F.sqrt(p[0] * p[0] + p[1] * p[1]) / d / 2)
        return -rho * F.cos(phi), rho * F.sin(phi)

    return step


def erect_to_mirror(d: float, b: float, b2: float) -> Transform:
    def step(p: Point) -> Point:
        phi, rho = p[0] / (d * math.pi / 2), b * F.sin(-(p[1] + b2) / (d * math.pi / 2) / 2)
        return -rho * F.cos(phi), rho * F.sin(phi)

    return step


def pano_to_mirror(d: float, b: float) -> Transform:
    def step(p: Point) -> Point:
        phi = -p[0] / (d * math.pi / 2)
        rho = b * F.sin((math.pi / 2 + F.atan(p[1] / (d * math.pi / 2))) / 2)
        return rho * F.cos(phi), rho * F.sin(phi)

    return step


def mirror_to_sphere_cp(d: float, b: float) -> Transform:
    """Null outside the ball."""

    def step(p: Point) -> Point:
        rho = F.sqrt(p[0] * p[0] + p[1] * p[1]) / b
        theta, phi = 2 * F.asin(F.when(rho <= 1, rho)), F.atan2(p[1], p[0])
        return d * theta * F.cos(phi), d * theta * F.sin(phi)

    return step


def sphere_to_erect(d: float) -> Transform:
    """Fisheye (equal angles) to longitude and latitude."""

    def step(p: Point) -> Point:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1])
        theta = r / d
        s = F.when(theta == 0, 1.0 / d).otherwise(F.sin(theta) / F.nullif(r, F.lit(0.0)))
        v0, v1 = s * p[0], F.cos(theta)
        return d * F.atan2(v0, v1), d * F.atan2(s * p[1], F.sqrt(v0 * v0 + v1 * v1))

    return step


def erect_to_sphere(d: float) -> Transform:
    def step(p: Point) -> Point:
        a, b = p[0] / d, p[1] / d
        x, z, y = F.sin(a) * F.cos(b), F.cos(a) * F.cos(b), F.sin(b)
        r = F.sqrt(x * x + y * y)
        theta = F.atan2(r, z)
        f = F.when(r == 0, 0.0).otherwise(d * theta / F.nullif(r, F.lit(0.0)))
        return f * x, f * y

    return step


def erect_to_mercator(d: float) -> Transform:
    return lambda p: (p[0], d * F.ln(F.tan(p[1] / d) + 1 / F.cos(p[1] / d)))


def mercator_to_erect(d: float) -> Transform:
    return lambda p: (p[0], d * F.atan(F.sinh(p[1] / d)))


def erect_to_transverse_mercator(d: float) -> Transform:
    """x is d times the inverse hyperbolic tangent. The survey's source divides by the hyperbolic tangent, which its own inverse
    doesn't undo; here the two are inverses."""

    def step(p: Point) -> Point:
        x, y = p[0] / d, p[1] / d
        b = F.cos(y) * F.sin(x)
        return d / 2 * F.ln((1 + b) / (1 - b)), d * F.atan2(F.tan(y), F.cos(x))

    return step


def transverse_mercator_to_erect(d: float) -> Transform:
    def step(p: Point) -> Point:
        x, y = p[0] / d, p[1] / d
        return d * F.atan2(F.sinh(x), F.cos(y)), d * F.asin(F.sin(y) / F.cosh(x))

    return step


def erect_to_sinusoidal(d: float) -> Transform:
    return lambda p: (p[0] * F.cos(p[1] / d), p[1])


def sinusoidal_to_erect(d: float) -> Transform:
    return lambda p: (p[0] / F.cos(p[1] / d), p[1])


def erect_to_stereographic(d: float) -> Transform:
    def step(p: Point) -> Point:
        lon, lat = p[0] / d, p[1] / d
        k = 2 / (1 + F.cos(lat) * F.cos(lon))
        return d * k * F.cos(lat) * F.sin(lon), d * k * F.sin(lat)

    return step


def stereographic_to_erect(d: float) -> Transform:
    def step(p: Point) -> Point:
        x, y = p[0] / d, p[1] / d
        r = F.sqrt(x * x + y * y)
        c = 2 * F.atan(r / 2)
        sin = F.when(r == 0, 0.5).otherwise(F.sin(c) / F.nullif(r, F.lit(0.0)))
        return d * F.atan2(x * sin, F.cos(c)), d * F.asin(y * sin)

    return step


#: Image projections by number: rectilinear, cylinder, two fisheyes of equal angles, equirectangular.
TO_ERECT: dict[int, Callable[[float], Transform]] = {0: rect_to_erect, 1: pano_to_erect, 2: sphere_to_erect, 3: sphere_to_erect, 4: lambda d: lambda p: p}
FROM_ERECT: dict[int, Callable[[float], Transform]] = {0: erect_to_rect, 1: erect_to_pano, 2: erect_to_sphere, 3: erect_to_sphere, 4: lambda d: lambda p: p}


def _of_kind(kind: Column, kinds: dict[int, Callable[[Column], Transform]], d: Column, p: Point) -> Point:
    """The transform of the row's kind; null for kinds that aren't known."""
    x = y = F.lit(None).cast("double")
    for k, make in kinds.items():
        q = make(d)(p)
        x, y = F.when(kind == k, q[0]).otherwise(x), F.when(kind == k, q[1]).otherwise(y)
    return x, y


def _along(yaw: Column, pitch: Column, roll: Column, p: Point, d: Column, back: bool) -> Point:
    """Turns an equirectangular point (d pixels a radian) by the angles (degrees), or back."""
    lon, lat = p[0] / d, p[1] / d
    x, y, z = F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat)

    def turn(a: Column, u: Column, v: Column) -> Point:
        return u * F.cos(a) - v * F.sin(a), u * F.sin(a) + v * F.cos(a)

    a, b, c = F.radians(yaw), F.radians(pitch), F.radians(roll)
    if back:
        z, x = turn(-a, z, x)
        y, z = turn(-b, y, z)
        x, y = turn(-c, x, y)
    else:
        x, y = turn(c, x, y)
        y, z = turn(b, y, z)
        z, x = turn(a, z, x)
    return d * F.atan2(x, z), d * F.atan2(y, F.sqrt(x * x + z * z))


def _distance(kind: Column, hfov: Column, width: Column) -> Column:
    """Pixels a radian on the axis."""
    a = F.radians(hfov)
    return F.when(kind == 0, width / 2 / F.tan(a / 2)).otherwise(width / a)


def bound(p: Point, *steps: Transform) -> Point:
    """:func:`chain` for steps that use a coordinate many times: each step's result is computed once and named, where chained expressions
    would multiply."""
    pair = F.struct(p[0].alias("x"), p[1].alias("y"))
    for step in steps:
        pair = F.get(F.transform(F.array(pair), _named(step)), F.lit(0))
    return pair["x"], pair["y"]


def _named(step: Transform) -> Callable[[Column], Column]:
    def f(q: Column) -> Column:
        x, y = step((q["x"], q["y"]))
        return F.struct(x.alias("x"), y.alias("y"))

    return f


def image_to_panorama(p: Point, image: dict[str, Column], hfov: float, width: float, kind: int = 4) -> Point:
    """A point of an image (pixels from its centre) in the panorama (pixels from its centre). image: its projection, hfov, width,
    yaw, pitch, roll, as Columns, so each row may have another image; null for unknown projections."""
    d = _distance(image["projection"], image["hfov"], image["width"])
    to = _distance(F.lit(kind), F.lit(float(hfov)), F.lit(float(width)))
    return bound(
        p, lambda q: _of_kind(image["projection"], TO_ERECT, d, q), lambda q: (q[0] / d * to, q[1] / d * to),
        lambda q: _along(image["yaw"], image["pitch"], image["roll"], q, to, False), FROM_ERECT[kind](to),
    )


def panorama_to_image(p: Point, image: dict[str, Column], hfov: float, width: float, kind: int = 4) -> Point:
    """The inverse of :func:`image_to_panorama`."""
    d = _distance(image["projection"], image["hfov"], image["width"])
    to = _distance(F.lit(kind), F.lit(float(hfov)), F.lit(float(width)))
    return bound(
        p, TO_ERECT[kind](to), lambda q: _along(image["yaw"], image["pitch"], image["roll"], q, to, True),
        lambda q: (q[0] / to * d, q[1] / to * d), lambda q: _of_kind(image["projection"], FROM_ERECT, d, q),
    )


def with_image_places(df: DataFrame, x: str, y: str, image: dict[str, Column], hfov: float, width: float, kind: int = 4) -> DataFrame:
    """df with columns x and y, a point of the panorama, as :func:`panorama_to_image` gives it. Each step's numbers are columns, which Spark computes once a row by
    compiled code; functions nested in an expression are interpreted, and once for each use of their result."""
    d = _distance(image["projection"], image["hfov"], image["width"])
    to = _distance(F.lit(kind), F.lit(float(hfov)), F.lit(float(width)))
    x_, y_, z_ = f"_{x}_x", f"_{x}_y", f"_{x}_z"
    u, v, w = F.col(x_), F.col(y_), F.col(z_)
    turn = lambda angle, p, q: (p * F.cos(angle) - q * F.sin(angle), p * F.sin(angle) + q * F.cos(angle))
    here = TO_ERECT[kind](to)((F.col(x), F.col(y)))
    df = df.withColumns({x_: here[0] / to, y_: here[1] / to})
    df = df.withColumns({x_: F.sin(u) * F.cos(v), y_: F.sin(v), z_: F.cos(u) * F.cos(v)})
    for c, (one, other) in (("yaw", (z_, x_)), ("pitch", (y_, z_)), ("roll", (x_, y_))):
        df = df.withColumns(dict(zip((one, other), turn(-F.radians(image[c]), F.col(one), F.col(other)), strict=True)))
    df = df.withColumns({x_: to * F.atan2(u, w), y_: to * F.atan2(v, F.sqrt(u * u + w * w))}).withColumns({x_: u / to * d, y_: v / to * d})
    return df.withColumns(dict(zip((x, y), _of_kind(image["projection"], FROM_ERECT, d, (u, v)), strict=True))).drop(x_, y_, z_)


def homography(h: tuple[float, ...]) -> Transform:
    """Nine coefficients, by rows; null where the point goes to infinity."""

    def step(p: Point) -> Point:
        w = F.nullif(h[6] * p[0] + h[7] * p[1] + h[8], F.lit(0.0))
        return (h[0] * p[0] + h[1] * p[1] + h[2]) / w, (h[3] * p[0] + h[4] * p[1] + h[5]) / w

    return step


def rotation(yaw: float, pitch: float, roll: float) -> list[list[float]]:
    """Rotation matrix of yaw, pitch and roll in degrees (about z, y, x, in turn)."""
    y, p, r = (math.radians(a) for a in (yaw, pitch, roll))
    rz = [[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]]
    ry = [[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]]
    rx = [[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]]
    times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return times(times(rz, ry), rx)


def turned_angles(yaw: Column, pitch: Column, roll: Column, by: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll (degrees) after a turn of the whole panorama by other angles: the product of both rotations, taken apart."""
    m = rotation(*by)
    y, p, r = F.radians(yaw), F.radians(pitch), F.radians(roll)
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    own = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    both = [[m[i][0] * own[0][k] + m[i][1] * own[1][k] + m[i][2] * own[2][k] for k in range(3)] for i in range(3)]
    lean = F.greatest(F.least(-both[2][0], F.lit(1.0)), F.lit(-1.0))
    return F.degrees(F.atan2(both[1][0], both[0][0])), F.degrees(F.asin(lean)), F.degrees(F.atan2(both[2][1], both[2][2]))


def in_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    """Strictly inside."""
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) < r * r


def in_rectangle(x: Column, y: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Right and bottom excluded."""
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]], inverted: bool = False) -> Column:
    """Winding number of the polygon about the point isn't 0 (is 0 if inverted). Under three corners hold nothing."""
    if len(corners) < 3:
        return F.lit(False)
    winding = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        side = (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)
        if y0 <= y1:
            winding = winding + F.when((y >= y0) & (y < y1) & (side > 0), 1).otherwise(0)
        else:
            winding = winding - F.when((y < y0) & (y >= y1) & (side < 0), 1).otherwise(0)
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return ~(box & (winding != 0)) if inverted else box & (winding != 0)
