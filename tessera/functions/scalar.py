"""Scalar functions as Columns: lens and exposure arithmetic, interpolation rules, names and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int
PI = 3.141592653589793


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once a row however often ``of`` names it; the expressions of nested functions would multiply."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def interpolate(x0: Column, y0: Column, x1: Column, y1: Column, x: Value) -> Column:
    """Line through two points at x; y0 where the points' x are within 1e-4."""
    return F.when(F.abs(x1 - x0) < 1e-4, y0).otherwise(y0 + (col(x) - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0))


def in_range(x1: Column, x2: Column, x: Value, tolerance: float) -> Column:
    """x lies between x1 and x2, or within tolerance times x of x1 (the nearer one)."""
    x = col(x)
    return (F.signum(x1 - x) * F.signum(x2 - x) <= 0) | (F.abs(x - x1) < tolerance * x)


def near_single(x1: Column, x: Value, strict: bool = False, tolerance: float = 0.075) -> Column:
    """The rule for a single row: within tolerance times x. Crop rectangles are strict, others aren't."""
    gap, most = F.abs(col(x) - x1), tolerance * col(x)
    return gap < most if strict else gap <= most


def exposure_value(time: Column, aperture: Column, iso: Column) -> Column:
    """log2(F²/(gain·t)); aperture 3.5 where it is 0, gain 1 where ISO is 0; 0 for no time."""
    f = F.when(aperture == 0, 3.5).otherwise(aperture)
    gain = F.when(iso > 0, iso / 100.0).otherwise(1.0)
    return F.when(time > 0, F.log2(f * f / (gain * F.when(time > 0, time)))).otherwise(0.0)


def huber(x: Column, sigma: float) -> Column:
    """x to sigma, then sqrt(sigma(2x - sigma))."""
    return F.when(x <= sigma, x).otherwise(F.sqrt(F.greatest(sigma * (2 * x - sigma), F.lit(0.0))))


def vignetting(r: Column, c: tuple[float, float, float, float]) -> Column:
    """c0 + c1 r² + c2 r⁴ + c3 r⁶."""
    r2 = r * r
    return c[0] + r2 * (c[1] + r2 * (c[2] + r2 * c[3]))


#: Lens projections by name.
LENSES = ("rectilinear", "cylinder", "equidistant", "equirectangular", "orthographic", "stereographic", "equisolid", "thoby")
#: Fixed values of the Thoby projection: r = THOBY_A f sin(THOBY_B angle).
THOBY_A, THOBY_B = 1.47, 0.713
#: Diagonal of the frame of 36 by 24 to which crop factors refer.
DIAGONAL = (36.0 * 36.0 + 24.0 * 24.0) ** 0.5


def sensor_width(crop: Value, width: Value, height: Value) -> Column:
    """Width of the sensor, from the crop factor and the size of the image."""
    r = col(width) / col(height)
    return DIAGONAL / col(crop) / F.sqrt(1 + 1 / (r * r))


def hfov(focal: Column, width: Value, lens: str) -> Column:
    """Horizontal field of view in degrees, from focal length and sensor width (same unit). Sines over 1 count as 1, but for
    the orthographic lens, where whole multiples count as half turns."""
    width = col(width)
    x = width / 2 / focal
    angle = {
        "rectilinear": F.atan(x) * 2,
        **dict.fromkeys(("cylinder", "equidistant", "equirectangular"), width / focal),
        "orthographic": 2 * F.asin(x - F.floor(x)) + F.floor(x) * F.lit(PI),
        "stereographic": F.atan(x / 2) * 4,
        "equisolid": 4 * F.asin(F.least(x / 2, F.lit(1.0))),
        "thoby": 2 * F.asin(F.least(x / THOBY_A, F.lit(1.0))) / THOBY_B,
    }[lens]
    return F.degrees(angle)


def focal(fov: Column, width: Value, lens: str) -> Column:
    """Focal length from the horizontal field of view in degrees."""
    a, half = F.radians(fov), col(width) / 2
    turns = F.ceil((fov - 180) / 360)
    return {
        "rectilinear": half / F.tan(a / 2),
        **dict.fromkeys(("cylinder", "equidistant", "equirectangular"), 2 * half / a),
        "orthographic": half / (2 * turns + F.pow(F.lit(-1.0), turns) * F.sin(a / 2)),
        "stereographic": half / (2 * F.tan(a / 4)),
        "equisolid": half / (2 * F.sin(a / 4)),
        "thoby": half / (THOBY_A * F.sin(a * THOBY_B / 2)),
    }[lens]


def crop_factor(fov: Column, focal: Column, width: Value, height: Value, lens: str) -> Column:
    """Crop factor from the field of view in degrees and the focal length; all lenses but the rectilinear one as of equal angles."""
    a, r = F.radians(fov), col(width) / col(height)
    x = focal * (F.tan(a / 2) if lens == "rectilinear" else a)
    return DIAGONAL / (x * F.sqrt(1 + 1 / (r * r)))


def vfov(fov: Value, width: Value, height: Value, output: str) -> Column:
    """Vertical field of view of a panorama in degrees, from its horizontal one and its size."""
    a, shape = F.radians(col(fov)), col(height) / col(width)
    return F.degrees({
        "rectilinear": 2 * F.atan(shape * F.tan(a / 2)),
        "cylinder": 2 * F.atan(shape * a / 2),
        "equirectangular": a * shape,
        "fisheye": a * shape,
        "mercator": 2 * F.atan(F.sinh(a * shape / 2)),
    }[output])


#: Widest horizontal field of view that an output projection holds.
WIDEST = {"rectilinear": 179.0, "cylinder": 360.0, "equirectangular": 360.0, "fisheye": 360.0, "mercator": 360.0}


def vfov_supported(fov: Value, output: str) -> Column:
    return (col(fov) > 0) & (col(fov) <= WIDEST[output])


def extension(path: Column) -> Column:
    """What follows the last dot of the last path part; empty without one."""
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def strip_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def path_prefix(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*[/\\])", 1)


def natural_key(name: Column) -> Column:
    """A string that sorts as names with numbers in them do: digit runs of any length by value, digits before letters."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        # a number is led by how many digits it has, so that longer ones come later
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.concat(F.lit("1"), p))

    return F.array_join(F.transform(parts, part), "\x01")


def interpolate_plane(x: Value, y: Value, *corners: tuple[Column, Column, Column]) -> Column:
    """Value at (x, y) of the plane through three points (x, y, z); the first z where they stand in a line."""
    (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = corners
    area = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    slope_x = (z2 - z1) * (y3 - y1) - (z3 - z1) * (y2 - y1)
    slope_y = (x2 - x1) * (z3 - z1) - (x3 - x1) * (z2 - z1)
    return F.when(F.abs(area) < 1e-6, z1).otherwise(z1 + ((col(x) - x1) * slope_x + (col(y) - y1) * slope_y) / F.nullif(area, F.lit(0.0)))


def lens_name(lens: Column, make: Column, model: Column) -> Column:
    """The lens, else make|model, else empty."""
    both = F.when((F.coalesce(make, F.lit("")) != "") & (F.coalesce(model, F.lit("")) != ""), F.concat_ws("|", make, model))
    return F.coalesce(F.nullif(lens, F.lit("")), both, F.lit(""))


def photo_time(text: Column) -> Column:
    """yyyy:MM:dd HH:mm:ss as a timestamp; null for anything else."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


DISTANCES = {
    "l2": lambda a, b: _fold(a, b, lambda x, y: (x - y) * (x - y)),
    "l1": lambda a, b: _fold(a, b, lambda x, y: F.abs(x - y)),
    "max": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "chi_square": lambda a, b: _fold(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / F.nullif(x + y, F.lit(0.0))).otherwise(0.0)),
    "histogram": lambda a, b: _fold(a, b, lambda x, y: F.least(x, y)),
    "minkowski3": lambda a, b: _fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(3.0))),
    "kullback": lambda a, b: _fold(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / F.nullif(y, F.lit(0.0)))).otherwise(0.0)),
    "hellinger": lambda a, b: _fold(a, b, lambda x, y: F.pow(F.sqrt(F.abs(x)) - F.sqrt(F.abs(y)), F.lit(2.0))),
}


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)


def distance(kind: str, a: Column, b: Column) -> Column:
    """Distance of two double arrays; "l2" is squared, as nearest-neighbour ratio tests take it."""
    return DISTANCES[kind](a, b)


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two whole-number arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def mask_text(poly: Column) -> Column:
    """Corners of array<struct<x, y>> as text: x y x y ..."""
    return F.array_join(F.transform(poly, lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), " ")


def white_balance(red: Value, green: Value, blue: Value) -> Column:
    """struct<red, blue>: levels over the green one; both 1 where a level is missing or 0."""
    r, g, b = col(red), col(green), col(blue)
    known = F.coalesce((r != 0) & (g != 0) & (b != 0), F.lit(False))
    g = F.nullif(g, F.lit(0))
    return F.struct(F.when(known, r / g).otherwise(1.0).alias("red"), F.when(known, b / g).otherwise(1.0).alias("blue"))


def exif_crop(pixels_x: Column, pixels_y: Column, per_unit_x: Column, per_unit_y: Column, unit: Column, width: Column, height: Column) -> Column:
    """Crop factor from the focal-plane resolution (unit 2: inch, 3: cm, 4: mm), over the sensor's pixels, or the image's size where
    these are missing; landscape; null without a resolution."""
    x, y = F.when((pixels_x > 0) & (pixels_y > 0), pixels_x).otherwise(width), F.when((pixels_x > 0) & (pixels_y > 0), pixels_y).otherwise(height)
    mm = F.when(unit == 2, 25.4).when(unit == 3, 10.0).when(unit == 4, 1.0)
    across = lambda n, per: n * mm / F.when(per > 0, per)
    w, h = across(F.greatest(x, y), per_unit_x), across(F.least(x, y), per_unit_y)
    return DIAGONAL / F.sqrt(w * w + h * h)
