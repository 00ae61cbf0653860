"""Geometry as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = ("min_x", "min_y", "min_z"), ("max_x", "max_y", "max_z")
BOX = LOW + HIGH
CORNERS = (("ax", "ay", "az"), ("bx", "b_y", "bz"), ("cx", "cy", "cz"))
Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def corners() -> tuple[Vec, Vec, Vec]:
    return tuple(vec(*c) for c in CORNERS)


def low(prefix: str = "") -> Vec:
    return vec(*[prefix + n for n in LOW])


def high(prefix: str = "") -> Vec:
    return vec(*[prefix + n for n in HIGH])


def center(lo: Vec, hi: Vec) -> Vec:
    return tuple((b + a) / 2 for a, b in zip(lo, hi, strict=True))


def overlap(a: str = "", b: str = "") -> Column:
    """Closed box overlap of the columns with two prefixes: touching counts."""
    terms = [(F.col(f"{a}min_{x}") <= F.col(f"{b}max_{x}")) & (F.col(f"{a}max_{x}") >= F.col(f"{b}min_{x}")) for x in "xyz"]
    return terms[0] & terms[1] & terms[2]


def overlap_values(scene: tuple[float, ...]) -> Column:
    terms = [(F.col(f"min_{x}") <= scene[i + 3]) & (F.col(f"max_{x}") >= scene[i]) for i, x in enumerate("xyz")]
    return terms[0] & terms[1] & terms[2]


def longest_axis(size: Vec) -> Column:
    """0 if x is strictly longest, else 1 if y is strictly longer than z, else 2: ties go to the later axis."""
    x, y, z = size
    return F.when((x > y) & (x > z), 0).when(y > z, 1).otherwise(2)


def triangle_bounds() -> tuple[Vec, Vec]:
    a, b, c = corners()
    return tuple(F.least(*v) for v in zip(a, b, c, strict=True)), tuple(F.greatest(*v) for v in zip(a, b, c, strict=True))


def triangle_cross() -> Vec:
    a, b, c = corners()
    return cross(sub(b, a), sub(c, a))


def length(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def surface(size: Vec) -> Column:
    """Surface area of a box of a size: the agglomeration distance of two boxes is that of their union."""
    x, y, z = size
    return 2.0 * x * y + 2.0 * z * y + 2.0 * x * z


def spread_bits(v: Column) -> Column:
    """Ten bits to every third bit, in 64-bit arithmetic masked to 32 bits."""
    # The multipliers and masks of the published 30-bit Morton construction.
    for factor, mask in ((65537, 4278190335), (257, 251719695), (17, 3272356035), (5, 1227133513)):
        v = (v * factor).bitwiseAND(F.lit(4294967295)).bitwiseAND(F.lit(mask))
    return v


def morton(point: Vec, lo: Vec, hi: Vec) -> Column:
    """30-bit Morton code of a point in a box; coordinates are clamped to 0 .. 1023, flat axes count as 0."""
    parts = []
    for p, a, b in zip(point, lo, hi, strict=True):
        unit = F.coalesce((p - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0))
        parts.append(spread_bits(F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(unit * 1024))).cast("long")))
    return parts[0] * 4 + parts[1] * 2 + parts[2]


def slab(origin: Vec, direction: Vec, lo: Vec, hi: Vec) -> tuple[Column, Column, Column]:
    """(t_near, t_far, inside): a zero direction component bounds nothing, and misses if the origin is outside its slab."""
    near, far, inside = [], [], []
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        safe = F.nullif(d, F.lit(0.0))
        t0, t1 = (a - o) / safe, (b - o) / safe
        near.append(F.coalesce(F.least(t0, t1), F.lit(-1e300)))
        far.append(F.coalesce(F.greatest(t0, t1), F.lit(1e300)))
        inside.append((d != 0) | ((a <= o) & (o <= b)))
    return F.greatest(*near), F.least(*far), reduce(lambda a, b: a & b, inside)
