"""Sampling, duration text, timing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(id_: Column, salt: int) -> Column:
    """A repeatable number in [0, 1) from an integer id."""
    return ((id_ * 7919 + salt * 104729 + 12345) % 65537) / F.lit(65537.0)


def hemisphere(points: DataFrame, key: str, normal: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Unit vectors uniform on the hemisphere about a normal, by inversion; the sign follows the normal."""
    u, v = uniform(F.col(key), 1), uniform(F.col(key), 2)
    z = 1 - 2 * u
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    p = (r * F.cos(2 * math.pi * v), r * F.sin(2 * math.pi * v), z)
    side = p[0] * normal[0] + p[1] * normal[1] + p[2] * normal[2]
    flip = F.when(side < 0, -1.0).otherwise(1.0)
    return points.select(key, *[F.round(c * flip, 6).alias(n) for n, c in zip("xyz", p, strict=True)])


def cosine_hemisphere(points: DataFrame, key: str) -> DataFrame:
    r1, r2 = uniform(F.col(key), 1), uniform(F.col(key), 2)
    phi, r = 2 * math.pi * r1, F.sqrt(r2)
    return points.select(key, (F.cos(phi) * r).alias("x"), (F.sin(phi) * r).alias("y"), F.sqrt(1 - r2).alias("z"))


def unit_disk(points: DataFrame, key: str) -> DataFrame:
    phi, r = 2 * math.pi * uniform(F.col(key), 1), F.sqrt(uniform(F.col(key), 2))
    return points.select(key, (F.cos(phi) * r).alias("x"), (F.sin(phi) * r).alias("y"))


def to_sphere(points: DataFrame, key: str, radius: float, distance_squared: float) -> DataFrame:
    """Directions, about +z, to a sphere of a radius at a distance."""
    r1, r2 = uniform(F.col(key), 1), uniform(F.col(key), 2)
    z = 1 + r2 * (math.sqrt(1 - radius * radius / distance_squared) - 1)
    s = F.sqrt(1 - z * z)
    return points.select(key, (F.cos(2 * math.pi * r1) * s).alias("x"), (F.sin(2 * math.pi * r1) * s).alias("y"), z.alias("z"))


#: Rounds of drawing at most: each leaves out under half of what is left, so that one point in 10^20 would be left.
DRAWS = 64


def _rejected(points: DataFrame, key: str, names: str) -> DataFrame:
    """key, the accepted point of the square or cube (-1, 1) that lies strictly inside the unit ball, and its round.

    Draws count up from 0 with salts of their own and need no state: the first that is accepted is the row's point.
    """
    axes = len(names)

    def draw(i: Column) -> Column:
        at = [((F.col(key) * 7919 + (i * axes + a + 1) * 104729 + 12345) % 65537) / F.lit(65537.0) * 2 - 1 for a in range(axes)]
        return F.struct(*[c.alias(n) for n, c in zip(names, at, strict=True)], i.cast("int").alias("round"))

    def inside(p: Column) -> Column:
        return sum((p[n] * p[n] for n in names[1:]), p[names[0]] * p[names[0]]) < 1

    # A fold that stops drawing once a point is accepted.
    none = F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in names) + ",round:int>")
    found = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long")), none, lambda kept, i: F.when(kept.isNotNull(), kept).otherwise(F.when(inside(draw(i)), draw(i))))
    return points.select(key, found.alias("p")).select(key, *[F.col(f"p.{n}").alias(n) for n in names], "p.round")


def disk_by_rejection(points: DataFrame, key: str) -> DataFrame:
    return _rejected(points, key, "xy")


def sphere_by_rejection(points: DataFrame, key: str) -> DataFrame:
    return _rejected(points, key, "xyz")


def uniform_range(id_: Column, salt: int, low: float, high: float) -> Column:
    return F.lit(float(low)) + (high - low) * uniform(id_, salt)


def uniform_int(id_: Column, salt: int, low: int, high: int) -> Column:
    """A whole number from low up to, not including, high; fractions are cut off towards zero."""
    return uniform_range(id_, salt, low, high).cast("int")


def noise(points: DataFrame, key: str) -> DataFrame:
    """A colour and a whole number of each row, from salts of their own."""
    return points.select(key, *[uniform_range(F.col(key), i, 0.25, 0.75).alias(c) for i, c in enumerate("rgb", 1)], uniform_int(F.col(key), 4, -5, 6).alias("n"))


def format_duration(nanos: Column) -> Column:
    """Picoseconds whole, up to seconds with three decimals (31ps, 4.200us), then 1:02.003, 4:00:09 and 3 days, 4:00:09. Not positive: null."""
    whole = nanos.cast("double")

    def part(unit: float, size: float) -> Column:
        return F.floor(F.pmod(whole / unit, F.lit(size))).cast("int")

    ps, ns, us, ms = part(0.001, 1000.0), part(1.0, 1000.0), part(1e3, 1000.0), part(1e6, 1000.0)
    s, m, h, d = part(1e9, 60.0), part(6e10, 60.0), part(3.6e12, 24.0), F.floor(whole / 8.64e13).cast("int")
    days = F.when(d > 0, F.concat(d.cast("string"), F.lit(" days, "))).otherwise("")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    def three(c):
        return F.lpad(c.cast("string"), 3, "0")

    def unit(a, b, name):
        return F.concat(a.cast("string"), F.lit("."), three(b), F.lit(name))

    rest = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s)))
        .when(m > 0, F.concat(m.cast("string"), F.lit(":"), two(s), F.lit("."), three(ms)))
        .when(s > 0, unit(s, ms, "s"))
        .when(ms > 0, unit(ms, us, "ms"))
        .when(us > 0, unit(us, ns, "us"))
        .when(ns > 0, unit(ns, ps, "ns"))
        .otherwise(F.concat(ps.cast("string"), F.lit("ps")))
    )
    return F.when(whole > 0, F.concat(days, rest))
