"""Formulas as Column expressions: indices, radar, runoff, gauging, tail probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the complementary error function's Chebyshev form, constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x, moved into [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where that is not finite."""
    return F.try_divide(a - b, a + b)


def reflectance(dn: Column, offset: Column) -> Column:
    """Digital numbers to reflectance: 0 is no data; with an offset the darkest is 0."""
    return F.when(dn != 0, F.when(offset < 0, F.greatest(dn, F.lit(1000)) - 1000).otherwise(dn) / 10000.0)


def decibels(linear: Column) -> Column:
    """10 log10, null for what is not positive."""
    return F.when(linear > 0, 10 * F.log10(linear))


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0, relative error about 1e-7."""
    t = 1 / (1 + z / 2)
    inner = reduce(lambda acc, c: acc * t + c, reversed(ERFC[:-1]), F.lit(ERFC[-1]))
    return t * F.exp(-z * z + inner)


def curve_number(cn: Column, condition: str) -> Column:
    """A curve number for dry (I) or wet (III) soil from that for average soil."""
    return 4.2 * cn / (10 - 0.058 * cn) if condition == "dry" else 23 * cn / (10 + 0.13 * cn)


def direct_runoff(rain: Column, cn: Column) -> Column:
    """Curve-number runoff of a day, in mm."""
    s = 25400 / cn - 254
    return F.when(rain > 0.2 * s, F.pow(rain - 0.2 * s, 2) / (rain + 0.8 * s)).otherwise(0.0)


def budyko(rain: Column, demand: Column) -> Column:
    """Long-term runoff from rain and evaporative demand."""
    x = demand / rain
    return rain * (1 - F.sqrt(x * F.tanh(1 / x) * (1 - F.exp(-x))))


def manning(width: Column, depth: Column, side: float, slope: float, rough: float) -> tuple[Column, Column]:
    """Velocity and discharge of a trapezoidal channel."""
    area = (width + side * depth) * depth
    radius = area / (width + 2 * depth * (1 + side * side) ** 0.5)
    velocity = F.pow(radius, 2.0 / 3.0) * slope**0.5 / rough
    return velocity, area * velocity


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    t = clamp(F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0)))
    return F.sqrt(F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a polygon whose ring is given once, unclosed."""
    n = F.size(xs)
    at = F.sequence(F.lit(1), n)
    nxt = lambda i: F.when(i == n, 1).otherwise(i + 1)
    cross = lambda s, i: s + F.element_at(xs, i) * F.element_at(ys, nxt(i)) - F.element_at(xs, nxt(i)) * F.element_at(ys, i)
    return F.abs(F.aggregate(at, F.lit(0.0), cross)) / 2


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon, whose ring is an array of (x, y) given once: a ray to the right crosses it
    an odd number of times."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, F.when(i > n, 1).otherwise(i))

    def crosses(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        meets = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.coalesce(((y < a["y"]) != (y < b["y"])) & (x < meets), F.lit(False))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda s, i: s != crosses(i))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance along a sphere of the earth's mean radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), half)))
