"""The WGS84 ellipsoid in Column expressions: UTM both ways, geodesic lengths, areas, lines clipped to circles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE, EASTING = 0.9996, 500000.0

B = A * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)

# Series of the transverse Mercator projection in the third flattening, to its fourth power.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACKWARD = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _multiples(c: Column) -> tuple[list[Column], list[Column]]:
    """For c the cosine of an angle: the cosines of 1 to 4 times it, and the sines of those as multiples of its own sine.
    The same polynomials hold for hyperbolic cosine and sine."""
    square = c * c
    return [c, 2 * square - 1, c * (4 * square - 3), 8 * square * (square - 1) + 1], [F.lit(1.0), 2 * c, 4 * square - 1, 4 * c * (2 * square - 1)]


def _sum(factors: tuple[float, ...], left: list[Column], right: list[Column]) -> Column:
    return sum((f * a * b for f, a, b in zip(factors[1:], left[1:], right[1:])), factors[0] * left[0] * right[0])


def _twofold(factors: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """The sums of factor j times cos(2jx) sinh(2jy), and times sin(2jx) cosh(2jy)."""
    (cosines, sines), (wide, high) = _multiples(F.cos(2 * x)), _multiples(F.cosh(2 * y))
    return F.sinh(2 * y) * _sum(factors, cosines, high), F.sin(2 * x) * _sum(factors, sines, wide)


def central(zone: int) -> float:
    """The central meridian of a UTM zone, in degrees."""
    return 6.0 * zone - 183.0


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres of a northern UTM zone; southern latitudes get negative northings.

    Good to less than a millimetre within some ten degrees of the zone's meridian. Meant for plain projections, where code
    is generated and works out once what the terms share; in lambda functions every term is worked out anew.
    """
    s, across = F.sin(F.radians(lat)), F.radians(lon - central(zone))
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    x, y = F.atan2(t, F.cos(across)), F.atanh(F.sin(across) / F.sqrt(1 + t * t))
    east, north = _twofold(FORWARD, x, y)
    return EASTING + SCALE * RECTIFYING * (y + east), SCALE * RECTIFYING * (x + north)


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; in plain projections, as ``to_utm``."""
    x, y = north / (SCALE * RECTIFYING), (east - EASTING) / (SCALE * RECTIFYING)
    across, along = _twofold(BACKWARD, x, y)
    x1, y1 = x - along, y - across
    c = F.asin(F.sin(x1) / F.cosh(y1))
    lat = c + F.sin(2 * c) * _sum(LATITUDE, _multiples(F.cos(2 * c))[1], [F.lit(1.0)] * len(LATITUDE))
    return central(zone) + F.degrees(F.atan2(F.sinh(y1), F.cos(x1))), F.degrees(lat)


def edge_points(left: Column, bottom: Column, right: Column, top: Column, added: int = 21) -> Column:
    """Corners of a box and ``added`` points along each side, as an array of (x, y)."""
    shares = F.transform(F.sequence(F.lit(0), F.lit(added + 1)), lambda i: i / float(added + 1))
    sides = [
        F.transform(shares, lambda t: _pair(left + t * (right - left), bottom)),
        F.transform(shares, lambda t: _pair(left + t * (right - left), top)),
        F.transform(shares, lambda t: _pair(left, bottom + t * (top - bottom))),
        F.transform(shares, lambda t: _pair(right, bottom + t * (top - bottom))),
    ]
    return F.concat(*sides)


def bounds(boxes: DataFrame, keys: list[str], points: Column, to: Callable, zone: int, names: tuple[str, str, str, str]) -> DataFrame:
    """The ``keys`` of boxes with the left, bottom, right and top of their points after ``to_utm`` or ``from_utm``, as ``names``.

    Points become rows, so that compiled code projects them; each task folds its own first, and one row a box is shuffled, none
    if the boxes lie by their keys already. Boxes with equal keys are one; null points count for nothing.
    """
    each = boxes.select(*keys, F.explode(points).alias("p"))
    x, y = to(F.col("p.x"), F.col("p.y"), zone)
    each = each.select(*keys, x.alias("x"), y.alias("y"))
    return each.groupBy(*keys).agg(*[f(c).alias(n) for f, c, n in zip((F.min, F.min, F.max, F.max), "xyxy", names)])


def snapped(low: Column, high: Column, step: Column, origin: float) -> tuple[Column, Column]:
    """A range moved outward to a lattice of ``step`` through ``origin``."""
    return F.floor((low - origin) / step) * step + origin, F.ceil((high - origin) / step) * step + origin


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 10) -> Column:
    """Length in metres of the shortest line on the ellipsoid, by Vincenty's inverse formula with ``rounds`` rounds.

    Null for null ends, 0 for equal ones; not for ends that lie nearly opposite each other, where the rounds do not settle.
    """
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    ends = F.struct(*[f(reduced(lat)).alias(n) for lat, names in ((lat1, "sc"), (lat2, "tk")) for f, n in zip((F.sin, F.cos), names)])
    apart = F.radians(lon2 - lon1)

    def arc(e: Column, along: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of: sine s and cosine c of the arc, sine a of the azimuth at the equator, its cosine's square q, cosine m at
        the middle of the arc."""
        c = e["s"] * e["t"] + e["c"] * e["k"] * F.cos(along)
        s = F.sqrt(F.pow(e["k"] * F.sin(along), 2) + F.pow(e["c"] * e["t"] - e["s"] * e["k"] * F.cos(along), 2))
        azimuth = lambda x: F.coalesce(F.try_divide(e["c"] * e["k"] * F.sin(along), x["s"]), F.lit(0.0))
        middle = lambda x: F.coalesce(x["c"] - F.try_divide(2 * e["s"] * e["t"], 1 - x["a"] * x["a"]), F.lit(0.0))
        first = F.struct(s.alias("s"), c.alias("c"))
        second = lambda x: F.struct(x["s"].alias("s"), x["c"].alias("c"), azimuth(x).alias("a"))
        third = lambda x: F.struct(x["s"].alias("s"), x["c"].alias("c"), x["a"].alias("a"), (1 - x["a"] * x["a"]).alias("q"), middle(x).alias("m"))
        return _let(first, lambda x: _let(second(x), lambda y: _let(third(y), then)))

    def closer(e: Column, along: Column) -> Column:
        def step(x: Column) -> Column:
            factor = FLATTENING / 16 * x["q"] * (4 + FLATTENING * (4 - 3 * x["q"]))
            turn = lambda k: F.atan2(x["s"], x["c"]) + k * x["s"] * (x["m"] + k * x["c"] * (2 * x["m"] * x["m"] - 1))
            return _let(factor, lambda k: apart + (1 - k) * FLATTENING * x["a"] * turn(k))

        return arc(e, along, step)

    def length(x: Column) -> Column:
        def metres(u: Column) -> Column:
            p = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            q = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            more = lambda q: q / 4 * (x["c"] * (2 * x["m"] * x["m"] - 1) - q / 6 * x["m"] * (4 * x["s"] * x["s"] - 3) * (4 * x["m"] * x["m"] - 3))
            return _let(q, lambda q: B * p * (F.atan2(x["s"], x["c"]) - q * x["s"] * (x["m"] + more(q))))

        return _let(x["q"] * ((A * A - B * B) / (B * B)), metres)

    settled = lambda e: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), apart, lambda along, _: closer(e, along))
    whole = _let(ends, lambda e: _let(settled(e), lambda along: arc(e, along, length)))
    return F.when(apart.isNotNull() & lat1.isNotNull() & lat2.isNotNull(), whole)


def authalic(lat: Column) -> Column:
    """Area in m2 of the ellipsoid between the equator and a latitude, for each radian of longitude."""
    s = F.sin(F.radians(lat))
    return B * B / 2 * (s / (1 - E2 * s * s) + F.atanh(E * s) / E)


def under_edge(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, right: Column, bottom: Column, top: Column) -> Column:
    """Signed area inside a box below an edge: the sum over a polygon's edges, in order, is the area it shares with the box.

    Within the box the edge's height is moved into [bottom, top]; the integral of that is a difference of squares.
    """
    u1, u2 = F.least(F.greatest(x1, left), right), F.least(F.greatest(x2, left), right)
    slope = F.coalesce(F.try_divide(y2 - y1, x2 - x1), F.lit(0.0))
    v1, v2 = y1 + (u1 - x1) * slope, y1 + (u2 - x1) * slope
    clamp = lambda v: F.least(F.greatest(v, bottom), top)
    whole = lambda v: F.pow(clamp(v) - bottom, 2) / 2 + (top - bottom) * F.greatest(v - top, F.lit(0.0))
    flat = F.abs(v2 - v1) <= 1e-12 * (top - bottom)
    mean = F.when(flat, clamp(v1) - bottom).otherwise((whole(v2) - whole(v1)) / F.nullif(v2 - v1, F.lit(0.0)))
    return (u2 - u1) * mean


def inside_circle(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, radius: Column) -> tuple[Column, Column]:
    """The shares along a segment between which it lies within a circle; null where it does not."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - cx, y1 - cy
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
    root = F.sqrt(F.when(b * b - a * c >= 0, b * b - a * c))
    t1, t2 = F.greatest(F.try_divide(-b - root, a), F.lit(0.0)), F.least(F.try_divide(-b + root, a), F.lit(1.0))
    meets = root.isNotNull() & (a > 0) & (t1 < t2)
    return F.when(meets, t1), F.when(meets, t2)
