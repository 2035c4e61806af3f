"""Rasters onto other grids: many scenes at a time, each with a grid of its own, as tables of pixels.

A grid is a row ``(keys..., left, top, step, columns, rows)``: its upper left corner, the side of its square pixels and how
many there are. Pixels are rows ``(keys..., row, col, value)`` with row 0 on top; a null value is no data, as is a pixel
that has no row. The pixels of a target grid are made where they are used and ask for the source's by place, so that
nothing meets but by equal keys, row and column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G

GRID = ("left", "top", "step", "columns", "rows")


@dataclass(frozen=True)
class Projection:
    """A plane's coordinates from longitude and latitude in degrees, and back."""

    forward: Callable[[Column, Column], tuple[Column, Column]]
    backward: Callable[[Column, Column], tuple[Column, Column]]


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator: metres on a sphere of the ellipsoid's greater radius; null at the poles and beyond."""
    y = F.when(F.abs(lat) < 90, G.A * F.asinh(F.tan(F.radians(lat))))
    return G.A * F.radians(lon), y


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in Web Mercator."""
    return F.degrees(x / G.A), F.degrees(F.atan(F.sinh(y / G.A)))


DEGREES = Projection(lambda x, y: (x, y), lambda x, y: (x, y))
MERCATOR = Projection(to_mercator, from_mercator)


def utm(zone: int) -> Projection:
    """A northern UTM zone."""
    return Projection(partial(G.to_utm, zone=zone), partial(G.from_utm, zone=zone))


def centres(grids: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., row, col, x, y)``, with other columns of the grids: the centres of every pixel of every grid; none of a grid
    without a side or a place.

    A grid's rows are dealt out over the tasks before their columns are made, so a large grid is no one task's work.
    """
    more = [c for c in grids.columns if c not in keys and c not in GRID]
    real = grids.where((F.col("columns") > 0) & (F.col("rows") > 0) & (F.col("step") > 0) & F.col("left").isNotNull() & F.col("top").isNotNull())
    lines = real.select(*keys, *GRID, *more, F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("row"))
    lines = lines.repartition(*keys, "row")
    each = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("columns").cast("int") - 1)).alias("col"))
    x, y = F.col("left") + (F.col("col") + 0.5) * F.col("step"), F.col("top") - (F.col("row") + 0.5) * F.col("step")
    return each.select(*keys, "row", "col", x.alias("x"), y.alias("y"), *more)


def places(targets: DataFrame, sources: DataFrame, keys: list[str], to: Projection | None = None, of: Projection | None = None) -> DataFrame:
    """``(keys..., row, col, u, v)``: every target pixel's centre in columns and rows of the source grid of the same keys, null
    outside it or without such a grid; a key has one source grid. ``to`` is the target's projection, ``of`` the source's; none for the same."""
    of_source = [f"s_{c}" for c in GRID]
    s = sources.select(*keys, *[F.col(c).alias(n) for c, n in zip(GRID, of_source)])
    p = centres(targets.select(*keys, *GRID).join(s, keys, "left"), keys)  # grids meet before they are taken apart
    if to is not None and of is not None:
        lon, lat = to.backward(F.col("x"), F.col("y"))
        p = p.select(*keys, "row", "col", lon.alias("x"), lat.alias("y"), *of_source)
        x, y = of.forward(F.col("x"), F.col("y"))
        p = p.select(*keys, "row", "col", x.alias("x"), y.alias("y"), *of_source)
    u, v = (F.col("x") - F.col("s_left")) / F.col("s_step"), (F.col("s_top") - F.col("y")) / F.col("s_step")
    p = p.select(*keys, "row", "col", u.alias("u"), v.alias("v"), "s_columns", "s_rows")
    within = (F.col("u") >= 0) & (F.col("u") < F.col("s_columns")) & (F.col("v") >= 0) & (F.col("v") < F.col("s_rows"))
    return p.select(*keys, "row", "col", F.when(within, F.col("u")).alias("u"), F.when(within, F.col("v")).alias("v"))


def nearest(asked: DataFrame, pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of ``places`` -> ``(keys..., row, col, values...)``, from the source pixel that a centre lies in; null outside.

    Places outside their source ask for rows above it, which no source has, each for its own: they meet nothing and share no key.
    """
    s_row = F.coalesce(F.floor("v").cast("int"), -1 - F.col("row")).alias("s_row")
    asks = asked.select(*keys, "row", "col", s_row, F.coalesce(F.floor("u").cast("int"), "col").alias("s_col"))
    have = pixels.where("row >= 0").select(*keys, F.col("row").alias("s_row"), F.col("col").alias("s_col"), *values)
    return asks.join(have, [*keys, "s_row", "s_col"], "left").select(*keys, "row", "col", *values)


def bilinear(asked: DataFrame, pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of ``places`` -> ``(keys..., row, col, values...)``: the four source pixels around a centre by nearness, weights shared
    among those that have data; null outside, or where none of the four has.

    The kernel is one source pixel wide whatever the target's step: for much coarser targets ``pooled`` is meant.
    """
    c, r = F.floor(F.col("u") - 0.5), F.floor(F.col("v") - 0.5)
    a, b = F.col("u") - 0.5 - c, F.col("v") - 0.5 - r
    four = [F.struct((r + j).cast("int").alias("r"), (c + i).cast("int").alias("c"), ((a if i else 1 - a) * (b if j else 1 - b)).alias("w")) for j in (0, 1) for i in (0, 1)]
    near = asked.select(*keys, "row", "col", F.explode(F.when(F.col("u").isNotNull(), F.array(*four)).otherwise(F.array(F.lit(None)))).alias("n"))
    near = near.select(*keys, "row", "col", F.col("n.r").alias("s_row"), F.col("n.c").alias("s_col"), F.col("n.w").alias("w")).where("w is null or w > 0")
    have = pixels.select(*keys, F.col("row").alias("s_row"), F.col("col").alias("s_col"), *values)
    met = near.join(have, [*keys, "s_row", "s_col"], "left")
    share = [F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v) for v in values]
    return met.groupBy(*keys, "row", "col").agg(*share)


def pooled(pixels: DataFrame, sources: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Onto coarser grids of the same projection -> ``(keys..., row, col, mean, mode, n)`` over the source pixels whose
    centres lie in a target pixel; the mode's ties go to the smaller value. Target pixels without data have no row.

    Tasks count their own values first, so an area of one value is a row a task.
    """
    s = sources.select(*keys, *[F.col(c).alias(f"s_{c}") for c in GRID])
    t = targets.select(*keys, *[F.col(c).alias(f"t_{c}") for c in GRID])
    p = pixels.where(F.col(value).isNotNull()).join(s.join(t, keys), keys)
    x, y = F.col("s_left") + (F.col("col") + 0.5) * F.col("s_step"), F.col("s_top") - (F.col("row") + 0.5) * F.col("s_step")
    col, row = F.floor((x - F.col("t_left")) / F.col("t_step")), F.floor((F.col("t_top") - y) / F.col("t_step"))
    p = p.select(*keys, row.cast("int").alias("row"), col.cast("int").alias("col"), value, "t_columns", "t_rows")
    p = p.where((F.col("row") >= 0) & (F.col("row") < F.col("t_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("t_columns")))
    counts = p.groupBy(*keys, "row", "col", value).agg(F.count("*").alias("k"))
    mean = (F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("mean")
    mode = F.max_by(F.col(value), F.struct("k", -F.col(value))).alias("mode")
    return counts.groupBy(*keys, "row", "col").agg(mean, mode, F.sum("k").alias("n"))


def suggested(grids: DataFrame, keys: list[str], of: Projection, to: Projection) -> DataFrame:
    """For each grid one in another projection, ``(keys..., left, top, step, columns, rows)``: it covers the grid's edges,
    of which corners and 21 points a side are taken, and its diagonal has as many pixels as the grid's.
    """
    right, bottom = F.col("left") + F.col("columns") * F.col("step"), F.col("top") - F.col("rows") * F.col("step")
    edges = grids.select(*keys, *GRID, F.posexplode(G.edge_points(F.col("left"), bottom, right, F.col("top"))).alias("i", "p"))
    lon, lat = of.backward(F.col("p.x"), F.col("p.y"))
    edges = edges.select(*keys, "columns", "rows", "i", lon.alias("lon"), lat.alias("lat"))
    x, y = to.forward(F.col("lon"), F.col("lat"))
    edges = edges.select(*keys, "columns", "rows", "i", x.alias("x"), y.alias("y"))
    corner = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    first, last = 23, 22  # the upper left corner begins the second side of edge_points, the lower right one ends the first
    across = F.hypot(corner(last, "x") - corner(first, "x"), corner(last, "y") - corner(first, "y"))
    b = edges.groupBy(*keys, "columns", "rows").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.max("y").alias("top"), across.alias("across"))
    b = b.withColumn("step", F.col("across") / F.sqrt(F.col("columns") * F.col("columns") + F.col("rows") * F.col("rows")))
    size = lambda a, z: F.greatest(F.floor((F.col(z) - F.col(a)) / F.col("step") + 0.5), F.lit(1)).cast("int")
    return b.select(*keys, "left", "top", "step", size("left", "right").alias("columns"), size("bottom", "top").alias("rows"))


def colour(value: Column, low: float, high: float, colours: list[str]) -> Column:
    """a struct (r, g, b, a) on a ramp of colours ``#rrggbb`` evenly spaced from ``low`` to ``high``; values beyond take the
    end's colour, null and non-finite ones are transparent in the first one's."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    at = F.least(F.greatest((F.when(finite, value).otherwise(F.lit(low)) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (len(colours) - 1)
    step = F.least(F.floor(at), F.lit(len(colours) - 2)).cast("int")
    parts = []
    for name, k in (("r", 1), ("g", 3), ("b", 5)):
        ramp = F.array(*[F.lit(float(int(c[k : k + 2], 16))) for c in colours])
        a, b = F.get(ramp, step), F.get(ramp, step + 1)
        parts.append(F.bround(a + (b - a) * (at - step)).cast("int").alias(name))
    return F.struct(*parts, F.when(finite, 255).otherwise(0).alias("a"))
