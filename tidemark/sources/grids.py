"""Gridded files and tables of pixels: binary grids, windows, tiles, mosaics, nearest cells and block means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """A grid of cell centres: the first one's place, the step, and how many rows (northward) and columns."""

    south: float
    west: float
    step: float
    rows: int
    columns: int

    def nearest(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Row and column of the nearest centre, null where a point is over half a step outside."""
        row, column = F.floor((lat - self.south) / self.step + 0.5), F.floor((lon - self.west) / self.step + 0.5)
        return F.when(row.between(0, self.rows - 1), row.cast("int")), F.when(column.between(0, self.columns - 1), column.cast("int"))


def binary_grids(spark: SparkSession, path: str, layout: Layout, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, kind: str = "<f4") -> DataFrame:
    """Files of one grid a day, row by row -> ``(path, day, row, col, value)``, negative values null.

    A file is one task's work and must hold whole days, else reading it fails; of a day only the rows and columns asked
    for (first and last) become rows of the table.
    """
    size = layout.rows * layout.columns
    r0, r1 = rows or (0, layout.rows - 1)
    c0, c1 = columns or (0, layout.columns - 1)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, data = batch.column(0)[at].as_py(), np.frombuffer(batch.column(1)[at].as_py(), kind)
                if len(data) % size:
                    raise ValueError(f"{name} holds {len(data)} values, not whole days of {size}")
                cube = data.reshape(-1, layout.rows, layout.columns)[:, r0 : r1 + 1, c0 : c1 + 1]
                r, c = (x.ravel() for x in np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij"))
                for day, values in enumerate(cube):  # a day at a time bounds what is held beside the file
                    flat = values.ravel().astype(float)
                    columns_ = [pa.array([name] * len(flat)), pa.array(np.full(len(flat), day, np.int32)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns_, pa.array(flat, mask=~(flat >= 0))], names=["path", "day", "row", "col", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, day int, row int, col int, value double")


def block_mean(cells: DataFrame, points: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """``points(keys..., row, col)`` against ``cells(row, col, value)`` -> keys with the value at the point and the mean of
    the block of cells within ``reach``; null and negative values count as missing.

    Each point asks for its block's cells, so the join is on row and column alone.
    """
    ask = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])).alias("d")
    asked = points.select(*keys, F.col("row"), F.col("col"), ask).select(*keys, (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"), ((F.col("d.dr") == 0) & (F.col("d.dc") == 0)).alias("own"))
    value = F.when(F.col("value") >= 0, F.col("value"))
    met = asked.join(cells.select("row", "col", value.alias("value")), ["row", "col"], "left")
    return met.groupBy(*keys).agg(F.max(F.when(F.col("own"), F.col("value"))).alias("at"), F.avg("value").alias("around"), F.count("value").alias("cells"))


def window(left: Column, top: Column, right: Column, bottom: Column, step: Column, gl: Column, gt: Column, width: Column, height: Column) -> list[Column]:
    """First and last + 1 column and row of a grid's pixels that lie wholly inside a source's bounds; null for none."""
    l, r = F.greatest(left, gl), F.least(right, gl + width * step)
    t, b = F.least(top, gt), F.greatest(bottom, gt - height * step)
    c0, c1 = F.ceil((l - gl) / step - 1e-6), F.floor((r - gl) / step + 1e-6)
    r0, r1 = F.ceil((gt - t) / step - 1e-6), F.floor((gt - b) / step + 1e-6)
    some = (r > l) & (t > b) & (c1 > c0) & (r1 > r0)
    return [F.when(some, x) for x in (c0, c1, r0, r1)]


def tiles(west: Column, south: Column, east: Column, north: Column, side: int = 2) -> Column:
    """Corners of the tiles of ``side`` degrees that cover a box, as an array of (lon, lat)."""
    steps = lambda a, b: F.sequence((F.floor(a / side) * side).cast("int"), (F.floor(b / side) * side).cast("int"), F.lit(side))
    return F.flatten(F.transform(steps(west, east), lambda x: F.transform(steps(south, north), lambda y: F.struct(x.alias("lon"), y.alias("lat")))))


def mosaic_first(pixels: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """Of each pixel the first value that is not null, by the order of the items it comes from."""
    return pixels.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def mosaic_largest(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of each pixel the largest value of the tiles that overlap there, 0 where none has one."""
    return pixels.groupBy(*keys).agg(F.coalesce(F.max(value), F.lit(0)).alias(value))


def blocks(width: Column, height: Column, most: int = 4000) -> Column:
    """The blocks of ``most`` pixels a side at most that a raster is read in, as an array of (col, row, width, height)."""
    starts = lambda n: F.sequence(F.lit(0), (F.greatest(n, F.lit(1)) - 1).cast("int"), F.lit(most))
    part = lambda n, at: F.least(n - at, F.lit(most)).cast("int")
    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("col"), y.alias("row"), part(width, x).alias("width"), part(height, y).alias("height")))))
