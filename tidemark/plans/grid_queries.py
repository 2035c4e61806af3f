"""Queries over gridded sources: tiles, windows, mosaics, nearest cells with block means, and the scouting queue with its forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scouting
from tidemark.plans.geodesy_queries import BOX, boxes
from tidemark.plans.image_queries import nd
from tidemark.plans.registry import PIXELS, query
from tidemark.sources import grids
from tidemark.sources.roles import pixels, table


@query(
    f"""WITH b AS (SELECT c_custkey AS id, {BOX} FROM customer), x AS (SELECT *, unnest(range(CAST(floor((lon-half)/2)*2 AS BIGINT), CAST(floor((lon+half)/2)*2 AS BIGINT)+1, 2)) AS tx FROM b),
 y AS (SELECT *, unnest(range(CAST(floor((lat-half)/2)*2 AS BIGINT), CAST(floor((lat+half)/2)*2 AS BIGINT)+1, 2)) AS ty FROM x) SELECT id, CAST(tx AS INT) AS tile_lon, CAST(ty AS INT) AS tile_lat FROM y"""
)
def tile_cover(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles of two degrees that every area needs."""
    lon, lat, half = F.col("lon"), F.col("lat"), F.col("half")
    t = F.explode(grids.tiles(lon - half, lat - half, lon + half, lat + half)).alias("t")
    return boxes(spark, sf).select("id", t).select("id", F.col("t.lon").alias("tile_lon"), F.col("t.lat").alias("tile_lat"))


LAYOUT = grids.Layout(south=0.25, west=-0.5, step=1.0, rows=16, columns=32)


@query(
    """WITH p AS (SELECT c_custkey AS id, (c_custkey%41)*0.83 AS lon, (c_custkey%23)*0.77 AS lat FROM customer), n AS (SELECT id, CAST(floor((lat-0.25)/1.0+0.5) AS INT) AS r, CAST(floor((lon+0.5)/1.0+0.5) AS INT) AS c FROM p),
 q AS (SELECT * FROM n WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 31), v AS (SELECT "row" AS r, col AS c, CASE WHEN b1>=3000 THEN CAST(b1-3000 AS DOUBLE) END AS v FROM px)
 SELECT id, q.r AS grid_row, q.c AS grid_col, round(max(v) FILTER (v.r=q.r AND v.c=q.c),4) AS at, round(avg(v),4) AS around, count(v) AS cells FROM q LEFT JOIN v ON v.r BETWEEN q.r-1 AND q.r+1 AND v.c BETWEEN q.c-1 AND q.c+1 GROUP BY 1,2,3""",
    PIXELS,
)
def grid_block_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The value of the cell nearest to every place and the mean of the three by three cells around it, without missing ones."""
    k = F.col("c_custkey")
    r, c = LAYOUT.nearest((k % 41) * 0.83, (k % 23) * 0.77)
    points = table(spark, sf, "customer").select(k.alias("id"), r.alias("row"), c.alias("col")).where("row is not null and col is not null")
    points = points.withColumn("grid_row", F.col("row")).withColumn("grid_col", F.col("col"))
    cells = pixels(spark, sf).select("row", "col", (F.col("b1") - 3000.0).alias("value"))
    made = grids.block_mean(cells, points, ["id", "grid_row", "grid_col"])
    return made.select("id", "grid_row", "grid_col", F.round("at", 4).alias("at"), F.round("around", 4).alias("around"), "cells")


@query(
    """WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, 300.0*(l_partkey%50) AS sl, 9000-200.0*(l_suppkey%40) AS st, 300.0*(l_partkey%50)+100.0*l_quantity AS sr, 9000-200.0*(l_suppkey%40)-90.0*l_quantity AS sb, 400.0*(l_orderkey%20)-7 AS gl, 8000+30.0*(l_orderkey%9) AS gt FROM lineitem),
 b AS (SELECT *, greatest(sl,gl) AS l, least(sr,gl+64*30) AS r, least(st,gt) AS t, greatest(sb,gt-48*30) AS d FROM s),
 w AS (SELECT *, ceil((l-gl)/30-1e-6) AS c0, floor((r-gl)/30+1e-6) AS c1, ceil((gt-t)/30-1e-6) AS r0, floor((gt-d)/30+1e-6) AS r1 FROM b)
 SELECT o AS id, n AS part, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1 FROM w WHERE r>l AND t>d AND c1>c0 AND r1>r0"""
)
def grid_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source the rows and columns of a grid's pixels that lie wholly inside it."""
    p, s, q, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_orderkey")
    left, top = 300.0 * (p % 50), 9000 - 200.0 * (s % 40)
    w = grids.window(left, top, left + 100.0 * q, top - 90.0 * q, F.lit(30.0), 400.0 * (o % 20) - 7, 8000 + 30.0 * (o % 9), F.lit(64), F.lit(48))
    d = table(spark, sf, "lineitem").select(o.alias("id"), F.col("l_linenumber").alias("part"), *[x.cast("long").alias(n) for x, n in zip(w, ("c0", "c1", "r0", "r1"))])
    return d.where("c0 is not null")


@query(
    """WITH v AS (SELECT l_suppkey AS px, l_linenumber AS item, l_orderkey AS o, CASE WHEN l_quantity>20 THEN l_quantity END AS v FROM lineitem), f AS (SELECT px, arg_min(v, (item,o)) FILTER (v IS NOT NULL) AS value FROM v GROUP BY px),
 m AS (SELECT px, coalesce(max(v),0) AS largest FROM v GROUP BY px) SELECT m.px, value, CAST(largest AS DOUBLE) AS largest FROM m LEFT JOIN f ON f.px=m.px"""
)
def mosaics(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels that several items cover: the first value in the items' order, and the largest, 0 where none has one."""
    v = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("px"), F.col("l_linenumber").alias("item"), "l_orderkey", F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("double")).alias("value"))
    first = grids.mosaic_first(v, ["px"], F.struct("item", "l_orderkey"), "value")
    return grids.mosaic_largest(v.withColumnRenamed("value", "largest"), ["px"], "largest").join(first, "px", "left").select("px", "value", "largest")


@query()
def scouting_queue_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M10 with M01 and M02: cells of two by four pixels of every area, with z-scores among the area's fields, the forest's
    outliers, priorities and reasons in words."""
    area = F.floor(F.col("row") / 8).cast("int").alias("area")
    cell = ((F.floor(F.col("row") / 2) % 4) * 8 + F.floor(F.col("col") / 4)).cast("long").alias("cell")
    p = pixels(spark, sf).withColumn("ndvi", nd("b4", "b3")).withColumn("ndmi", nd("b4", "b5"))
    share = F.avg(F.col("class").isin(2, 5, 7).cast("int"))
    cells = p.groupBy(area, cell).agg(share.alias("crop"), F.avg((F.col("b1") > 1000).cast("int")).alias("clear"), F.median("ndvi").alias("ndvi"), F.median("ndmi").alias("ndmi"))
    q = scouting.queue(cells, "area", "cell", ["ndvi", "ndmi"], ["ndvi", "ndmi"], F.col("crop") >= 0.1, F.col("clear") >= 0.5)
    return q.select("area", "cell", "place", "priority", "outlier", F.round("strength", 6).alias("strength"), F.round("stress_z", 5).alias("stress_z"), "reason")
