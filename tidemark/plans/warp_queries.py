"""Queries that bring rasters onto other grids: nearest, bilinear, pooled, and onto a web map with colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.operators import warping as R
from tidemark.plans.geodesy_queries import EDGES, ZONE, series_sql, utm_sql
from tidemark.plans.registry import PIXELS, query
from tidemark.sources.roles import pixels

SIDE = 32
SCENE_PIXELS = """sp AS (SELECT "row"//32 AS scene, "row"%32 AS r, col AS c, class, b1, CASE WHEN class<>0 THEN b2 END AS b2 FROM px)"""

# The red-yellow-green ramp of eleven colours.
RED_YELLOW_GREEN = ["#a50026", "#d73027", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850", "#006837"]


def scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(scene, row, col, class, b1, b2): pixels as scenes of 32 by 32; b2 has no data in class 0."""
    p = pixels(spark, sf)
    place = [F.floor(F.col("row") / SIDE).alias("scene"), F.pmod("row", F.lit(SIDE)).alias("row"), "col"]
    return p.select(*place, "class", "b1", F.when(F.col("class") != 0, F.col("b2")).alias("b2"))


def scene_grids(p: DataFrame) -> DataFrame:
    """The grid of each scene: 960 m a side in zone 44, forty scenes in a row."""
    left, top = 500000.0 + (F.col("scene") % 40) * 960, 3100000.0 + F.floor(F.col("scene") / 40) * 960
    return p.select("scene").distinct().select("scene", left.alias("left"), top.alias("top"), F.lit(30.0).alias("step"), F.lit(SIDE).alias("columns"), F.lit(SIDE).alias("rows"))


def moved(g: DataFrame, right: float, up: float, step: float, columns: int, rows: int) -> DataFrame:
    """A grid of another step and size, its corner moved."""
    return g.select("scene", (F.col("left") + right).alias("left"), (F.col("top") + up).alias("top"), F.lit(step).alias("step"), F.lit(columns).alias("columns"), F.lit(rows).alias("rows"))


ASKED = "tg AS (SELECT scene, tr, tc, ((tc+0.5)*47+40)/30 AS u, ((tr+0.5)*47-25)/30 AS v FROM (SELECT DISTINCT scene FROM sp), (SELECT unnest(range(23)) AS tr), (SELECT unnest(range(24)) AS tc))"


@query(
    f"""WITH {SCENE_PIXELS}, {ASKED} SELECT t.scene, CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, b1, b2 FROM tg t
 LEFT JOIN sp ON sp.scene=t.scene AND sp.r=floor(v) AND sp.c=floor(u) AND u>=0 AND u<32 AND v>=0 AND v<32""",
    PIXELS,
)
def raster_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene on a coarser grid that reaches beyond it, from the nearest pixels."""
    p = scene_pixels(spark, sf)
    g = scene_grids(p)
    return R.nearest(R.places(moved(g, 40, 25, 47, 24, 23), g, ["scene"]), p, ["scene"], ["b1", "b2"])


@query(
    f"""WITH {SCENE_PIXELS}, {ASKED}, n AS (SELECT scene, tr, tc, unnest([0,1,0,1]) AS i, unnest([0,0,1,1]) AS j, CASE WHEN u>=0 AND u<32 AND v>=0 AND v<32 THEN u-0.5 END AS a, v-0.5 AS b FROM tg),
 w AS (SELECT scene, tr, tc, floor(a)+i AS c, floor(b)+j AS r, (CASE WHEN i=1 THEN a-floor(a) ELSE 1-a+floor(a) END)*(CASE WHEN j=1 THEN b-floor(b) ELSE 1-b+floor(b) END) AS w FROM n)
 SELECT w.scene, CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, round(sum(w*b1)/sum(w) FILTER (b1 IS NOT NULL),8) AS b1, round(sum(w*b2)/sum(w) FILTER (b2 IS NOT NULL),8) AS b2
 FROM w LEFT JOIN sp ON sp.scene=w.scene AND sp.r=w.r AND sp.c=w.c GROUP BY 1,2,3""",
    PIXELS,
)
def raster_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """The same grids, from the four pixels around every centre that have data."""
    p = scene_pixels(spark, sf)
    g = scene_grids(p)
    made = R.bilinear(R.places(moved(g, 40, 25, 47, 24, 23), g, ["scene"]), p, ["scene"], ["b1", "b2"])
    return made.select("scene", "row", "col", F.round("b1", 8).alias("b1"), F.round("b2", 8).alias("b2"))


@query(
    f"""WITH {SCENE_PIXELS}, k AS (SELECT scene, r//4 AS r, (c+1)//4 AS c, class, count(*) AS k FROM sp WHERE class IS NOT NULL GROUP BY ALL)
 SELECT scene, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(sum(class*k)/sum(k),8) AS mean, arg_max(class,(k,-class)) AS mode, CAST(sum(k) AS BIGINT) AS n FROM k GROUP BY ALL""",
    PIXELS,
)
def raster_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Classes on pixels of 120 m: their mean and the commonest one."""
    p = scene_pixels(spark, sf)
    g = scene_grids(p)
    made = R.pooled(p, g, moved(g, -30, 0, 120, 9, 8), ["scene"], "class")
    return made.select("scene", "row", "col", F.round("mean", 8).alias("mean"), "mode", "n")


_X, _Y = f"(v/{G.SCALE * G.RECTIFYING!r})", f"((u-500000)/{G.SCALE * G.RECTIFYING!r})"


def _ramp_sql(k: int) -> str:
    ramp = "[" + ",".join(f"{float(int(c[k : k + 2], 16))}" for c in RED_YELLOW_GREEN) + "]"
    return f"CAST(round_even({ramp}[s+1]+({ramp}[s+2]-{ramp}[s+1])*(f-s),0) AS INT)"


@query(
    f"""WITH {SCENE_PIXELS}, sc AS (SELECT DISTINCT scene FROM sp), gr AS (SELECT scene AS id, 500000.0+(scene%40)*960 AS gl, 3100000.0+(scene//40)*960 AS gt, gl+960 AS gr, gt-960 AS gb FROM sc),
 {EDGES.format(l="gl", b="gb", r="gr", o="gt", x="u", y="v", source="gr")},
 i1 AS (SELECT *, {_X}-({series_sql(G.BACKWARD, "sin({k}*" + _X + ")*cosh({k}*" + _Y + ")")}) AS x, {_Y}-({series_sql(G.BACKWARD, "cos({k}*" + _X + ")*sinh({k}*" + _Y + ")")}) AS y FROM pt),
 i2 AS (SELECT *, asin(sin(x)/cosh(y)) AS c FROM i1), i3 AS (SELECT *, {G.A!r}*radians({G.central(ZONE)}+degrees(atan2(sinh(y),cos(x)))) AS mx, {G.A!r}*asinh(tan(c+{series_sql(G.LATITUDE, "sin({k}*c)")})) AS my FROM i2),
 bb AS (SELECT id, any_value(gl) AS sl, any_value(gt) AS st, min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1,
 sqrt(pow(max(mx) FILTER (u=gr AND v=gb)-max(mx) FILTER (u=gl AND v=gt),2)+pow(max(my) FILTER (u=gr AND v=gb)-max(my) FILTER (u=gl AND v=gt),2))/sqrt(2048.0) AS step FROM i3 GROUP BY id),
 th AS (SELECT *, unnest(range(CAST(greatest(floor((y1-y0)/step+0.5),1) AS BIGINT))) AS tr FROM bb), tw AS (SELECT *, unnest(range(CAST(greatest(floor((x1-x0)/step+0.5),1) AS BIGINT))) AS tc FROM th),
 ll AS (SELECT id, sl, st, tr, tc, degrees((x0+(tc+0.5)*step)/{G.A!r}) AS plon, degrees(atan(sinh((y1-(tr+0.5)*step)/{G.A!r}))) AS plat FROM tw), {utm_sql("ll")},
 q AS (SELECT id, tr, tc, (u-sl)/30 AS a, (st-v)/30 AS b FROM utm),
 m AS (SELECT id, tr, tc, b1 FROM q LEFT JOIN sp ON sp.scene=id AND sp.r=floor(b) AND sp.c=floor(a) AND a>=0 AND a<32 AND b>=0 AND b<32),
 f AS (SELECT *, least(greatest((coalesce(b1,1000)-1000)/5000.0,0),1)*10 AS f, CAST(least(floor(f),9) AS INT) AS s FROM m)
 SELECT id AS scene, CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, b1, {_ramp_sql(1)} AS r, {_ramp_sql(3)} AS g, {_ramp_sql(5)} AS b, CASE WHEN b1 IS NULL THEN 0 ELSE 255 END AS a FROM f""",
    PIXELS,
)
def web_map_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene on a Web Mercator grid of its own, from the nearest pixels, with the colours of the ramp."""
    p = scene_pixels(spark, sf)
    g = scene_grids(p)
    of = R.utm(ZONE)
    asked = R.places(R.suggested(g, ["scene"], of, R.MERCATOR), g, ["scene"], R.MERCATOR, of)
    made = R.nearest(asked, p, ["scene"], ["b1"])
    shown = made.withColumn("shown", R.colour(F.col("b1").cast("double"), 1000.0, 6000.0, RED_YELLOW_GREEN))
    return shown.select("scene", "row", "col", "b1", "shown.*")
