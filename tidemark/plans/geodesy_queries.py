"""Queries on the ellipsoid: UTM grids and bounds, geodesic lengths, cells' shares of areas, reaches in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G
from tidemark.functions import science as S
from tidemark.plans.registry import query
from tidemark.sources.roles import table

ZONE = 44
BOX = "CAST(79.0+(c_custkey%400)/250.0 AS DOUBLE) AS lon, CAST(28.0+(c_custkey%97)/60.0 AS DOUBLE) AS lat, CAST(0.01+(c_custkey%13)/100.0 AS DOUBLE) AS half"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lon, lat, half): an area of interest for every customer, around a place in zone 44."""
    k = F.col("c_custkey")
    place = [(79.0 + (k % 400) / 250.0).alias("lon"), (28.0 + (k % 97) / 60.0).alias("lat"), (0.01 + (k % 13) / 100.0).alias("half")]
    return table(spark, sf, "customer").select(k.alias("id"), *place)


def series_sql(factors: tuple[float, ...], term: str) -> str:
    return "+".join(f"({f!r})*{term.replace('{k}', str(2 * j))}" for j, f in enumerate(factors, 1))


def utm_sql(source: str) -> str:
    """CTEs that add u (easting) and v (northing) to the rows of ``source(..., plon, plat)``, as table utm."""
    across, k = f"radians(plon-{G.central(ZONE)})", G.SCALE * G.RECTIFYING
    return f"""u1 AS (SELECT *, sinh(atanh(sin(radians(plat)))-{G.E!r}*atanh({G.E!r}*sin(radians(plat)))) AS t FROM {source}),
 u2 AS (SELECT *, atan2(t,cos({across})) AS tx, atanh(sin({across})/sqrt(1+t*t)) AS ty FROM u1),
 utm AS (SELECT *, 500000+{k!r}*(ty+{series_sql(G.FORWARD, "cos({k}*tx)*sinh({k}*ty)")}) AS u, {k!r}*(tx+{series_sql(G.FORWARD, "sin({k}*tx)*cosh({k}*ty)")}) AS v FROM u2)"""


EDGES = """sh AS (SELECT i/22.0 AS t FROM range(23) x(i)), pt AS (SELECT b.*, unnest([{l}+CAST(t AS DOUBLE)*({r}-{l}),{l}+CAST(t AS DOUBLE)*({r}-{l}),{l},{r}]) AS {x},
 unnest([{b},{o},{b}+CAST(t AS DOUBLE)*({o}-{b}),{b}+CAST(t AS DOUBLE)*({o}-{b})]) AS {y} FROM {source} b, sh)"""
GRID = f"""b0 AS (SELECT c_custkey AS id, {BOX} FROM customer), {EDGES.format(l="(lon-half)", r="(lon+half)", b="(lat-half)", o="(lat+half)", x="plon", y="plat", source="b0")},
 {utm_sql("pt")}, mm AS (SELECT id, min(u) AS x0, min(v) AS y0, max(u) AS x1, max(v) AS y1 FROM utm GROUP BY id),
 st AS (SELECT *, 30.0*greatest(1,ceil(greatest(x1-x0,y1-y0)/(30.0*512))) AS step FROM mm),
 gr AS (SELECT id, step, floor((x0-15)/step)*step+15 AS gl, ceil((x1-15)/step)*step+15 AS gr, floor((y0-15)/step)*step+15 AS gb, ceil((y1-15)/step)*step+15 AS gt FROM st)"""


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """The pixel grid of every area: its bounds in UTM, snapped outward; pixels grow so that a side has 512 at most."""
    b = boxes(spark, sf)
    lon, lat, half = F.col("lon"), F.col("lat"), F.col("half")
    points = G.edge_points(lon - half, lat - half, lon + half, lat + half)
    b = G.bounds(b, ["id"], points, G.to_utm, ZONE, ("x0", "y0", "x1", "y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    b = b.withColumn("step", 30.0 * F.greatest(F.lit(1), F.ceil(side / (30.0 * 512))))
    (l, r), (d, t) = (G.snapped(F.col(a), F.col(z), F.col("step"), 15.0) for a, z in (("x0", "x1"), ("y0", "y1")))
    return b.select("id", "step", l.alias("gl"), d.alias("gb"), r.alias("gr"), t.alias("gt"))


@query(f"WITH {GRID} SELECT id, step, gl AS left_m, gt AS top_m, CAST(round((gr-gl)/step) AS BIGINT) AS width, CAST(round((gt-gb)/step) AS BIGINT) AS height FROM gr")
def utm_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Grids by area of interest, in UTM metres."""
    size = lambda a, b: F.round((F.col(b) - F.col(a)) / F.col("step")).cast("long")
    return grids(spark, sf).select("id", "step", F.col("gl").alias("left_m"), F.col("gt").alias("top_m"), size("gl", "gr").alias("width"), size("gb", "gt").alias("height"))


_X = f"(v/{G.SCALE * G.RECTIFYING!r})"
_Y = f"((u-500000)/{G.SCALE * G.RECTIFYING!r})"


@query(
    f"""WITH {GRID}, {EDGES.replace("sh AS", "s2 AS").replace(", sh)", ", s2)").replace("pt AS", "p2 AS").format(l="gl", r="gr", b="gb", o="gt", x="u", y="v", source="gr")},
 i1 AS (SELECT id, {_X}-({series_sql(G.BACKWARD, "sin({k}*" + _X + ")*cosh({k}*" + _Y + ")")}) AS x, {_Y}-({series_sql(G.BACKWARD, "cos({k}*" + _X + ")*sinh({k}*" + _Y + ")")}) AS y FROM p2),
 i2 AS (SELECT id, asin(sin(x)/cosh(y)) AS c, {G.central(ZONE)}+degrees(atan2(sinh(y),cos(x))) AS lon FROM i1), i3 AS (SELECT id, lon, degrees(c+{series_sql(G.LATITUDE, "sin({k}*c)")}) AS lat FROM i2)
 SELECT id, round(min(lon),7) AS west, round(min(lat),7) AS south, round(max(lon),7) AS east, round(max(lat),7) AS north FROM i3 GROUP BY id"""
)
def grid_lonlat_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Each grid's bounds in degrees, from its corners and 21 points along each side."""
    points = G.edge_points(*map(F.col, ("gl", "gb", "gr", "gt")))
    names = ("west", "south", "east", "north")
    found = G.bounds(grids(spark, sf), ["id"], points, G.from_utm, ZONE, names)
    return found.select("id", *[F.round(n, 7).alias(n) for n in names])


_F = repr(G.FLATTENING)
_STEP = f"""(apart+(1-{_F}/16*sq*(4+{_F}*(4-3*sq)))*{_F}*sine*(atan2(s,c)+{_F}/16*sq*(4+{_F}*(4-3*sq))*s*(mid+{_F}/16*sq*(4+{_F}*(4-3*sq))*c*(2*mid*mid-1))))"""
_C = "(sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(al))"
_S = "sqrt(pow(cos(u2)*sin(al),2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(al),2))"
_SINE = f"coalesce(cos(u1)*cos(u2)*sin(al)/nullif({_S},0),0)"
_SQ = f"(1-{_SINE}*{_SINE})"
_MID = f"coalesce({_C}-2*sin(u1)*sin(u2)/nullif({_SQ},0),0)"


def _angles(source: str, name: str) -> str:
    return f"{name} AS (SELECT *, {_S} AS s, {_C} AS c, {_SINE} AS sine, {_SQ} AS sq, {_MID} AS mid FROM {source})"


_ROUNDS = ", ".join(f"{_angles(f'g{i}', f'h{i}')}, g{i + 1} AS (SELECT way, u1, u2, apart, {_STEP} AS al FROM h{i})" for i in range(20))
_P = "(1+u/16384*(4096+u*(-768+u*(320-175*u))))"
_Q = "(u/1024*(256+u*(-128+u*(74-47*u))))"


@query(
    f"""WITH p AS (SELECT user_id AS way, ts, event_id, 79+value/1000 AS lon, 28+(event_id%100)/100.0 AS lat FROM events), l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY way ORDER BY ts, event_id)),
 g0 AS (SELECT way, atan((1-{_F})*tan(radians(lat0))) AS u1, atan((1-{_F})*tan(radians(lat))) AS u2, radians(lon-lon0) AS apart, radians(lon-lon0) AS al FROM l WHERE lon0 IS NOT NULL), {_ROUNDS}, {_angles("g20", "z")},
 zz AS (SELECT *, sq*{(G.A * G.A - G.B * G.B) / (G.B * G.B)!r} AS u FROM z),
 m AS (SELECT way, {G.B!r}*{_P}*(atan2(s,c)-{_Q}*s*(mid+{_Q}/4*(c*(2*mid*mid-1)-{_Q}/6*mid*(4*s*s-3)*(4*mid*mid-3)))) AS d FROM zz)
 SELECT way, round(sum(d)/1000,4) AS km, count(*) AS parts FROM m GROUP BY way"""
)
def geodesic_course(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each way on the ellipsoid, the sum over its parts in order."""
    p = table(spark, sf, "events").select(F.col("user_id").alias("way"), "ts", "event_id", (79 + F.col("value") / 1000).alias("lon"), (28 + (F.col("event_id") % 100) / 100.0).alias("lat"))
    w = W.partitionBy("way").orderBy("ts", "event_id")
    parts = p.select("way", "lon", "lat", F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0")).where("lon0 is not null")
    d = parts.select("way", G.geodesic_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")).alias("d"))
    return d.groupBy("way").agg(F.round(F.sum("d") / 1000, 4).alias("km"), F.count("*").alias("parts"))


CELL = 0.05
CORNERS = 6


def watersheds(spark: SparkSession, sf: str) -> DataFrame:
    """(area, lon, lat, lon2, lat2): the edges of a six-cornered area around the place of every supplier."""
    k = F.col("s_suppkey")
    turn = lambda i: i % CORNERS * (2 * 3.141592653589793 / CORNERS)
    reach = lambda i: 0.03 + ((k * 7 + i % CORNERS * 5) % 11) / 100.0
    x = lambda i: 79.0 + (k % 40) / 25.0 + reach(i) * F.cos(turn(i))
    y = lambda i: 28.0 + (k % 17) / 12.0 + reach(i) * F.sin(turn(i))
    at = F.explode(F.sequence(F.lit(0), F.lit(CORNERS - 1))).alias("i")
    s = table(spark, sf, "supplier").select("s_suppkey", at)
    i, j = F.col("i"), F.col("i") + 1
    return s.select(k.alias("area"), x(i).alias("lon"), y(i).alias("lat"), x(j).alias("lon2"), y(j).alias("lat2"))


_AUTH = "({half}*(sin(radians({y}))/(1-{e2}*pow(sin(radians({y})),2))+atanh({e}*sin(radians({y})))/{e}))"


def authalic_sql(y: str) -> str:
    return _AUTH.format(half=repr(G.B * G.B / 2), e2=repr(G.E2), e=repr(G.E), y=y)


def _corner(i: str, fn: str, base: str) -> str:
    return f"({base}+(0.03+((s_suppkey*7+({i})%{CORNERS}*5)%11)/100.0)*{fn}(({i})%{CORNERS}*{2 * 3.141592653589793 / CORNERS!r}))"


_LON, _LAT = "79.0+(s_suppkey%40)/25.0", "28.0+(s_suppkey%17)/12.0"


@query(
    f"""WITH e AS (SELECT s_suppkey AS area, {_corner("i", "cos", _LON)} AS lon, {_corner("i", "sin", _LAT)} AS lat, {_corner("i+1", "cos", _LON)} AS lon2, {_corner("i+1", "sin", _LAT)} AS lat2 FROM supplier, range({CORNERS}) r(i)),
 bb AS (SELECT area, floor(min(lat)/{CELL}) AS r0, floor(max(lat)/{CELL}) AS r1 FROM e GROUP BY area),
 c AS (SELECT e.*, unnest(range(CAST(floor(least(lon,lon2)/{CELL}) AS BIGINT), CAST(floor(greatest(lon,lon2)/{CELL}) AS BIGINT)+1)) AS cx, r0, r1 FROM e JOIN bb USING (area)),
 d AS (SELECT *, unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT)+1)) AS cy FROM c),
 f AS (SELECT area, cx, cy, radians(lon) AS x1, radians(lon2) AS x2, {authalic_sql("lat")} AS y1, {authalic_sql("lat2")} AS y2, radians(cx*{CELL}) AS l, radians((cx+1)*{CELL}) AS r, {authalic_sql(f"(cy*{CELL})")} AS b, {authalic_sql(f"((cy+1)*{CELL})")} AS t FROM d),
 g AS (SELECT *, least(greatest(x1,l),r) AS p1, least(greatest(x2,l),r) AS p2, coalesce((y2-y1)/nullif(x2-x1,0),0) AS k FROM f),
 h AS (SELECT *, y1+(p1-x1)*k AS v1, y1+(p2-x1)*k AS v2 FROM g),
 w AS (SELECT *, pow(least(greatest(v1,b),t)-b,2)/2+(t-b)*greatest(v1-t,0) AS w1, pow(least(greatest(v2,b),t)-b,2)/2+(t-b)*greatest(v2-t,0) AS w2 FROM h),
 q AS (SELECT area, cx, cy, (p2-p1)*CASE WHEN abs(v2-v1)<=1e-12*(t-b) THEN least(greatest(v1,b),t)-b ELSE (w2-w1)/nullif(v2-v1,0) END AS m2 FROM w),
 o AS (SELECT area, cx, cy, abs(sum(m2))/1e6 AS km2 FROM q GROUP BY 1,2,3) SELECT area, cx, cy, round(km2,5) AS km2, round(km2/sum(km2) OVER (PARTITION BY area),6) AS share FROM o WHERE km2>1e-6"""
)
def cell_area_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each grid cell's share of an area's surface on the ellipsoid.

    In the plane of longitude and authalic height, areas are true, cells are boxes, and what a polygon shares with a box is
    a sum over its edges; an edge meets the cells of its columns within the area's rows, so the join is on the area alone.
    """
    e = watersheds(spark, sf)
    rows = e.groupBy("area").agg(F.floor(F.min("lat") / CELL).alias("r0"), F.floor(F.max("lat") / CELL).alias("r1"))
    columns = F.sequence(F.floor(F.least("lon", "lon2") / CELL), F.floor(F.greatest("lon", "lon2") / CELL))
    c = e.join(rows, "area").withColumn("cx", F.explode(columns)).withColumn("cy", F.explode(F.sequence("r0", "r1")))
    ends = [F.radians(F.col("lon")), G.authalic(F.col("lat")), F.radians(F.col("lon2")), G.authalic(F.col("lat2"))]
    box = [F.radians(F.col("cx") * CELL), F.radians((F.col("cx") + 1) * CELL), G.authalic(F.col("cy") * CELL), G.authalic((F.col("cy") + 1) * CELL)]
    names = ("x1", "y1", "x2", "y2", "l", "r", "b", "t")
    c = c.select("area", "cx", "cy", *[x.alias(n) for x, n in zip(ends + box, names)])
    km2 = c.groupBy("area", "cx", "cy").agg((F.abs(F.sum(G.under_edge(*map(F.col, names)))) / 1e6).alias("km2")).where("km2 > 1e-6")
    return km2.select("area", "cx", "cy", F.round("km2", 5).alias("km2"), F.round(F.col("km2") / F.sum("km2").over(W.partitionBy("area")), 6).alias("share"))


# A course through zone 44 in degrees; queries take it to metres.
COURSE = ((79.40, 28.20), (79.55, 28.32), (79.61, 28.55), (79.90, 28.70))
RADIUS, BUFFER = 12000.0, 250.0
_VALUES = ", ".join(f"({i},{a!r},{b!r})" for i, (a, b) in enumerate(COURSE))


@query(
    f"""WITH src AS (SELECT 0 AS kind, CAST(i AS BIGINT) AS id, CAST(a AS DOUBLE) AS plon, CAST(b AS DOUBLE) AS plat FROM (VALUES {_VALUES}) x(i,a,b) UNION ALL SELECT 1, id, lon, lat FROM (SELECT c_custkey AS id, {BOX} FROM customer)), {utm_sql("src")},
 sg AS (SELECT a.id AS k, a.u AS x1, a.v AS y1, b.u AS x2, b.v AS y2 FROM utm a JOIN utm b ON a.kind=0 AND b.kind=0 AND b.id=a.id+1),
 n AS (SELECT p.id, p.u AS px, p.v AS py, sg.*, least(greatest(((p.u-x1)*(x2-x1)+(p.v-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2)),0.0),1.0) AS t FROM utm p, sg WHERE p.kind=1),
 m AS (SELECT id, px, py, min(sqrt(pow(px-(x1+t*(x2-x1)),2)+pow(py-(y1+t*(y2-y1)),2))) AS d, arg_min({{'x':x1+t*(x2-x1),'y':y1+t*(y2-y1)}}, {{'d':sqrt(pow(px-(x1+t*(x2-x1)),2)+pow(py-(y1+t*(y2-y1)),2)),'k':k}}) AS near FROM n GROUP BY 1,2,3),
 c AS (SELECT id, d, d>{RADIUS} AS snapped, CASE WHEN d>{RADIUS} THEN near.x ELSE px END AS cx, CASE WHEN d>{RADIUS} THEN near.y ELSE py END AS cy FROM m),
 q AS (SELECT c.id, d, snapped, pow(x2-x1,2)+pow(y2-y1,2) AS a, (x1-cx)*(x2-x1)+(y1-cy)*(y2-y1) AS b, pow(x1-cx,2)+pow(y1-cy,2)-{RADIUS * RADIUS!r} AS e FROM c, sg),
 r AS (SELECT *, CASE WHEN b*b-a*e>=0 THEN greatest((-b-sqrt(greatest(b*b-a*e,0)))/a,0) END AS t1, CASE WHEN b*b-a*e>=0 THEN least((-b+sqrt(greatest(b*b-a*e,0)))/a,1) END AS t2 FROM q)
 SELECT id, round(d,3) AS distance_m, snapped, count(*) FILTER (t1<t2) AS parts, round(coalesce(sum(sqrt(a)*(t2-t1)) FILTER (t1<t2),0)/1000,5) AS reach_km FROM r GROUP BY id, d, snapped"""
)
def reach_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every place to a course in UTM metres, and the course's length within a circle
    around it; a place whose circle the course does not enter is first moved to the course's nearest point.

    The course's parts are constants, an array beside each place: no join and no shuffle.
    """
    vertex = lambda p: F.struct(*[x.alias(n) for x, n in zip(G.to_utm(F.lit(p[0]), F.lit(p[1]), ZONE), "xy")])
    parts = F.array(*[F.struct(vertex(a).alias("a"), vertex(b).alias("b")) for a, b in zip(COURSE, COURSE[1:])])
    p = boxes(spark, sf).select("id", *[x.alias(n) for x, n in zip(G.to_utm(F.col("lon"), F.col("lat"), ZONE), ("px", "py"))], parts.alias("parts"))

    def foot(s):
        """Distance to a part and its nearest point."""
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = S.clamp(((F.col("px") - s["a"]["x"]) * dx + (F.col("py") - s["a"]["y"]) * dy) / (dx * dx + dy * dy))
        x, y = s["a"]["x"] + t * dx, s["a"]["y"] + t * dy
        return F.struct(F.sqrt(F.pow(F.col("px") - x, 2) + F.pow(F.col("py") - y, 2)).alias("d"), x.alias("x"), y.alias("y"))

    p = p.withColumn("near", F.array_min(F.transform("parts", foot))).withColumn("snapped", F.col("near.d") > RADIUS)
    moved = lambda a, b: F.when(F.col("snapped"), F.col(a)).otherwise(F.col(b))
    p = p.withColumn("cx", moved("near.x", "px")).withColumn("cy", moved("near.y", "py"))

    def kept(s):
        """Metres of a part that lie in the circle."""
        a, b = s["a"], s["b"]
        t1, t2 = G.inside_circle(a["x"], a["y"], b["x"], b["y"], F.col("cx"), F.col("cy"), F.lit(RADIUS))
        return (t2 - t1) * F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))

    p = p.withColumn("kept", F.filter(F.transform("parts", kept), lambda x: x.isNotNull()))
    length = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x)
    return p.select("id", F.round("near.d", 3).alias("distance_m"), "snapped", F.size("kept").cast("long").alias("parts"), F.round(length / 1000, 5).alias("reach_km"))
