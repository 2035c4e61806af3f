"""Queries over scene lists, seasons at both ends of a comparison, corridors and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import science as S
from tidemark.plans.registry import FLOW, PIXELS, RAIN, SCENES, query
from tidemark.sources.roles import daily_flow, daily_rain, pixels, scenes, table

# The last day of Landsat 7's whole scenes; the day from which Sentinel-2 products carry an offset.
SLC_OFF, OFFSET_FROM = "2003-05-31", "2022-01-25"


@query(
    f"""WITH i AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate + INTERVAL 5 YEAR AS DATE) AS d5, CAST(o_orderdate + INTERVAL 22 YEAR AS DATE) AS d22,
 'landsat-'||CAST(list_extract([5,7,8,9],CAST(o_custkey%4+1 AS INT)) AS VARCHAR) AS platform, list_extract(['04.00','03.01','05.10','n/a',NULL],CAST(o_orderkey%5+1 AS INT)) AS baseline FROM orders)
 SELECT id, platform='landsat-7' AND d5>DATE '{SLC_OFF}' AS slc_off, month(d) IN (2,3) OR (month(d)=1 AND day(d)>=15) AS in_peak,
 CAST(CASE WHEN coalesce(TRY_CAST(baseline AS DOUBLE)>=4.0, d22>=DATE '{OFFSET_FROM}') THEN -1000 ELSE 0 END AS INT) AS offset_dn,
 CAST(CASE WHEN month(d)>=5 THEN year(d) ELSE year(d)-1 END AS INT) AS rabi, CAST(CASE WHEN month(d)>=4 THEN year(d) ELSE year(d)-1 END AS INT) AS rabi_peak, platform IN ('landsat-8','landsat-9') AS oli FROM i"""
)
def scene_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in Landsat 7, peak season, offset by baseline or date, latest complete season."""
    d = F.to_date("o_orderdate")
    platform = F.concat(F.lit("landsat-"), F.element_at(F.array(*map(F.lit, "5789")), (F.col("o_custkey") % 4 + 1).cast("int")))
    names = F.array(F.lit("04.00"), F.lit("03.01"), F.lit("05.10"), F.lit("n/a"), F.lit(None).cast("string"))
    i = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), d.alias("d"), platform.alias("platform"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("baseline"))
    month, year = F.month("d"), F.year("d")
    late = F.coalesce(F.col("baseline").try_cast("double") >= 4.0, F.add_months("d", 22 * 12) >= F.lit(OFFSET_FROM).cast("date"))
    return i.select(
        "id",
        ((F.col("platform") == "landsat-7") & (F.add_months("d", 60) > F.lit(SLC_OFF).cast("date"))).alias("slc_off"),
        (month.isin(2, 3) | ((month == 1) & (F.day("d") >= 15))).alias("in_peak"),
        F.when(late, -1000).otherwise(0).alias("offset_dn"),
        (year - (month < 5).cast("int")).alias("rabi"),
        (year - (month < 4).cast("int")).alias("rabi_peak"),
        F.rlike("platform", F.lit("landsat-8|landsat-9")).alias("oli"),
    )


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS earlier, strftime(o_orderdate,'%Y-%m-%dT00:00:00Z') AS iso FROM orders")
def year_earlier(spark: SparkSession, sf: str) -> DataFrame:
    """The same day a year before (29 February gives the 28th), and UTC text."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", F.add_months("date", -12).alias("earlier"), F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'").alias("iso"))


KM = 110.574, 111.320  # fixed values: kilometres in a degree of latitude, and of longitude at the equator


@query(
    f"""WITH p AS (SELECT c_custkey AS id, 79+c_acctbal/10000 AS lon, 28+(c_custkey%50)/50.0 AS lat, 1+c_nationkey/5.0 AS h FROM customer)
 SELECT id, round(lon-h/({KM[1]}*cos(radians(lat))),6) AS west, round(lat-h/{KM[0]},6) AS south, round(lon+h/({KM[1]}*cos(radians(lat))),6) AS east, round(lat+h/{KM[0]},6) AS north, lon BETWEEN 79.0 AND 79.7 AND lat BETWEEN 28.1 AND 28.8 AS in_region FROM p"""
)
def bbox_from_point(spark: SparkSession, sf: str) -> DataFrame:
    """A box of so many kilometres each way about a point; whether the point lies in a region."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (79 + F.col("c_acctbal") / 10000).alias("lon"), (28 + (F.col("c_custkey") % 50) / 50.0).alias("lat"), (1 + F.col("c_nationkey") / 5.0).alias("h"))
    dy, dx = F.col("h") / KM[0], F.col("h") / (KM[1] * F.cos(F.radians("lat")))
    box = {"west": F.col("lon") - dx, "south": F.col("lat") - dy, "east": F.col("lon") + dx, "north": F.col("lat") + dy}
    return p.select("id", *[F.round(v, 6).alias(k) for k, v in box.items()], (F.col("lon").between(79.0, 79.7) & F.col("lat").between(28.1, 28.8)).alias("in_region"))


SHARES = """ss AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS season, count(*) AS pixels, count(*) FILTER (o_orderstatus='F')*100.0/count(*) AS green,
 count(*) FILTER (o_totalprice>250000)*100.0/count(*) AS built, count(DISTINCT o_custkey) AS looks FROM orders GROUP BY 1,2)"""


def season_shares(spark: SparkSession, sf: str) -> DataFrame:
    """(year, season, pixels, green, built, looks): orders by month as season composites, shares in percent."""
    pct = lambda c: F.count_if(c) * 100.0 / F.count("*")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("season")).agg(
        F.count("*").alias("pixels"), pct(F.col("o_orderstatus") == "F").alias("green"), pct(F.col("o_totalprice") > 250000).alias("built"), F.countDistinct("o_custkey").alias("looks")
    )


@query(
    "SELECT year, season, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'early' WHEN year BETWEEN 1999 AND 2001 THEN 'late' END AS side, coalesce(pixels>=15 AND year BETWEEN 1995 AND 1997 OR pixels>=15 AND year BETWEEN 1999 AND 2001, false) AS used FROM ss",
    SHARES,
)
def season_side_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Each season with the end of the comparison that it belongs to, and whether it is used."""
    side = F.when(F.array_contains(F.array(*map(F.lit, range(1995, 1998))), F.col("year")), "early").when(F.col("year").between(1999, 2001), "late")
    return season_shares(spark, sf).select("year", "season", side.alias("side"), (side.isNotNull() & (F.col("pixels") >= 15)).alias("used"))


@query(
    """WITH u AS (SELECT *, CASE WHEN year<=1997 THEN 1997 ELSE 2001 END AS side FROM ss WHERE pixels>=15 AND (year<=1997 OR year>=1999)),
 e AS (SELECT side, median(green) AS green, median(built) AS built, min(pixels) AS pixels, count(*) AS n, string_agg(year||'-'||season, ',' ORDER BY year, season) AS seasons FROM u GROUP BY 1), k AS (SELECT unnest([1997,1998,2001]) AS side)
 SELECT CAST(k.side AS INT) AS side, round(green,4) AS green, round(built,4) AS built, pixels, coalesce(n,0) AS n, seasons FROM k LEFT JOIN e ON e.side=k.side""",
    SHARES,
)
def usable_season_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians over the usable seasons at each end, their least pixels and names; a null row where there is none."""
    side = F.when(F.col("year") <= 1997, 1997).when(F.col("year") >= 1999, 2001)
    u = season_shares(spark, sf).where("pixels >= 15").withColumn("side", side).where("side is not null")
    names = F.transform(F.array_sort(F.collect_list(F.struct("year", "season"))), lambda x: F.concat_ws("-", x["year"], x["season"]))
    e = u.groupBy("side").agg(F.median("green").alias("green"), F.median("built").alias("built"), F.min("pixels").alias("pixels"), F.count("*").alias("n"), F.array_join(names, ",").alias("seasons"))
    k = spark.createDataFrame([(y,) for y in (1997, 1998, 2001)], "side int")
    return k.join(e, "side", "left").select("side", F.round("green", 4).alias("green"), F.round("built", 4).alias("built"), "pixels", F.coalesce("n", F.lit(0)).alias("n"), "seasons")


@query(
    """WITH y AS (SELECT year, sum(green*pixels)/sum(pixels) AS green, sum(built*pixels)/sum(pixels) AS built FROM ss WHERE pixels>=15 GROUP BY 1),
 b AS (SELECT year, built, 'first' AS product FROM y WHERE year<=1998 UNION ALL SELECT year, built+1, 'second' FROM y WHERE year>1998),
 s AS (SELECT a.year AS y1, b.year AS y2, (b.green-a.green)/(b.year-a.year) AS s FROM y a JOIN y b ON a.year<b.year), t AS (SELECT median(s) AS slope, count(DISTINCT y1)+1 AS n FROM s)
 SELECT y.year, round(y.green,4) AS green, round(b.built,4) AS built, b.product, CASE WHEN t.n>=5 THEN round(t.slope,4) END AS slope FROM y JOIN b ON b.year=y.year CROSS JOIN t""",
    SHARES,
)
def corridor_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Shares year by year, two built-up products joined end to end, and the trend over the seasons used."""
    mean = lambda c: (F.sum(F.col(c) * F.col("pixels")) / F.sum("pixels")).alias(c)
    y = season_shares(spark, sf).where("pixels >= 15").groupBy("year").agg(mean("green"), mean("built"))
    first, second = (y.where(c).select("year", (F.col("built") + k).alias("built"), F.lit(n).alias("product")) for c, k, n in (("year <= 1998", 0, "first"), ("year > 1998", 1, "second")))
    a, b = y.select(F.col("year").alias("y1"), F.col("green").alias("g1")), y.select(F.col("year").alias("y2"), F.col("green").alias("g2"))
    steps = a.join(b, F.col("y1") < F.col("y2")).select("y1", ((F.col("g2") - F.col("g1")) / (F.col("y2") - F.col("y1"))).alias("s"))
    trend = steps.agg(F.median("s").alias("slope"), (F.countDistinct("y1") + 1).alias("years"))
    out = y.select("year", "green").join(first.unionByName(second), "year").join(F.broadcast(trend))
    return out.select("year", F.round("green", 4).alias("green"), F.round("built", 4).alias("built"), "product", F.when(F.col("years") >= 5, F.round("slope", 4)).alias("slope"))


@query(
    """WITH e AS (SELECT CASE WHEN year<=1997 THEN 'a' ELSE 'b' END AS side, median(green) AS green, median(built) AS built, count(*) AS n FROM ss WHERE pixels>=15 AND (year<=1997 OR year>=1999) GROUP BY 1),
 d AS (SELECT max(built) FILTER (side='b')-max(built) FILTER (side='a') AS built_pp, max(green) FILTER (side='b')-max(green) FILTER (side='a') AS green_pp, min(n) AS seasons FROM e)
 SELECT round(built_pp,4) AS built_pp, round(green_pp,4) AS green_pp, seasons, CASE WHEN built_pp IS NULL OR green_pp IS NULL THEN 'NO DATA' WHEN CAST(built_pp>=1 AS INT)+CAST(green_pp<=-1 AS INT)=2 THEN 'HIGH' WHEN built_pp>=1 OR green_pp<=-1 THEN 'WATCH' ELSE 'LOW' END AS flag FROM d""",
    SHARES,
)
def corridor_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends' medians, what changed between them, and how many kinds of change there are."""
    u = season_shares(spark, sf).where("pixels >= 15 and year <> 1998").withColumn("side", F.when(F.col("year") <= 1997, "a").otherwise("b"))
    e = u.groupBy("side").agg(F.median("green").alias("green"), F.median("built").alias("built"), F.count("*").alias("n"))
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    d = e.agg((at("built", "b") - at("built", "a")).alias("built_pp"), (at("green", "b") - at("green", "a")).alias("green_pp"), F.min("n").alias("seasons"))
    kinds = (F.col("built_pp") >= 1).cast("int") + (F.col("green_pp") <= -1).cast("int")
    flag = F.when(kinds.isNull(), "NO DATA").when(kinds == 2, "HIGH").when(kinds == 1, "WATCH").otherwise("LOW")
    return d.select(F.round("built_pp", 4).alias("built_pp"), F.round("green_pp", 4).alias("green_pp"), "seasons", flag.alias("flag"))


@query(
    """WITH t AS (SELECT segment, CAST(year(date) AS INT) AS year, sum(flow) AS v, count(*) AS days FROM flow GROUP BY 1,2), y AS (SELECT segment, year, CASE WHEN days>=365 THEN v END AS v FROM t)
 SELECT segment, round(avg(v) FILTER (year BETWEEN 1996 AND 1999),3) AS normal, CAST(arg_max(year,year) FILTER (v IS NOT NULL) AS INT) AS latest_year, round(arg_max(v,year) FILTER (v IS NOT NULL),3) AS latest,
 round((arg_max(v,year) FILTER (v IS NOT NULL)/avg(v) FILTER (year BETWEEN 1996 AND 1999)-1)*100,3) AS deviation_pct FROM y GROUP BY 1""",
    FLOW,
)
def latest_against_normal(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's mean of the baseline years, its last whole year and how far that departs."""
    t = daily_flow(spark, sf).groupBy("segment", F.year("date").alias("year")).agg(F.sum("flow").alias("v"), F.count("*").alias("days"))
    y = t.select("segment", "year", F.when(F.col("days") >= 365, F.col("v")).alias("v"))
    known = F.when(F.col("v").isNotNull(), F.col("year"))
    d = y.groupBy("segment").agg(F.avg(F.when(F.col("year").between(1996, 1999), F.col("v"))).alias("normal"), F.max(known).alias("latest_year"), F.max_by("v", known).alias("latest"))
    return d.select("segment", F.round("normal", 3).alias("normal"), "latest_year", F.round("latest", 3).alias("latest"), F.round((F.try_divide("latest", "normal") - 1) * 100, 3).alias("deviation_pct"))


@query(
    """WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, l_returnflag AS reach FROM lineitem WHERE l_partkey%40=0)
 SELECT s.date, s.reach, round(f.flow,3) AS flow, CAST(row_number() OVER (PARTITION BY s.date ORDER BY list_position(['R','A','N'],s.reach)) AS INT) AS place FROM s LEFT JOIN flow f ON f.date=s.date AND f.segment='1-URGENT'""",
    FLOW,
)
def flow_on_scene_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The flow of each scene's day, null where there is none; reaches in their own order within a day."""
    s = table(spark, sf, "lineitem").where("l_partkey % 40 = 0").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("reach")).distinct()
    f = daily_flow(spark, sf).where("segment = '1-URGENT'").select("date", F.round("flow", 3).alias("flow"))
    order = F.array_position(F.array(*map(F.lit, "RAN")), F.col("reach"))
    return s.join(f, "date", "left").withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(order)))


RING = [(3.2, 1.1), (21.7, 4.4), (28.3, 19.6), (12.5, 30.2), (7.1, 14.8)]
CROSSINGS = "+".join(
    f"CAST(((y<{y1}e0) <> (y<{y2}e0)) AND x < {x1}e0+(y-({y1}e0))*({x2}e0-{x1}e0)/({y2}e0-{y1}e0) AS INT)" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1])
)


@query(f'WITH {PIXELS}, c AS (SELECT px, col+0.5e0 AS x, "row"%32+0.5e0 AS y FROM px) SELECT px FROM c WHERE ({CROSSINGS})%2=1')
def pixels_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels whose centre lies inside a polygon."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return pixels(spark, sf).where(S.inside(F.col("col") + 0.5, F.col("row") % 32 + 0.5, ring)).select("px")


LINE, CENTRE, RADIUS, BUFFER = [(2.0, 2.0), (16.0, 10.0), (30.0, 28.0)], (14.0, 12.0), 9.0, 3.0


def _inside_circle(x1: float, y1: float, x2: float, y2: float) -> tuple[float, float] | None:
    """The part of a segment inside the circle, from and to, as fractions of its length."""
    dx, dy, ex, ey = x2 - x1, y2 - y1, x1 - CENTRE[0], y1 - CENTRE[1]
    a, b, c = dx * dx + dy * dy, 2 * (ex * dx + ey * dy), ex * ex + ey * ey - RADIUS**2
    if b * b <= 4 * a * c:
        return None
    root = (b * b - 4 * a * c) ** 0.5
    low, high = max(0.0, (-b - root) / (2 * a)), min(1.0, (-b + root) / (2 * a))
    return (low, high) if low < high else None


CLIPPED = []
for (_x1, _y1), (_x2, _y2) in zip(LINE, LINE[1:]):
    if _part := _inside_circle(_x1, _y1, _x2, _y2):
        CLIPPED.append(tuple(v for t in _part for v in (_x1 + t * (_x2 - _x1), _y1 + t * (_y2 - _y1))))
NEAR = "least(" + ", ".join(
    f"sqrt(pow(x-({a}+least(greatest(((x-{a})*{c - a}+(y-{b})*{d - b})/{(c - a) ** 2 + (d - b) ** 2},0),1)*{c - a}),2)+pow(y-({b}+least(greatest(((x-{a})*{c - a}+(y-{b})*{d - b})/{(c - a) ** 2 + (d - b) ** 2},0),1)*{d - b}),2))"
    for a, b, c, d in CLIPPED
) + ")"


@query(f'WITH {PIXELS}, c AS (SELECT px, col+0.5 AS x, "row"%32+0.5 AS y FROM px), n AS (SELECT px, x, y, {NEAR} AS d FROM c) SELECT px, round(d,4) AS distance FROM n WHERE d<={BUFFER} AND sqrt(pow(x-{CENTRE[0]},2)+pow(y-{CENTRE[1]},2))<={RADIUS + BUFFER}')
def corridor_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels within a buffer of the part of a line inside a circle, and not farther than that from the circle."""
    c = pixels(spark, sf).select("px", (F.col("col") + 0.5).alias("x"), (F.col("row") % 32 + 0.5).alias("y"))
    d = F.least(*[S.segment_distance(F.col("x"), F.col("y"), *map(F.lit, part)) for part in CLIPPED])
    away = F.sqrt(F.pow(F.col("x") - CENTRE[0], 2) + F.pow(F.col("y") - CENTRE[1], 2))
    return c.withColumn("d", d).where((F.col("d") <= BUFFER) & (away <= RADIUS + BUFFER)).select("px", F.round("d", 4).alias("distance"))


@query(
    """WITH a AS (SELECT s_suppkey AS area, s_nationkey AS n, s_acctbal/1000 AS x, 2+s_suppkey%5 AS w FROM supplier), f AS (SELECT c_custkey AS scene, c_nationkey AS n, c_acctbal/1000-2 AS x, 4+c_custkey%9 AS w FROM customer),
 o AS (SELECT area, scene, f.x<=a.x AND f.x+f.w>=a.x+a.w AS contains, greatest(least(f.x+f.w,a.x+a.w)-greatest(f.x,a.x),0)/a.w AS share FROM a JOIN f ON f.n=a.n) SELECT area, scene, contains, round(share,8) AS share FROM o WHERE contains OR share>=0.9"""
)
def footprint_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of an area's own tile that cover it whole, or nine tenths of it; shares have seven digits or more than eight,
    so that rounding to eight meets no tie.

    A scene that covers so much holds the area's middle, so that the two meet at the middle's step of the tile, once; the scene is
    at each of its steps. What has no such middle or span (null, not finite, not wider than 0) meets the whole tile at a step of its own.
    """
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("area"), F.col("s_nationkey").alias("n"), (F.col("s_acctbal") / 1000).alias("a0"), (2 + F.col("s_suppkey") % 5).alias("aw"))
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("scene"), F.col("c_nationkey").alias("n"), (F.col("c_acctbal") / 1000 - 2).alias("f0"), (4 + F.col("c_custkey") % 9).alias("fw"))
    a1, f1 = F.col("a0") + F.col("aw"), F.col("f0") + F.col("fw")
    step = lambda x: F.floor(x / 2)
    odd_area, odd_scene = F.lit(-(1 << 60)), F.lit(1 << 60)
    middle = F.when((F.abs("a0") < 1e9) & (F.col("aw") > 0), step((F.col("a0") + a1) / 2))
    span = F.when((F.abs("f0") < 1e9) & (F.col("fw") > 0), F.concat(F.sequence(step(F.col("f0")), step(f1)), F.array(odd_area)))
    a = a.withColumn("step", F.explode(F.array(F.coalesce(middle, odd_area), odd_scene)))
    f = f.withColumn("step", F.explode(F.coalesce(span, F.array(odd_scene))))
    share = F.greatest(F.least(f1, a1) - F.greatest("f0", "a0"), F.lit(0.0)) / F.col("aw")
    o = f.join(a.hint("shuffle_hash"), ["n", "step"]).select("area", "scene", ((F.col("f0") <= F.col("a0")) & (f1 >= a1)).alias("contains"), share.alias("share"))
    # Rounding is what takes longest here, and most scenes cover all.
    rounded = F.when(F.abs(F.col("share") - 1) < 1e-9, 1.0).otherwise(F.round("share", 8))
    return o.where("contains or share >= 0.9").select("area", "scene", "contains", rounded.alias("share"))


@query("SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS INT) AS place, l_quantity AS area, l_discount AS distance FROM lineitem")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of an order, joined place by place."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")))
    both = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("x"))
    zipped = both.select("id", F.posexplode(F.arrays_zip(F.col("x.l_quantity").alias("area"), F.col("x.l_discount").alias("distance"))).alias("at", "z"))
    return zipped.select("id", (F.col("at") + 1).alias("place"), "z.area", "z.distance")


@query(
    f"""WITH {PIXELS}, n AS (SELECT "row"//4 AS area, class, (b4-b3)*1.0/nullif(b4+b3,0) AS v FROM px), k AS (SELECT area, count(*) FILTER (class IN (2,5,7)) AS n FROM n GROUP BY 1)
 SELECT CAST(n.area AS INT) AS area, k.n>=40 AS masked, count(*) AS pixels, round(median(v),5) AS v FROM n JOIN k ON k.area=n.area WHERE k.n<40 OR class IN (2,5,7) GROUP BY 1,2"""
)
def cropland_if_enough(spark: SparkSession, sf: str) -> DataFrame:
    """An area's median over its cropland, over all of its pixels where that leaves too few."""
    crop = F.col("class").isin(2, 5, 7)
    v = F.try_divide((F.col("b4") - F.col("b3")).cast("double"), F.col("b4") + F.col("b3"))
    n = pixels(spark, sf).select(F.floor(F.col("row") / 4).cast("int").alias("area"), crop.alias("crop"), v.alias("v"))
    k = n.groupBy("area").agg((F.count_if("crop") >= 40).alias("masked"))
    kept = n.join(k, "area").where("crop or not masked")
    return kept.groupBy("area", "masked").agg(F.count("*").alias("pixels"), F.round(F.median("v"), 5).alias("v"))


@query(
    f"""WITH {PIXELS}, a AS (SELECT px, class FROM px WHERE px%3<>0), b AS (SELECT px, (class+1)%10 AS class FROM px WHERE px%2=0) SELECT px.px, coalesce(a.class,b.class)=5 AS cropland FROM px LEFT JOIN a ON a.px=px.px LEFT JOIN b ON b.px=px.px"""
)
def mask_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Cropland by the latest year's class, by the last year of the first source where that has none."""
    p = pixels(spark, sf).select("px", "class")
    latest, first = p.where("px % 3 <> 0").select("px", F.col("class").alias("a")), p.where("px % 2 = 0").select("px", ((F.col("class") + 1) % 10).alias("b"))
    return p.select("px").join(latest, "px", "left").join(first, "px", "left").select("px", (F.coalesce("a", "b") == 5).alias("cropland"))


@query(
    """WITH f AS (SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round(sum(flow) FILTER (segment='1-URGENT')*0.0864,4) AS urgent, round(sum(flow) FILTER (segment='5-LOW')*0.0864,4) AS low FROM flow GROUP BY 1,2),
 w AS (SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round(sum(rain),3) AS rain FROM rain GROUP BY 1,2) SELECT f.year, f.month, urgent, low, rain FROM f LEFT JOIN w ON w.year=f.year AND w.month=f.month""",
    FLOW,
    RAIN,
)
def month_table(spark: SparkSession, sf: str) -> DataFrame:
    """Months with all segments side by side and the month's rain."""
    month = [F.year("date").alias("year"), F.month("date").alias("month")]
    f = daily_flow(spark, sf).groupBy(*month).pivot("segment", ["1-URGENT", "5-LOW"]).agg(F.sum("flow") * 0.0864)
    w = daily_rain(spark, sf).groupBy(*month).agg(F.round(F.sum("rain"), 3).alias("rain"))
    return f.join(w, ["year", "month"], "left").select("year", "month", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"), "rain")


@query(
    "SELECT aoi, round(count(*) FILTER (cloud IS NOT NULL AND scene%7<>0)*1.0/greatest(count(*),1),5) AS coverage, round(count(*) FILTER (scene%7<>0 AND cloud<40)*1.0/greatest(count(*) FILTER (scene%7<>0),1),5) AS clear FROM sc GROUP BY 1",
    SCENES,
)
def coverage_and_clear(spark: SparkSession, sf: str) -> DataFrame:
    """The seen share of an area, and the clear share of what is seen."""
    seen = F.col("scene") % 7 != 0
    share = lambda a, b: F.round(F.count_if(a) / F.greatest(b, F.lit(1)), 5)
    return scenes(spark, sf).groupBy("aoi").agg(share(seen & F.col("cloud").isNotNull(), F.count("*")).alias("coverage"), share(seen & (F.col("cloud") < 40), F.count_if(seen)).alias("clear"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 1985+p_partkey%40 AS asked, p_size FROM part), q AS (SELECT id, asked, CASE WHEN asked<=2016 THEN 'first' ELSE 'second' END AS product, CASE WHEN asked<=2016 THEN greatest(asked,1990) ELSE least(asked,2023) END AS shown, p_size FROM p)
 SELECT CAST(shown AS INT) AS shown, product, round(avg(CASE WHEN product='first' THEN CAST(p_size BETWEEN 1 AND 20 AS INT) ELSE CAST(p_size%7=0 AS INT) END)*100,4) AS built_pct FROM q GROUP BY 1,2"""
)
def built_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Built share for a year asked for: one product until 2016, another after it, years clamped to what each has."""
    asked = (1985 + F.col("p_partkey") % 40).cast("int")
    early = asked <= 2016
    built = F.when(early, F.col("p_size").between(1, 20)).otherwise(F.col("p_size") % 7 == 0).cast("int")
    shown = F.when(early, F.greatest(asked, F.lit(1990))).otherwise(F.least(asked, F.lit(2023)))
    rows = table(spark, sf, "part").select(shown.alias("shown"), F.when(early, "first").otherwise("second").alias("product"), built.alias("built"))
    return rows.groupBy("shown", "product").agg(F.round(F.avg("built") * 100, 4).alias("built_pct"))


@query(
    f"""WITH {PIXELS}, v AS (SELECT px, class, (b4-b3)*1.0/nullif(b4+b3,0) AS a, (b8-b7)*1.0/nullif(b8+b7,0) AS b FROM px), m AS (SELECT median(a) AS ma, median(b) AS mb FROM v),
 r AS (SELECT class=5 AS truth, a>=ma+0.1 AND b>=mb+0.1 AS rel, a>=0.2 AND b>=0.2 AS absolute FROM v, m)
 SELECT round(avg(CAST(rel AS INT))*100,4) AS relative_pct, round(avg(CAST(absolute AS INT))*100,4) AS absolute_pct, round(count(*) FILTER (rel AND truth)*1.0/nullif(count(*) FILTER (rel),0),5) AS precision FROM r"""
)
def permanent_vegetation(spark: SparkSession, sf: str) -> DataFrame:
    """Green in both windows: above each median by a tenth, above a fixed value; the first rule's precision."""
    nd = lambda x, y: F.try_divide((F.col(x) - F.col(y)).cast("double"), F.col(x) + F.col(y))
    v = pixels(spark, sf).select((F.col("class") == 5).alias("truth"), nd("b4", "b3").alias("a"), nd("b8", "b7").alias("b"))
    m = v.agg(F.median("a").alias("ma"), F.median("b").alias("mb"))
    r = v.join(F.broadcast(m)).select("truth", ((F.col("a") >= F.col("ma") + 0.1) & (F.col("b") >= F.col("mb") + 0.1)).alias("rel"), ((F.col("a") >= 0.2) & (F.col("b") >= 0.2)).alias("absolute"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 4)
    return r.agg(share("rel").alias("relative_pct"), share("absolute").alias("absolute_pct"), F.round(F.try_divide(F.count_if(F.col("rel") & F.col("truth")), F.count_if("rel")), 5).alias("precision"))


@query(
    """WITH k AS (SELECT unnest([10,15,20]) AS least), d AS (SELECT year, season, looks, green-lag(green) OVER (PARTITION BY season ORDER BY year) AS d FROM ss)
 SELECT CAST(least AS INT) AS least, count(d) FILTER (looks>=least) AS n, round(median(abs(d)) FILTER (looks>=least),4) AS mid, round(quantile_cont(abs(d),0.9) FILTER (looks>=least),4) AS p90, count(*) FILTER (looks>=least)||'/'||count(*) AS shown FROM d CROSS JOIN k GROUP BY 1""",
    SHARES,
)
def deltas_by_least_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Year-to-year changes for several least numbers of looks, and how many seasons have that many."""
    step = F.col("green") - F.lag("green").over(W.partitionBy("season").orderBy("year"))
    d = season_shares(spark, sf).withColumn("d", step).withColumn("least", F.explode(F.array(*map(F.lit, (10, 15, 20)))))
    enough = F.col("looks") >= F.col("least")
    size = F.when(enough, F.abs("d"))
    return d.groupBy("least").agg(
        F.count(size).alias("n"), F.round(F.median(size), 4).alias("mid"), F.round(F.percentile(size, 0.9), 4).alias("p90"), F.concat_ws("/", F.count_if(enough), F.count("*")).alias("shown")
    )


@query(
    f"""WITH {PIXELS}, s AS (SELECT "row"//4 AS block, col AS distance, b1/10000.0 AS f FROM px), g AS (SELECT avg(f) AS bg, stddev_samp(f) AS sd, quantile_cont(f,0.99) AS p99 FROM s WHERE distance>=20)
 SELECT round(bg,6) AS bg, round(sd,6) AS sd, round(p99,6) AS p99, round((SELECT sum(f-bg)*100/(count(DISTINCT block)*40) FROM s, g g2 WHERE distance<8),5) AS width_m, (SELECT count(*) FROM s, g g2 WHERE distance<8 AND f>p99) AS above FROM g"""
)
def equivalent_width(spark: SparkSession, sf: str) -> DataFrame:
    """Water fraction near the line over what lies far from it, as a width; how many pixels exceed the far ones."""
    s = pixels(spark, sf).select(F.floor(F.col("row") / 4).alias("block"), F.col("col").alias("distance"), (F.col("b1") / 10000.0).alias("f"))
    g = s.where("distance >= 20").agg(F.avg("f").alias("bg"), F.stddev("f").alias("sd"), F.percentile("f", 0.99).alias("p99"))
    near = s.where("distance < 8").join(F.broadcast(g)).groupBy("bg", "sd", "p99")
    width = F.sum(F.col("f") - F.col("bg")) * 100 / (F.countDistinct("block") * 40)
    n = near.agg(F.round(width, 5).alias("width_m"), F.count_if(F.col("f") > F.col("p99")).alias("above"))
    return n.select(*[F.round(c, 6).alias(c) for c in ("bg", "sd", "p99")], "width_m", "above")


@query(
    f"""WITH {PIXELS}, s AS (SELECT CAST("row"//4 AS INT) AS block, col AS distance, b1/10000.0 AS f FROM px) SELECT block, round((avg(f) FILTER (distance<8)-avg(f) FILTER (distance>=20))*count(*) FILTER (distance<8)*100/400,5) AS width_m
 FROM s GROUP BY 1 HAVING count(*) FILTER (distance<8)>=20 AND count(*) FILTER (distance>=20)>=20"""
)
def block_widths(spark: SparkSession, sf: str) -> DataFrame:
    """The width block by block, where enough pixels lie near and far."""
    near, far = F.col("col") < 8, F.col("col") >= 20
    f = F.col("b1") / 10000.0
    b = pixels(spark, sf).groupBy(F.floor(F.col("row") / 4).cast("int").alias("block"))
    width = (F.avg(F.when(near, f)) - F.avg(F.when(far, f))) * F.count_if(near) * 100 / 400
    return b.agg(F.round(width, 5).alias("width_m"), F.count_if(near).alias("a"), F.count_if(far).alias("b")).where("a >= 20 and b >= 20").select("block", "width_m")


@query(f"WITH {PIXELS} SELECT class, round(avg(b2),4) AS mean, round(quantile_cont(b2,0.05),4) AS p05, round(quantile_cont(b2,0.5),4) AS p50, round(quantile_cont(b2,0.95),4) AS p95 FROM px GROUP BY 1")
def mix_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and percentiles of what was unmixed, for each true share."""
    p = F.percentile("b2", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    d = pixels(spark, sf).groupBy("class").agg(F.avg("b2").alias("mean"), p.alias("p"))
    return d.select("class", F.round("mean", 4).alias("mean"), *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query(
    """WITH p AS (SELECT user_id AS way, ts, event_id, 79+value/1000 AS lon, 28+(event_id%100)/100.0 AS lat FROM events), s AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY way ORDER BY ts, event_id))
 SELECT way, round(coalesce(sum(2*6371.0088*asin(sqrt(least(1.0,pow(sin(radians(lat-lat0)/2),2)+cos(radians(lat0))*cos(radians(lat))*pow(sin(radians(lon-lon0)/2),2))))),0),3) AS km, arg_min(event_id, pow(lon-79.1,2)+pow(lat-28.2,2)) AS head, arg_max(event_id, pow(lon-79.1,2)+pow(lat-28.2,2)) AS mouth FROM s GROUP BY 1"""
)
def course_length(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each way along the sphere, and the points nearest to and farthest from a reference; of points
    equally far away, the first on the way."""
    p = table(spark, sf, "events").select(F.col("user_id").alias("way"), "ts", "event_id", (79 + F.col("value") / 1000).alias("lon"), (28 + (F.col("event_id") % 100) / 100.0).alias("lat"))
    w = W.partitionBy("way").orderBy("ts", "event_id")
    s = p.withColumn("km", S.haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))).withColumn("at", F.row_number().over(w))
    away = F.pow(F.col("lon") - 79.1, 2) + F.pow(F.col("lat") - 28.2, 2)
    near, far = (F.when(away.isNotNull(), F.struct(away, at)) for at in (F.col("at"), -F.col("at")))
    return s.groupBy("way").agg(F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 3).alias("km"), F.min_by("event_id", near).alias("head"), F.max_by("event_id", far).alias("mouth"))


@query(
    """WITH s AS (SELECT segment, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS season, sum(flow) AS v FROM flow GROUP BY 1,2,3)
 SELECT segment, season, round(min(v)/nullif(max(v),0),5) AS ratio, round(avg(v)-avg(v) FILTER (year>=1997),4) AS warm_up_effect FROM s GROUP BY 1,2""",
    FLOW,
)
def season_ratio_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Least over greatest of each season, and what warm-up years do to the mean."""
    s = daily_flow(spark, sf).groupBy("segment", F.year("date").alias("year"), F.quarter("date").alias("season")).agg(F.sum("flow").alias("v"))
    late = F.when(F.col("year") >= 1997, F.col("v"))
    return s.groupBy("segment", "season").agg(F.round(F.try_divide(F.min("v"), F.max("v")), 5).alias("ratio"), F.round(F.avg("v") - F.avg(late), 4).alias("warm_up_effect"))


@query("SELECT cell, date, rain FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date DESC) AS k FROM rain WHERE date<DATE '2000-06-01') WHERE k<=30", RAIN)
def last_complete_days(spark: SparkSession, sf: str) -> DataFrame:
    """The last 30 days before a day."""
    w = W.partitionBy("cell").orderBy(F.desc("date"))
    return daily_rain(spark, sf).where("date < date'2000-06-01'").withColumn("k", F.row_number().over(w)).where("k <= 30").select("cell", "date", "rain")


@query("SELECT aoi, round(arg_max(cloud,(ts,scene))-arg_min(cloud,(ts,scene)),4) AS pp, count(*) AS looks FROM sc WHERE cloud<60 GROUP BY 1", SCENES)
def last_minus_first(spark: SparkSession, sf: str) -> DataFrame:
    """The last value less the first, null where one is missing."""
    at = F.struct("ts", "scene")
    return scenes(spark, sf).where("cloud < 60").groupBy("aoi").agg(F.round(F.max_by("cloud", at) - F.min_by("cloud", at), 4).alias("pp"), F.count("*").alias("looks"))


@query(
    """WITH t AS (SELECT DISTINCT scene, aoi, cloud, day(day) BETWEEN 10 AND 20 AS narrow FROM sc WHERE cloud<50), n AS (SELECT *, count(*) FILTER (narrow) OVER (PARTITION BY aoi) AS k FROM t)
 SELECT aoi, k<2 AS widened, count(*) AS looks, round(median(cloud),4) AS cloud FROM n WHERE narrow OR k<2 GROUP BY 1,2""",
    SCENES,
)
def widening_window(spark: SparkSession, sf: str) -> DataFrame:
    """A narrow range of dates, all of them where that has fewer than two usable looks."""
    t = scenes(spark, sf).where("cloud < 50").withColumn("narrow", F.day("day").between(10, 20)).dropDuplicates(["scene"])
    n = t.withColumn("k", F.count_if("narrow").over(W.partitionBy("aoi"))).where("narrow or k < 2")
    return n.groupBy("aoi", (F.col("k") < 2).alias("widened")).agg(F.count("*").alias("looks"), F.round(F.median("cloud"), 4).alias("cloud"))


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY ts DESC, scene) AS k FROM sc WHERE cloud<=70), t AS (SELECT *, scene%3=0 AS fails FROM c WHERE k<=24), f AS (SELECT aoi, min(k) FILTER (NOT fails) AS hit FROM t GROUP BY 1)
 SELECT t.aoi, max(scene) FILTER (k=hit AND hit<=3) AS scene, count(*) FILTER (fails AND k<least(coalesce(hit,4),4)) AS failed FROM t JOIN f ON f.aoi=t.aoi GROUP BY 1""",
    SCENES,
)
def first_readable(spark: SparkSession, sf: str) -> DataFrame:
    """Newest first, at most 24 checked; the first of three tries that can be read, and how many failed."""
    c = scenes(spark, sf).where("cloud <= 70").withColumn("k", F.row_number().over(W.partitionBy("aoi").orderBy(F.desc("ts"), "scene"))).where("k <= 24")
    t = c.withColumn("fails", F.col("scene") % 3 == 0).withColumn("hit", F.min(F.when(F.col("scene") % 3 != 0, F.col("k"))).over(W.partitionBy("aoi")))
    tried = F.col("fails") & (F.col("k") < F.least(F.coalesce("hit", F.lit(4)), F.lit(4)))
    return t.groupBy("aoi").agg(F.max(F.when((F.col("k") == F.col("hit")) & (F.col("hit") <= 3), F.col("scene"))).alias("scene"), F.count_if(tried).alias("failed"))


@query(
    """WITH d AS (SELECT o_custkey AS id, o_orderkey AS item, CASE WHEN o_orderkey%6<>0 THEN o_orderdate END AS ts FROM orders) SELECT id, string_agg(item, ',' ORDER BY ts DESC NULLS LAST, item) AS newest_first, CAST(list_extract(list_sort(list_distinct(list(year(ts)) FILTER (ts IS NOT NULL))),-2) AS INT) AS default_year FROM d GROUP BY 1"""
)
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """Items newest first, those without a date last; the second-latest year."""
    ts = F.when(F.col("o_orderkey") % 6 != 0, F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.struct(F.coalesce(-ts, F.lit(2**62)).alias("late"), F.col("o_orderkey").alias("item")).alias("x"), F.when(ts.isNotNull(), F.year("o_orderdate")).alias("year"))
    g = d.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.array_sort(F.collect_set("year")).alias("years"))
    return g.select("id", F.array_join(F.col("x.item").cast("array<string>"), ",").alias("newest_first"), F.try_element_at("years", F.lit(-2)).alias("default_year"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority='1-URGENT' INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag='R'")
def shared_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that two tables have in common."""
    a = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date"))
    return a.intersect(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("date")))


@query("WITH a AS (SELECT c_custkey AS id, 'picked' AS origin FROM customer WHERE c_acctbal>4000), b AS (SELECT c_custkey AS id, 'added' AS origin FROM customer WHERE c_nationkey<5) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def append_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are added where their key is not there yet."""
    c = table(spark, sf, "customer")
    a = c.where("c_acctbal > 4000").select(F.col("c_custkey").alias("id"), F.lit("picked").alias("origin"))
    b = c.where("c_nationkey < 5").select(F.col("c_custkey").alias("id"), F.lit("added").alias("origin"))
    return a.unionByName(b.join(a, "id", "left_anti"))


@query("SELECT aoi, scene, cloud, NULL::VARCHAR AS orbit, 'optical' AS sensor FROM sc WHERE scene%2=0 UNION ALL SELECT aoi, scene, NULL, orbit, 'radar' FROM sc WHERE scene%2=1", SCENES)
def optical_and_radar(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two sensors that share only some columns."""
    s = scenes(spark, sf)
    optical = s.where("scene % 2 = 0").select("aoi", "scene", "cloud", F.lit("optical").alias("sensor"))
    return optical.unionByName(s.where("scene % 2 = 1").select("aoi", "scene", "orbit", F.lit("radar").alias("sensor")), allowMissingColumns=True)


@query(
    """WITH h AS (SELECT event_id AS id, 'https://h/'||event_id||'.tif'||CASE event_id%4 WHEN 0 THEN '?sv=1&se=2024-01-'||lpad(CAST(1+event_id%28 AS VARCHAR),2,'0')||'T06:00:00Z&sig=x' WHEN 1 THEN '?se=soon' ELSE '' END AS href FROM events)
 SELECT id, TRY_CAST(replace(replace(nullif(regexp_extract(href,'[?&]se=([^&]*)',1),''),'T',' '),'Z','') AS TIMESTAMP) AS expiry FROM h"""
)
def token_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """when a signed address expires, null where it does not say."""
    day = F.lpad((1 + F.col("event_id") % 28).cast("string"), 2, "0")
    signed = F.concat(F.lit("?sv=1&se=2024-01-"), day, F.lit("T06:00:00Z&sig=x"))
    kind = F.col("event_id") % 4
    href = F.concat(F.lit("https://h/"), "event_id", F.lit(".tif"), F.when(kind == 0, signed).when(kind == 1, "?se=soon").otherwise(""))
    expiry = F.try_to_timestamp(F.parse_url(href, F.lit("QUERY"), F.lit("se")))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), expiry.cast("timestamp_ntz").alias("expiry"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), x AS (SELECT date, sin(2*pi()*dayofyear(date)/365.25) AS s, cos(2*pi()*dayofyear(date)/365.25) AS c FROM d), y AS (SELECT date, CAST(round_even(atan2(s,c)/(2*pi())*365.25,0) AS INT) AS k FROM x)
 SELECT date, CAST(((k%365)+365)%365 AS INT) AS doy, len(list_filter(generate_series(0,40), lambda i: month(date+CAST(i AS INT)) BETWEEN 7 AND 9))>0 AS monsoon FROM y"""
)
def day_of_year_back(spark: SparkSession, sf: str) -> DataFrame:
    """the day of the year from its sine and cosine; whether forty days from it touch July to September."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    back = F.bround(F.atan2(F.sin(angle), F.cos(angle)) / (2 * F.pi()) * 365.25).cast("int")
    touches = F.exists(F.sequence("date", F.date_add("date", 40)), lambda x: F.month(x).between(7, 9))
    return d.select("date", F.pmod(back, F.lit(365)).alias("doy"), touches.alias("monsoon"))


@query("SELECT p_partkey AS id, list_aggregate(list_sort(list_distinct([1990,2000,2010,2020,1985+p_size])),'string_agg',',') AS years FROM part")
def timeline_years(spark: SparkSession, sf: str) -> DataFrame:
    """a fixed set of years and the latest one."""
    made = F.array_sort(F.array_distinct(F.array(*map(F.lit, (1990, 2000, 2010, 2020)), 1985 + F.col("p_size"))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(made.cast("array<string>"), ",").alias("years"))


@query(
    """WITH g AS (SELECT c_custkey AS id, abs(c_acctbal)*3+100 AS w, 500+(c_custkey%90)*111 AS h FROM customer), r AS (SELECT *, greatest(10, ceil(greatest(w,h)/1000.0/10)*10) AS res FROM g)
 SELECT id, CAST(res AS INT) AS res, CAST(ceil(w/res) AS INT) AS cols, CAST(ceil(h/res) AS INT) AS lines, CAST(ceil(greatest(400, w/20, h/20)/100)*100 AS INT) AS cell FROM r"""
)
def grid_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The least whole multiple of ten metres that keeps a grid within 1000 a side; its shape; cell size."""
    w, h = F.abs("c_acctbal") * 3 + 100, (500 + (F.col("c_custkey") % 90) * 111).cast("double")
    g = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), w.alias("w"), h.alias("h"))
    res = F.greatest(F.lit(10), F.ceil(F.greatest("w", "h") / 1000.0 / 10) * 10)
    cell = F.ceil(F.greatest(F.lit(400.0), F.col("w") / 20, F.col("h") / 20) / 100) * 100
    return g.select("id", res.cast("int").alias("res"), F.ceil(F.col("w") / res).cast("int").alias("cols"), F.ceil(F.col("h") / res).cast("int").alias("lines"), cell.cast("int").alias("cell"))


@query(
    f"""WITH {PIXELS}, m AS (SELECT "row" AS y, col AS x, b1 FROM px WHERE b1>3000), e AS (SELECT m.y, m.x, m.b1 FROM m JOIN m n ON (n.x=m.x AND abs(n.y-m.y)<=1) OR (n.y=m.y AND abs(n.x-m.x)=1) GROUP BY 1,2,3 HAVING count(*)=5)
 SELECT CAST(y AS INT) AS y, x, b1 FROM e WHERE b1>=(SELECT median(b1) FROM e)"""
)
def eroded_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels whose four neighbours are in the mask too; of those the half with the highest value."""
    m = pixels(spark, sf).where("b1 > 3000").select(F.col("row").alias("y"), F.col("col").alias("x"), "b1")
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    votes = m.select("*", sides.alias("s")).groupBy((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    inner = votes.agg(F.count("*").alias("n"), F.max(F.when((F.col("s.dy") == 0) & (F.col("s.dx") == 0), F.col("b1"))).alias("b1")).where("n = 5")
    mid = inner.agg(F.median("b1").alias("mid"))
    return inner.join(F.broadcast(mid)).where("b1 >= mid").select("y", "x", "b1")


@query(
    f"""WITH {PIXELS}, c AS (SELECT "row"//2 AS y, col//2 AS x, class, count(*) AS n FROM px WHERE class IS NOT NULL GROUP BY 1,2,3), k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, class) AS r FROM c) SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, class FROM k WHERE r=1"""
)
def mode_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest class of each coarse pixel, the smallest of equals."""
    place = [F.floor(F.col("row") / 2).cast("int").alias("y"), F.floor(F.col("col") / 2).cast("int").alias("x")]
    c = pixels(spark, sf).where("class is not null").groupBy(*place, "class").agg(F.count("*").alias("n"))
    return c.groupBy("y", "x").agg(F.max(F.struct("n", (-F.col("class")).alias("low"), "class"))["class"].alias("class"))


@query("SELECT c_custkey AS id, coalesce(n.n_name,'whole river') AS reach, r.r_regionkey AS first FROM customer LEFT JOIN nation n ON n.n_nationkey=c_nationkey+5 LEFT JOIN region r ON r.r_regionkey=n.n_regionkey")
def reach_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """P20: a reach's bounds by its key; the whole river where there is none."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") - 5).alias("c_nationkey"), "n_name", F.col("r_regionkey").alias("first"))
    return table(spark, sf, "customer").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("n_name", F.lit("whole river")).alias("reach"), "first")


@query("SELECT CAST(l_linenumber AS INT) AS horizon, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem WHERE l_linenumber IN (1,3) AND l_linestatus='O' GROUP BY 1,2")
def horizon_years(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of some horizons, reliable ones only, by the year of their target."""
    rows = table(spark, sf, "lineitem").where("l_linenumber in (1, 3) and l_linestatus = 'O'")
    return rows.groupBy(F.col("l_linenumber").alias("horizon"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS id, bool_or(length(text)>400) AS any_skipped FROM conversations GROUP BY 1")
def any_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any part of a nested result was skipped."""
    parts = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct((F.length("text") > 400).alias("skipped"))).alias("parts"))
    return parts.select("id", F.exists("parts", lambda p: p["skipped"]).alias("any_skipped"))


@query(
    """SELECT c_custkey AS id, CASE WHEN month(DATE '2020-01-01'+CAST(c_custkey%365 AS INT)) BETWEEN 6 AND 10 THEN 'wet' ELSE 'dry' END AS period, c_acctbal>=0 AND c_nationkey<>3 AS reliable, CASE WHEN c_acctbal<0 THEN 'none' WHEN c_acctbal<3000 THEN 'weak' ELSE 'clear' END AS signature, round(greatest(c_acctbal/100,0),2) AS width_m FROM customer"""
)
def width_cases(spark: SparkSession, sf: str) -> DataFrame:
    """P25: period, reliability and signature of a width by cases; no width is below nothing."""
    month = F.month(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")))
    v = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(month.between(6, 10), "wet").otherwise("dry").alias("period"),
        ((v >= 0) & (F.col("c_nationkey") != 3)).alias("reliable"),
        F.when(v < 0, "none").when(v < 3000, "weak").otherwise("clear").alias("signature"),
        F.round(F.greatest(v / 100, F.lit(0.0)), 2).alias("width_m"),
    )


# Where the canopy's words change.
CANOPY = ((0.2, "bare"), (0.4, "sparse"), (0.6, "moderate"))


@query(
    f"""WITH {PIXELS}, n AS (SELECT px, (b4-b3)*1.0/nullif(b4+b3,0) AS v, (b2-b1)*1.0/nullif(b2+b1,0) AS w FROM px)
 SELECT px AS id, concat_ws('; ', CASE WHEN v IS NULL THEN 'no NDVI' WHEN v<0.2 THEN 'bare canopy' WHEN v<0.4 THEN 'sparse canopy' WHEN v<0.6 THEN 'moderate canopy' ELSE 'dense canopy' END, CASE WHEN w<-0.1 THEN 'dry' END, CASE WHEN v<0.2 AND w<-0.1 THEN 'check on the ground' END) AS brief FROM n"""
)
def field_brief(spark: SparkSession, sf: str) -> DataFrame:
    """findings of a field in words, those that apply, in a fixed order."""
    nd = lambda a, b: F.try_divide((F.col(a) - F.col(b)).cast("double"), F.col(a) + F.col(b))
    n = pixels(spark, sf).select(F.col("px").alias("id"), nd("b4", "b3").alias("v"), nd("b2", "b1").alias("w"))
    words = F.when(F.col("v").isNull(), "no NDVI")
    for limit, name in CANOPY:
        words = words.when(F.col("v") < limit, f"{name} canopy")
    dry = F.col("w") < -0.1
    return n.select("id", F.concat_ws("; ", words.otherwise("dense canopy"), F.when(dry, "dry"), F.when((F.col("v") < 0.2) & dry, "check on the ground")).alias("brief"))


@query("SELECT scene, 'cloud '||CASE WHEN cloud IS NULL OR scene%9=0 THEN 'n/a' ELSE printf('%+.2f',cloud-50) END||CASE WHEN cloud>80 THEN ', too much' ELSE '' END AS reason FROM sc", SCENES)
def reason_text(spark: SparkSession, sf: str) -> DataFrame:
    """a row's reason with a signed number, n/a where there is none."""
    shown = F.when(F.col("cloud").isNull() | (F.col("scene") % 9 == 0), "n/a").otherwise(F.format_string("%+.2f", F.col("cloud") - 50))
    return scenes(spark, sf).select("scene", F.concat(F.lit("cloud "), shown, F.when(F.col("cloud") > 80, ", too much").otherwise("")).alias("reason"))


@query(
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY aoi, day ORDER BY cloud, scene) AS k FROM sc WHERE cloud<=60), o AS (SELECT aoi, day, scene, cloud, ntile(6) OVER (PARTITION BY aoi ORDER BY day) AS bin FROM d WHERE k=1),
 b AS (SELECT *, row_number() OVER (PARTITION BY aoi, bin ORDER BY cloud, scene) AS k FROM o) SELECT aoi, day, scene, round(1-cloud/100,6) AS ndvi, round(lag(cloud) OVER w/100-cloud/100,6) AS step, datediff('day', lag(day) OVER w, day) AS days FROM b WHERE k=1 WINDOW w AS (PARTITION BY aoi ORDER BY day)""",
    SCENES,
)
def index_series(spark: SparkSession, sf: str) -> DataFrame:
    """A series of one scene a day, thinned to bins of time by least cloud, with steps and gaps."""
    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("cloud", "scene"))
    d = scenes(spark, sf).where("cloud <= 60").withColumn("k", best("aoi", "day")).where("k = 1")
    d = d.withColumn("bin", F.ntile(6).over(W.partitionBy("aoi").orderBy("day"))).withColumn("k", best("aoi", "bin")).where("k = 1")
    w = W.partitionBy("aoi").orderBy("day")
    step = F.lag("cloud").over(w) / 100 - F.col("cloud") / 100
    return d.select("aoi", "day", "scene", F.round(1 - F.col("cloud") / 100, 6).alias("ndvi"), F.round(step, 6).alias("step"), F.datediff("day", F.lag("day").over(w)).cast("long").alias("days"))


QUEUE = """c AS (SELECT CAST("row"//2 AS INT) AS y, CAST(col//4 AS INT) AS x, count(*) AS n, avg(CAST(class IN (2,5,7) AS INT)) AS crop, median((b4-b3)*1.0/nullif(b4+b3,0)) AS v, median((b2-b1)*1.0/nullif(b2+b1,0)) AS m FROM px GROUP BY 1,2),
 u AS (SELECT *, crop>=0.1 AS field FROM c), s AS (SELECT median(v) AS vm, median(m) AS mm, count(*) AS cells FROM u WHERE field), a AS (SELECT 1.4826*median(abs(v-vm)) AS va, 1.4826*median(abs(m-mm)) AS ma FROM u, s WHERE field),
 z AS (SELECT u.*, CASE WHEN field AND cells>=5 AND va>1e-9 THEN (v-vm)/va END AS zv, CASE WHEN field AND cells>=5 AND ma>1e-9 THEN (m-mm)/ma END AS zm FROM u, s, a),
 p AS (SELECT *, least(zv,zm) AS stress, CASE WHEN NOT field THEN 'NOT CROPLAND' WHEN least(zv,zm) IS NULL THEN 'INSUFFICIENT DATA' WHEN least(zv,zm)<=-1.8 THEN 'HIGH' WHEN least(zv,zm)<=-1.1 THEN 'WATCH' ELSE 'LOW' END AS priority FROM z)"""


@query(
    f"""WITH {PIXELS}, {QUEUE}, o AS (SELECT *, list_position(['HIGH','WATCH','LOW','INSUFFICIENT DATA','NOT CROPLAND'],priority) AS k FROM p)
 SELECT y, x, priority, round(stress,5) AS stress, CASE WHEN priority IN ('HIGH','WATCH') THEN CASE WHEN zv<=zm THEN 'NDVI ' ELSE 'NDMI ' END||'below the other fields' WHEN priority='LOW' THEN 'like the other fields' ELSE lower(priority) END AS reason FROM o"""
)
def scouting_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of fields with robust z-scores among all fields, priorities by rule and the reason in words.

    The two medians and two deviations over all cells are one row each, and join every cell."""
    nd = lambda a, b: F.median(F.try_divide((F.col(a) - F.col(b)).cast("double"), F.col(a) + F.col(b)))
    place = [F.floor(F.col("row") / 2).cast("int").alias("y"), F.floor(F.col("col") / 4).cast("int").alias("x")]
    c = pixels(spark, sf).groupBy(*place).agg((F.avg(F.col("class").isin(2, 5, 7).cast("int")) >= 0.1).alias("field"), nd("b4", "b3").alias("v"), nd("b2", "b1").alias("m"))
    fields = c.where("field")
    mid = fields.agg(F.median("v").alias("vm"), F.median("m").alias("mm"), F.count("*").alias("cells"))
    off = lambda x, y: 1.4826 * F.median(F.abs(F.col(x) - F.col(y)))
    spread = fields.join(F.broadcast(mid)).agg(off("v", "vm").alias("va"), off("m", "mm").alias("ma"))
    z = lambda x, y, s: F.when(F.col("field") & (F.col("cells") >= 5) & (F.col(s) > 1e-9), (F.col(x) - F.col(y)) / F.col(s))
    d = c.join(F.broadcast(mid)).join(F.broadcast(spread)).withColumns({"zv": z("v", "vm", "va"), "zm": z("m", "mm", "ma")})
    stress = F.least("zv", "zm")
    priority = F.when(~F.col("field"), "NOT CROPLAND").when(stress.isNull(), "INSUFFICIENT DATA").when(stress <= -1.8, "HIGH").when(stress <= -1.1, "WATCH").otherwise("LOW")
    low = F.concat(F.when(F.col("zv") <= F.col("zm"), "NDVI ").otherwise("NDMI "), F.lit("below the other fields"))
    reason = F.when(priority.isin("HIGH", "WATCH"), low).when(priority == "LOW", "like the other fields").otherwise(F.lower(priority))
    return d.select("y", "x", priority.alias("priority"), F.round(stress, 5).alias("stress"), reason.alias("reason"))
