"""Queries over pixel tables, corridors and change signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import science as S
from tidemark.operators import pixels as P
from tidemark.plans.registry import PIXELS, SCENES, query
from tidemark.plans.series_queries import r
from tidemark.sources.roles import pixels, scenes, table

ND = "(({a})-({b}))/nullif(CAST(({a})+({b}) AS DOUBLE),0)"


def nd(a: str, b: str):
    return S.normalized_difference(F.col(a).cast("double"), F.col(b).cast("double"))


@query(f"SELECT px, round({ND.format(a='b4', b='b3')},6) AS ndvi, round({ND.format(a='b4', b='b5')},6) AS ndmi FROM px", PIXELS)
def normalized_difference(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("px", F.round(nd("b4", "b3"), 6).alias("ndvi"), F.round(nd("b4", "b5"), 6).alias("ndmi"))


@query("SELECT px, CASE WHEN b1<>0 THEN (greatest(b1,1000)-1000)/10000.0 END AS with_offset, CASE WHEN b1<>0 THEN b1/10000.0 END AS plain, round(b2*2.75e-5-0.2,7) AS landsat FROM px".replace("b1/10000.0", "CAST(b1 AS DOUBLE)/10000").replace("(greatest(b1,1000)-1000)/10000.0", "CAST(greatest(b1,1000)-1000 AS DOUBLE)/10000"), PIXELS)
def reflectance_scale(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return p.select("px", S.reflectance(F.col("b1"), F.lit(-1000)).alias("with_offset"), S.reflectance(F.col("b1"), F.lit(0)).alias("plain"), F.round(F.col("b2") * 2.75e-5 - 0.2, 7).alias("landsat"))


@query("SELECT l_orderkey, l_linenumber, (CAST(l_partkey AS BIGINT) & 63)=0 AS clear, l_linenumber IN (4,5,6,7) AS kept FROM lineitem")
def qa_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    clear = F.coalesce(F.col("l_partkey"), F.lit(1)).bitwiseAND(63) == 0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clear.alias("clear"), F.coalesce("l_linenumber", F.lit(0)).isin(4, 5, 6, 7).alias("kept"))


@query("SELECT px, round(CASE WHEN b6>0 THEN 10*log10(b6/10000.0) END,5) AS db, round(4*b7/nullif(CAST(b7+b8 AS DOUBLE),0),6) AS rvi FROM px", PIXELS)
def db_convert(spark: SparkSession, sf: str) -> DataFrame:
    rvi = F.try_divide(4 * F.col("b7").cast("double"), F.col("b7") + F.col("b8"))
    return pixels(spark, sf).select("px", F.round(S.decibels(F.col("b6") / 10000.0), 5).alias("db"), F.round(rvi, 6).alias("rvi"))


@query(f"SELECT \"row\"//2 AS r2, col//2 AS c2, count(*) AS looks, round(max({ND.format(a='b4', b='b3')}),6) AS greenest, round(median(b5),2) AS swir FROM px GROUP BY 1,2", PIXELS)
def stack_greatest_median(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("ndvi", nd("b4", "b3"))
    g = p.groupBy(F.floor(F.col("row") / 2).cast("int").alias("r2"), F.floor(F.col("col") / 2).cast("int").alias("c2"))
    return g.agg(F.count("*").alias("looks"), F.round(F.max("ndvi"), 6).alias("greenest"), F.round(F.median("b5"), 2).alias("swir"))


SHARES = f"""v AS (SELECT *, {ND.format(a='b4', b='b3')} AS ndvi, {ND.format(a='b3', b='b5')} AS wet FROM px),
sh AS (SELECT class, count(*) AS n, 100*avg(CAST(wet>0.2 AS INT)) AS water, 100*avg(CAST(ndvi>=0.1 AND wet<=0.2 AS INT)) AS veg FROM v WHERE ndvi IS NOT NULL AND wet IS NOT NULL GROUP BY class)"""


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """Water, vegetation and other shares over valid pixels."""
    v = pixels(spark, sf).withColumn("ndvi", nd("b4", "b3")).withColumn("wet", nd("b3", "b5")).where("ndvi is not null and wet is not null")
    share = lambda c: 100 * F.avg(c.cast("int"))
    return v.groupBy("class").agg(F.count("*").alias("n"), share(F.col("wet") > 0.2).alias("water"), share((F.col("ndvi") >= 0.1) & (F.col("wet") <= 0.2)).alias("veg"))


@query(f"WITH {SHARES} SELECT class, n, round(water,4) AS water, round(veg,4) AS veg, round(100-water-veg,4) AS other FROM sh", PIXELS)
def composite_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(spark, sf).select("class", "n", r("water"), r("veg"), F.round(100 - F.col("water") - F.col("veg"), 4).alias("other"))


@query(
    f"""WITH {SHARES} SELECT class, CASE WHEN n<40 THEN 'poor' WHEN n<52 OR water>30 THEN 'fair' ELSE 'good' END AS quality,
 concat_ws('; ', CASE WHEN n<40 THEN 'few pixels' END, CASE WHEN n>=40 AND n<52 THEN 'some pixels missing' END, CASE WHEN water>30 THEN 'much water' END) AS reasons FROM sh""",
    PIXELS,
)
def composite_quality(spark: SparkSession, sf: str) -> DataFrame:
    n, water = F.col("n"), F.col("water")
    grade = F.when(n < 40, "poor").when((n < 52) | (water > 30), "fair").otherwise("good")
    why = F.concat_ws("; ", F.when(n < 40, "few pixels"), F.when((n >= 40) & (n < 52), "some pixels missing"), F.when(water > 30, "much water"))
    return shares(spark, sf).select("class", grade.alias("quality"), why.alias("reasons"))


@query(
    """WITH k AS (SELECT unnest([1,2,3,4,5,6,7,8,9]) AS class), h AS (SELECT l_linenumber AS class, count(*) AS n FROM lineitem WHERE l_linenumber>0 AND l_linenumber<>10 GROUP BY 1)
 SELECT CAST(k.class AS INT) AS class, coalesce(n,0) AS n, round(100.0*coalesce(n,0)/(SELECT sum(n) FROM h),2) AS pct FROM k LEFT JOIN h ON h.class=k.class"""
)
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """All classes, also those without a pixel."""
    h = table(spark, sf, "lineitem").where("l_linenumber > 0 and l_linenumber <> 10").groupBy(F.col("l_linenumber").alias("class")).agg(F.count("*").alias("n"))
    k = spark.range(1, 10).select(F.col("id").cast("int").alias("class")).join(h, "class", "left")
    n = F.coalesce("n", F.lit(0))
    return k.select("class", n.alias("n"), F.round(100.0 * n / F.sum("n").over(W.partitionBy(F.lit(1))), 2).alias("pct"))


@query(
    """WITH f AS (SELECT c_custkey, c_nationkey, min(year(o_orderdate)) AS first FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2), y AS (SELECT unnest(generate_series(1995,2001)) AS year)
 SELECT c_nationkey, CAST(year AS INT) AS year, round(100.0*count(*) FILTER (first<=year)/count(*),4) AS settled FROM f, y GROUP BY 1,2"""
)
def settlement_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """The share settled by each year; cells never settled stay in the denominator."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("first"))
    f = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left")
    y = f.select("c_nationkey", "first", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return y.groupBy("c_nationkey", "year").agg(F.round(100.0 * F.count_if(F.col("first") <= F.col("year")) / F.count("*"), 4).alias("settled"))


@query(
    """WITH a AS (SELECT o_custkey AS id, bool_or(year(o_orderdate)<=1997) AS was, bool_or(year(o_orderdate)>=1999) AS now FROM orders GROUP BY 1)
 SELECT count(*) FILTER (was) AS ever, count(*) FILTER (was AND NOT now) AS lost, count(*) FILTER (now AND NOT was) AS gained, round(100.0*count(*) FILTER (was AND NOT now)/nullif(count(*) FILTER (was),0),4) AS lost_pct FROM a"""
)
def transition_shares(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("o_orderdate")
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(y <= 1997).alias("was"), F.bool_or(y >= 1999).alias("now"))
    lost = F.count_if(F.col("was") & ~F.col("now"))
    return a.agg(F.count_if("was").alias("ever"), lost.alias("lost"), F.count_if(F.col("now") & ~F.col("was")).alias("gained"), F.round(F.try_divide(100.0 * lost, F.count_if("was")), 4).alias("lost_pct"))


@query(
    f"""SELECT "row"//4 AS r4, col//4 AS c4, count(*) AS n, round(100.0*count(*) FILTER (class=5)/count(*),4) AS crop_pct, round(CASE WHEN count(*) FILTER (b1>3000)>=4 THEN median({ND.format(a='b4', b='b3')}) FILTER (b1>3000) END,6) AS ndvi,
 round(avg("row"),3) AS cy, round(avg(col),3) AS cx FROM px GROUP BY 1,2""",
    PIXELS,
)
def zonal_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of 4 x 4 pixels; the median only where enough pixels are clear."""
    p = pixels(spark, sf).withColumn("ndvi", nd("b4", "b3"))
    clear = F.col("b1") > 3000
    g = p.groupBy(F.floor(F.col("row") / 4).cast("int").alias("r4"), F.floor(F.col("col") / 4).cast("int").alias("c4"))
    return g.agg(
        F.count("*").alias("n"),
        F.round(100.0 * F.count_if(F.col("class") == 5) / F.count("*"), 4).alias("crop_pct"),
        F.round(F.when(F.count_if(clear) >= 4, F.median(F.when(clear, F.col("ndvi")))), 6).alias("ndvi"),
        F.round(F.avg("row"), 3).alias("cy"),
        F.round(F.avg("col"), 3).alias("cx"),
    )


LINE = [(0.0, 0.0, 6.0, 9.0), (6.0, 9.0, 13.0, 10.0), (13.0, 10.0, 31.0, 16.0)]


def distance_sql(x: str, y: str) -> str:
    parts = []
    for x1, y1, x2, y2 in LINE:
        dx, dy = x2 - x1, y2 - y1
        t = f"least(greatest((({x}-{x1})*{dx}+({y}-{y1})*{dy})/{dx * dx + dy * dy},0.0),1.0)"
        parts.append(f"sqrt(pow({x}-({x1}+{t}*{dx}),2)+pow({y}-({y1}+{t}*{dy}),2))")
    return "least(" + ", ".join(parts) + ")"


def with_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel's distance to a line of three segments, in pixels."""
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    near = [S.segment_distance(x, y, *map(F.lit, s)) for s in LINE]
    return pixels(spark, sf).withColumn("d", F.least(*near))


DIST = f"ds AS (SELECT *, {distance_sql('CAST(col AS DOUBLE)', 'CAST(\"row\" AS DOUBLE)')} AS d FROM px)"


@query(f"WITH {DIST} SELECT px, round(d,6) AS d FROM ds", PIXELS)
def point_segment_distance(spark: SparkSession, sf: str) -> DataFrame:
    return with_distance(spark, sf).select("px", r("d", 6))


@query(f"WITH {DIST} SELECT CAST(b AS DOUBLE) AS buffer, count(*) AS pixels, round(100*avg(CAST(class=7 AS INT)),4) AS built_pct FROM ds, (SELECT unnest([1.0,2.5,5.0,10.0]) AS b) WHERE d<=b GROUP BY b", PIXELS)
def buffer_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Nested corridors from one distance column."""
    p = with_distance(spark, sf).select("d", "class", F.explode(F.array(*map(F.lit, (1.0, 2.5, 5.0, 10.0)))).alias("buffer")).where("d <= buffer")
    return p.groupBy("buffer").agg(F.count("*").alias("pixels"), F.round(100 * F.avg((F.col("class") == 7).cast("int")), 4).alias("built_pct"))


@query(f"WITH {DIST} SELECT CAST(floor(d/3)*3 AS INT) AS bin, count(*) AS n, round(avg(b4),4) AS nir, round(avg({ND.format(a='b4', b='b3')}),6) AS ndvi FROM ds GROUP BY 1", PIXELS)
def distance_bins(spark: SparkSession, sf: str) -> DataFrame:
    p = with_distance(spark, sf).withColumn("ndvi", nd("b4", "b3"))
    return p.groupBy((F.floor(F.col("d") / 3) * 3).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("b4"), 4).alias("nir"), F.round(F.avg("ndvi"), 6).alias("ndvi"))


CHANGE = f"""w AS (SELECT px, "row", col, class, {ND.format(a='b4', b='b3')} AS ref, {ND.format(a='b2', b='b1')} AS now, b5 AS swir FROM px)"""


def change(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("px", "row", "col", "class", nd("b4", "b3").alias("ref"), nd("b2", "b1").alias("now"), F.col("b5").alias("swir"))


@query(
    f"""WITH {CHANGE}, s AS (SELECT class, count(*) AS n, count(*) FILTER (ref IS NOT NULL AND now IS NOT NULL) AS seen, 100*avg(CAST(ref>=0.1 AS INT)) AS was, 100*avg(CAST(now>=0.1 AS INT)) AS is_ FROM w GROUP BY 1)
 SELECT class, seen, round(is_-was,4) AS change_pp, CASE WHEN 2*seen<n THEN 'NO DATA' WHEN is_-was<=-10 THEN 'DECLINE' WHEN is_-was>=10 THEN 'GAIN' ELSE 'STABLE' END AS flag FROM s""",
    PIXELS,
)
def two_window_change(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: 100 * F.avg((F.col(c) >= 0.1).cast("int"))
    s = change(spark, sf).groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("ref").isNotNull() & F.col("now").isNotNull()).alias("seen"), (share("now") - share("ref")).alias("pp"))
    pp = F.col("pp")
    flag = F.when(2 * F.col("seen") < F.col("n"), "NO DATA").when(pp <= -10, "DECLINE").when(pp >= 10, "GAIN").otherwise("STABLE")
    return s.select("class", "seen", F.round("pp", 4).alias("change_pp"), flag.alias("flag"))


def lost(spark: SparkSession, sf: str) -> DataFrame:
    return change(spark, sf).where("ref >= 0.05 and now < 0.03")


@query(f"WITH {CHANGE} SELECT px, class, swir<3500 AS wet FROM w WHERE ref>=0.05 AND now<0.03", PIXELS)
def lost_green_masks(spark: SparkSession, sf: str) -> DataFrame:
    return lost(spark, sf).select("px", "class", (F.col("swir") < 3500).alias("wet"))


PATCH = f"""{CHANGE}, m AS (SELECT px, "row" AS y, col AS x FROM w WHERE ref>=0.05 AND now<0.03),
e AS (SELECT a.px AS a, b.px AS b FROM m a JOIN m b ON abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1),
c AS (SELECT px AS px, px AS root FROM m UNION SELECT e.b, c.root FROM c JOIN e ON e.a=c.px), pt AS (SELECT px, min(root) AS patch FROM c GROUP BY px)"""


@query(f"WITH RECURSIVE {PATCH} SELECT patch, count(*) AS pixels FROM pt GROUP BY patch", PIXELS)
def connected_patches(spark: SparkSession, sf: str) -> DataFrame:
    return P.patches(lost(spark, sf).select("px", "row", "col")).groupBy("patch").agg(F.count("*").alias("pixels"))


@query(f"WITH RECURSIVE {PATCH} SELECT 'P'||lpad(CAST(row_number() OVER (ORDER BY n DESC, patch) AS VARCHAR),2,'0') AS id, patch, n AS pixels FROM (SELECT patch, count(*) AS n FROM pt GROUP BY 1 HAVING count(*)>=2) ORDER BY n DESC, patch LIMIT 60", PIXELS)
def topk_patches(spark: SparkSession, sf: str) -> DataFrame:
    """The sixty largest patches, numbered; the report's own limit, so the numbering window sees sixty rows."""
    p = P.patches(lost(spark, sf).select("px", "row", "col")).groupBy("patch").agg(F.count("*").alias("pixels")).where("pixels >= 2")
    top = p.orderBy(F.desc("pixels"), "patch").limit(60)
    n = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("pixels"), "patch"))
    return top.select(F.concat(F.lit("P"), F.lpad(n.cast("string"), 2, "0")).alias("id"), "patch", "pixels")


@query(
    f"""WITH {CHANGE} SELECT class, count(*) AS n, round(quantile_cont(ref,0.1),6) AS p10, round(quantile_cont(ref,0.5),6) AS p50, round(quantile_cont(ref,0.9),6) AS p90, round(100*avg(CAST(now<0.0 AS INT)),4) AS rule_pct FROM w GROUP BY 1""",
    PIXELS,
)
def class_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("ref", p), 6).alias(f"p{int(p * 100)}")
    return change(spark, sf).groupBy("class").agg(F.count("*").alias("n"), q(0.1), q(0.5), q(0.9), F.round(100 * F.avg((F.col("now") < 0).cast("int")), 4).alias("rule_pct"))


@query(f"WITH {CHANGE} SELECT round(1.0*count(*) FILTER (now<0 AND class=7)/nullif(count(*) FILTER (now<0),0),6) AS precision, round(1.0*count(*) FILTER (now<0 AND class=7)/nullif(count(*) FILTER (class=7),0),6) AS recall FROM w", PIXELS)
def rule_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    rule, truth = F.col("now") < 0, F.col("class") == 7
    hit = F.count_if(rule & truth).cast("double")
    return change(spark, sf).agg(F.round(F.try_divide(hit, F.count_if(rule)), 6).alias("precision"), F.round(F.try_divide(hit, F.count_if(truth)), 6).alias("recall"))


ROBUST = """md AS (SELECT orbit, median(cloud) AS med, count(*) AS n FROM sc GROUP BY 1), ma AS (SELECT s.orbit, 1.4826*median(abs(cloud-med)) AS mad FROM sc s JOIN md ON md.orbit=s.orbit GROUP BY 1),
z AS (SELECT s.*, CASE WHEN n>=5 AND mad>1e-9 THEN (cloud-med)/mad END AS z FROM sc s JOIN md ON md.orbit=s.orbit JOIN ma ON ma.orbit=s.orbit)"""


def robust(spark: SparkSession, sf: str) -> DataFrame:
    """robust z-scores: two medians a group, joined back."""
    s = scenes(spark, sf)
    med = s.groupBy("orbit").agg(F.median("cloud").alias("med"), F.count("*").alias("n"))
    d = s.join(med, "orbit")
    mad = d.groupBy("orbit").agg((1.4826 * F.median(F.abs(F.col("cloud") - F.col("med")))).alias("mad"))
    z = F.when((F.col("n") >= 5) & (F.col("mad") > 1e-9), (F.col("cloud") - F.col("med")) / F.col("mad"))
    return d.join(mad, "orbit").withColumn("z", z)


@query(f"WITH {ROBUST} SELECT scene, round(z,5) AS z FROM z", SCENES)
def robust_z(spark: SparkSession, sf: str) -> DataFrame:
    return robust(spark, sf).select("scene", r("z", 5))


SCORE = "least(greatest(50+12*(-da*0.55-db*0.45),0.0),100.0)"
MOVES = "mv AS (SELECT aoi, scene, (cloud-lag(cloud) OVER w)/100 AS da, (lag(cloud) OVER w-lag(cloud,2) OVER w)/100 AS db FROM sc WINDOW w AS (PARTITION BY aoi ORDER BY ts, scene))"


def moves(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("aoi").orderBy("ts", "scene")
    c, one, two = F.col("cloud"), F.lag("cloud").over(w), F.lag("cloud", 2).over(w)
    return scenes(spark, sf).select("aoi", "scene", "ts", ((c - one) / 100).alias("da"), ((one - two) / 100).alias("db"))


@query(f"WITH {MOVES} SELECT scene, round({SCORE.replace('-da*', '-da*100*').replace('-db*', '-db*100*')},4) AS score FROM mv WHERE db IS NOT NULL", SCENES)
def anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    raw = -F.col("da") * 100 * 0.55 - F.col("db") * 100 * 0.45
    return moves(spark, sf).where("db is not null").select("scene", F.round(S.clamp(50 + 12 * raw, 0.0, 100.0), 4).alias("score"))


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY ts DESC, scene DESC) AS k, cloud/100 - lag(cloud/100) OVER (PARTITION BY aoi ORDER BY ts, scene) AS d FROM sc),
 h AS (SELECT aoi, median(d) AS med, count(d) AS n FROM s WHERE k>1 GROUP BY 1), m AS (SELECT s.aoi, 1.4826*median(abs(d-med)) AS mad FROM s JOIN h ON h.aoi=s.aoi WHERE k>1 AND d IS NOT NULL GROUP BY 1),
 z AS (SELECT s.aoi, s.d, CASE WHEN n>=5 AND mad>1e-9 THEN (s.d-med)/mad END AS z FROM s JOIN h ON h.aoi=s.aoi LEFT JOIN m ON m.aoi=s.aoi WHERE s.k=1 AND s.d IS NOT NULL)
 SELECT aoi, round(d,4) AS change, round(z,4) AS z, CASE WHEN d<=-0.05 THEN CASE WHEN z<=-1 THEN 'UNUSUAL DECLINE' ELSE 'DECLINE' END WHEN d>=0.05 THEN 'GREENING' ELSE 'STABLE' END AS label FROM z""",
    SCENES,
)
def change_signal(spark: SparkSession, sf: str) -> DataFrame:
    """the latest move of every area against its own earlier moves."""
    w = W.partitionBy("aoi")
    s = scenes(spark, sf).withColumn("d", F.col("cloud") / 100 - F.lag(F.col("cloud") / 100).over(w.orderBy("ts", "scene")))
    s = s.withColumn("k", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("scene"))))
    old = s.where("k > 1 and d is not null")
    h = old.groupBy("aoi").agg(F.median("d").alias("med"), F.count("*").alias("n"))
    mad = old.join(h, "aoi").groupBy("aoi").agg((1.4826 * F.median(F.abs(F.col("d") - F.col("med")))).alias("mad"))
    z = F.when((F.col("n") >= 5) & (F.col("mad") > 1e-9), (F.col("d") - F.col("med")) / F.col("mad"))
    t = s.where("k = 1 and d is not null").join(h, "aoi", "left").join(mad, "aoi", "left").withColumn("z", z)
    label = F.when(F.col("d") <= -0.05, F.when(F.col("z") <= -1, "UNUSUAL DECLINE").otherwise("DECLINE")).when(F.col("d") >= 0.05, "GREENING").otherwise("STABLE")
    return t.select("aoi", F.round("d", 4).alias("change"), r("z"), label.alias("label"))


@query(
    """WITH x AS (SELECT p_partkey AS id, p_size/50.0-0.3 AS ndmi, p_retailprice/30 AS rain, CASE WHEN p_partkey%5<>0 THEN p_size*1.7 END AS et0 FROM part)
 SELECT id, round(100*(0.6*least(greatest((0.5-ndmi)/0.7,0),1)+0.4*CASE WHEN et0 IS NOT NULL THEN least(greatest((et0-rain)/60,0),1) ELSE least(greatest(1-rain/50,0),1) END),6) AS stress FROM x"""
)
def water_stress(spark: SparkSession, sf: str) -> DataFrame:
    rain, et0 = F.col("p_retailprice") / 30, F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * 1.7)
    canopy = S.clamp((0.5 - (F.col("p_size") / 50.0 - 0.3)) / 0.7)
    balance = F.when(et0.isNotNull(), S.clamp((et0 - rain) / 60)).otherwise(S.clamp(1 - rain / 50))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(100 * (0.6 * canopy + 0.4 * balance), 6).alias("stress"))


@query(
    f"""WITH {MOVES}, d AS (SELECT scene, CASE WHEN da IS NULL THEN NULL WHEN da<=-0.05 THEN 'down' WHEN da>=0.05 THEN 'up' ELSE 'flat' END AS o, CASE WHEN db IS NULL THEN NULL WHEN db*10<=-1 THEN 'down' WHEN db*10>=1 THEN 'up' ELSE 'flat' END AS s FROM mv)
 SELECT scene, CASE WHEN o IS NULL OR s IS NULL THEN 'INCOMPLETE' WHEN o=s THEN 'AGREE '||o ELSE 'DISAGREE' END AS label FROM d""",
    SCENES,
)
def fusion_label(spark: SparkSession, sf: str) -> DataFrame:
    way = lambda c, t: F.when(c.isNotNull(), F.when(c <= -t, "down").when(c >= t, "up").otherwise("flat"))
    d = moves(spark, sf).select("scene", way(F.col("da"), 0.05).alias("o"), way(F.col("db") * 10, 1.0).alias("s"))
    label = F.when(F.col("o").isNull() | F.col("s").isNull(), "INCOMPLETE").when(F.col("o") == F.col("s"), F.concat(F.lit("AGREE "), "o")).otherwise("DISAGREE")
    return d.select("scene", label.alias("label"))


@query(
    f"""WITH {ROBUST}, p AS (SELECT scene, aoi, orbit, z, CASE WHEN orbit='error' THEN 'NOT CROPLAND' WHEN cloud>95 THEN 'INSUFFICIENT DATA' WHEN z<=-1.2 THEN 'HIGH' WHEN z<=-0.9 THEN 'WATCH' ELSE 'LOW' END AS priority FROM z),
 q AS (SELECT *, list_position(['HIGH','WATCH','LOW','INSUFFICIENT DATA','NOT CROPLAND'], priority) AS o FROM p)
 SELECT aoi, orbit, priority, scene, CAST(row_number() OVER (PARTITION BY aoi ORDER BY o, round(z,9) ASC NULLS LAST, scene) AS INT) AS place FROM q""",
    SCENES,
)
def scouting_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based priorities and each area's queue in the order of the categories."""
    z = F.col("z")
    prio = F.when(F.col("orbit") == "error", "NOT CROPLAND").when(F.col("cloud") > 95, "INSUFFICIENT DATA").when(z <= -1.2, "HIGH").when(z <= -0.9, "WATCH").otherwise("LOW")
    q = robust(spark, sf).withColumn("priority", prio)
    order = F.array_position(F.array(*map(F.lit, ("HIGH", "WATCH", "LOW", "INSUFFICIENT DATA", "NOT CROPLAND"))), F.col("priority"))
    place = F.row_number().over(W.partitionBy("aoi").orderBy(order, F.round(z, 9).asc_nulls_last(), "scene"))
    return q.select("aoi", "orbit", "priority", "scene", place.alias("place"))


@query("WITH k AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-NONE']) AS priority) SELECT priority, count(o_orderkey) AS n FROM k LEFT JOIN orders ON o_orderpriority=priority GROUP BY 1")
def priority_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    k = spark.createDataFrame([(p,) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "priority string")
    return k.join(n, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH {MOVES}, a AS (SELECT aoi, avg(CAST(da<=-0.3 AS INT))*100-avg(CAST(db<=-0.3 AS INT))*100 AS pp FROM mv GROUP BY 1)
 SELECT aoi, round(pp,4) AS change_pp, CASE WHEN pp IS NULL THEN 'NO DATA' WHEN pp>=3 THEN 'EXPANSION' WHEN pp<=-3 THEN 'RECESSION' ELSE 'STABLE' END AS flag FROM a""",
    SCENES,
)
def water_watch_flag(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.avg((F.col(c) <= -0.3).cast("int")) * 100
    a = moves(spark, sf).groupBy("aoi").agg((share("da") - share("db")).alias("pp"))
    pp = F.col("pp")
    return a.select("aoi", F.round(pp, 4).alias("change_pp"), F.when(pp.isNull(), "NO DATA").when(pp >= 3, "EXPANSION").when(pp <= -3, "RECESSION").otherwise("STABLE").alias("flag"))


@query(
    """WITH y AS (SELECT c_nationkey AS id, count(*) FILTER (year(o_orderdate)=1996) AS a, count(*) FILTER (year(o_orderdate)=2000) AS b, avg(o_totalprice) FILTER (year(o_orderdate)=1996) AS pa, avg(o_totalprice) FILTER (year(o_orderdate)=2000) AS pb FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1),
 f AS (SELECT id, a, b, CASE WHEN 100.0*(b-a)/nullif(a,0)>3 THEN 'GROWTH' END AS g, CASE WHEN 100*(pb-pa)/nullif(pa,0)<=-3 THEN 'LOSS' END AS l FROM y)
 SELECT id, concat_ws(', ', g, l) AS flags, CASE WHEN a+b=0 THEN 'NO DATA' WHEN g IS NOT NULL AND l IS NOT NULL THEN 'HIGH' WHEN g IS NOT NULL OR l IS NOT NULL THEN 'WATCH' ELSE 'STABLE' END AS level FROM f"""
)
def assess_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Two ends of a period, flags of several kinds, and a level by how many kinds there are."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    y, p = F.year("o_orderdate"), F.col("o_totalprice")
    t = o.groupBy(F.col("c_nationkey").alias("id")).agg(F.count_if(y == 1996).alias("a"), F.count_if(y == 2000).alias("b"), F.avg(F.when(y == 1996, p)).alias("pa"), F.avg(F.when(y == 2000, p)).alias("pb"))
    g = F.when(F.try_divide(100.0 * (F.col("b") - F.col("a")), F.col("a")) > 3, "GROWTH")
    lo = F.when(F.try_divide(100 * (F.col("pb") - F.col("pa")), F.col("pa")) <= -3, "LOSS")
    kinds = F.size(F.array_compact(F.array(g, lo)))
    level = F.when(F.col("a") + F.col("b") == 0, "NO DATA").when(kinds >= 2, "HIGH").when(kinds == 1, "WATCH").otherwise("STABLE")
    return t.select("id", F.concat_ws(", ", g, lo).alias("flags"), level.alias("level"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 1980+p_size%40 AS a, 1990+(p_partkey*7)%40 AS b FROM part), q AS (SELECT id, least(a,b) AS a, greatest(a,b) AS b FROM p)
 SELECT id, CASE WHEN greatest(a,1985)<least(b,2015) THEN CAST(greatest(a,1985) AS VARCHAR)||'-'||CAST(least(b,2015) AS VARCHAR) END AS settled, CASE WHEN greatest(a,2017)<least(b,2025) THEN CAST(greatest(a,2017) AS VARCHAR)||'-'||CAST(least(b,2025) AS VARCHAR) END AS built FROM q"""
)
def built_periods_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a period that two products cover."""
    x, y = 1980 + F.col("p_size") % 40, 1990 + (F.col("p_partkey") * 7) % 40
    a, b = F.least(x, y), F.greatest(x, y)

    def part(lo: int, hi: int):
        s, e = F.greatest(a, F.lit(lo)), F.least(b, F.lit(hi))
        return F.when(s < e, F.concat_ws("-", s, e))

    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), part(1985, 2015).alias("settled"), part(2017, 2025).alias("built"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 1990+p_size%10 AS a, 2002+p_size%9 AS b FROM part)
 SELECT id, array_to_string(list_filter([a-1,a,a+1], lambda y: y>=1990 AND y<(a+b)/2.0),',') AS early, array_to_string(list_filter([b-1,b,b+1], lambda y: y<=2009 AND y>(a+b)/2.0),',') AS late FROM p"""
)
def season_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = 1990 + F.col("p_size") % 10, 2002 + F.col("p_size") % 9
    mid = (a + b) / 2.0
    text = lambda x: F.concat_ws(",", x.cast("array<string>"))
    early = F.filter(F.sequence(a - 1, a + 1), lambda y: (y >= 1990) & (y < mid))
    late = F.filter(F.sequence(b - 1, b + 1), lambda y: (y <= 2009) & (y > mid))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text(early).alias("early"), text(late).alias("late"))


@query(
    """WITH t AS (SELECT c_custkey AS id, c_acctbal/100 AS x, c_custkey%97 AS y, 1+c_nationkey AS w, 2+c_custkey%11 AS h FROM customer) SELECT id, round(w*h+w*(h/2.0)/2,4) AS area FROM t"""
)
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    """A gabled outline at every customer's place: a box of their own size under a triangle half as high."""
    x, y = F.col("c_acctbal") / 100, (F.col("c_custkey") % 97).cast("double")
    w, h = (1 + F.col("c_nationkey")).cast("double"), (2 + F.col("c_custkey") % 11).cast("double")
    area = S.shoelace(F.array(x, x + w, x + w, x + w / 2, x), F.array(y, y, y + h, y + 1.5 * h, y + h))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(area, 4).alias("area"))


@query(f"WITH {PIXELS}, k AS (SELECT class, median(b1) AS b1, median(b2) AS b2, median(b3) AS b3, median(b4) AS b4 FROM px GROUP BY 1 HAVING count(*)>=10) SELECT class, b1, b2, b3, b4 FROM k")
def endmember_medians(spark: SparkSession, sf: str) -> DataFrame:
    """A class's spectrum is the median of each band; classes of few pixels have none."""
    k = pixels(spark, sf).groupBy("class").agg(F.count("*").alias("n"), *[F.median(f"b{i}").alias(f"b{i}") for i in range(1, 5)])
    return k.where("n >= 10").drop("n")


@query()
def unmix_fcls(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of three fixed spectra in every pixel."""
    ends = np.array([[2000.0, 2500, 3000, 7000], [5000, 5200, 5600, 6000], [4000, 3500, 2500, 1500]]) / 10000
    p = pixels(spark, sf).select("px", *[(F.col(f"b{i}") / 10000.0).alias(f"b{i}") for i in range(1, 5)])
    out = P.unmix(p, "px", ["b1", "b2", "b3", "b4"], ends, delta=10.0)
    return out.select("px", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(3)])


@query()
def scouting_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of 4 x 4 pixels, ranked by how easily they are isolated among the cells of their block."""
    p = pixels(spark, sf).withColumn("ndvi", nd("b4", "b3")).withColumn("ndmi", nd("b4", "b5"))
    block, cell = F.floor(F.col("row") / 64).cast("int"), (F.floor(F.col("row") / 4) * 8 + F.floor(F.col("col") / 4)).cast("long")
    cells = p.groupBy(block.alias("block"), cell.alias("cell")).agg(F.median("ndvi").alias("ndvi"), F.median("ndmi").alias("ndmi"))
    out = P.isolation_forest(cells, "block", "cell", ["ndvi", "ndmi"])
    return out.select("block", "cell", F.round("strength", 6).alias("strength"), "outlier")
