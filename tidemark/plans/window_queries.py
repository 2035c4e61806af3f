"""Queries with window functions, scene choice, as-of joins, feature building and forecast scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as O
from tidemark.plans.registry import FLOW, RAIN, SCENES, query
from tidemark.plans.series_queries import r
from tidemark.sources.roles import daily_flow, daily_rain, scenes, table


def seg():
    """A segment's days in order."""
    return W.partitionBy("segment").orderBy("date")


@query("SELECT segment, date, round(CASE WHEN count(*) OVER w=7 THEN avg(flow) OVER w END,7) AS mean7 FROM flow WINDOW w AS (PARTITION BY segment ORDER BY date ROWS 6 PRECEDING)", FLOW)
def window_7day_low(spark: SparkSession, sf: str) -> DataFrame:
    return daily_flow(spark, sf).select("segment", "date", F.round(O.full(F.avg("flow"), "flow", seg().rowsBetween(-6, 0), 7), 7).alias("mean7"))


@query("SELECT cell, date, round(coalesce(CASE WHEN count(*) OVER w=5 THEN sum(rain) OVER w END,0),3) AS before FROM rain WINDOW w AS (PARTITION BY cell ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", RAIN)
def antecedent_5day(spark: SparkSession, sf: str) -> DataFrame:
    w = O.by_day("cell").rowsBetween(-5, -1)
    return daily_rain(spark, sf).select("cell", "date", F.round(F.coalesce(O.full(F.sum("rain"), "rain", w, 5), F.lit(0.0)), 3).alias("before"))


@query(
    """SELECT aoi, scene, round(cloud-lag(cloud) OVER w,4) AS d_cloud, date_diff('day', lag(day) OVER w, day) AS gap FROM sc WINDOW w AS (PARTITION BY aoi ORDER BY ts, scene)""",
    SCENES,
)
def first_difference(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("aoi").orderBy("ts", "scene")
    gap = F.datediff("day", F.lag("day").over(w)).cast("long")
    return scenes(spark, sf).select("aoi", "scene", F.round(F.col("cloud") - F.lag("cloud").over(w), 4).alias("d_cloud"), gap.alias("gap"))


@query(
    """WITH l AS (SELECT *, ln(1+flow) AS q FROM flow) SELECT segment, date, round(lag(q,1) OVER w,5) AS lag1, round(lag(q,7) OVER w,5) AS lag7, round(lag(q,30) OVER w,5) AS lag30,
 round(q-lag(q,3) OVER w,5) AS trend3, round(CASE WHEN count(*) OVER a=7 THEN max(q) OVER a END,5) AS max7, round(CASE WHEN count(*) OVER b=30 THEN min(q) OVER b END,5) AS min30 FROM l
 WINDOW w AS (PARTITION BY segment ORDER BY date), a AS (PARTITION BY segment ORDER BY date ROWS 6 PRECEDING), b AS (PARTITION BY segment ORDER BY date ROWS 29 PRECEDING)""",
    FLOW,
)
def feature_lags(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_flow(spark, sf).withColumn("q", F.log1p("flow"))
    lag = lambda k: F.round(F.lag("q", k).over(seg()), 5).alias(f"lag{k}")
    wide = lambda f, k: O.full(f("q"), "q", seg().rowsBetween(1 - k, 0), k)
    return d.select(
        "segment", "date", lag(1), lag(7), lag(30), F.round(F.col("q") - F.lag("q", 3).over(seg()), 5).alias("trend3"),
        F.round(wide(F.max, 7), 5).alias("max7"), F.round(wide(F.min, 30), 5).alias("min30"),
    )


@query(
    "SELECT cell, date, "
    + ", ".join(f"round(CASE WHEN count(*) OVER w{k}={k} THEN sum(rain) OVER w{k} END,3) AS sum{k}" for k in (1, 3, 7, 14, 30, 60, 90))
    + " FROM rain WINDOW "
    + ", ".join(f"w{k} AS (PARTITION BY cell ORDER BY date ROWS {k - 1} PRECEDING)" for k in (1, 3, 7, 14, 30, 60, 90)),
    RAIN,
)
def feature_rolling(spark: SparkSession, sf: str) -> DataFrame:
    w = O.by_day("cell")
    cols = [F.round(O.full(F.sum("rain"), "rain", w.rowsBetween(1 - k, 0), k), 3).alias(f"sum{k}") for k in (1, 3, 7, 14, 30, 60, 90)]
    return daily_rain(spark, sf).select("cell", "date", *cols)


@query(
    "WITH RECURSIVE n AS (SELECT cell, date, rain, row_number() OVER (PARTITION BY cell ORDER BY date) AS i FROM rain), s AS (SELECT cell, date, i, rain AS v3, rain AS v10, rain AS v30, rain AS v90 FROM n WHERE i=1 UNION ALL SELECT n.cell, n.date, n.i, "
    + ", ".join(f"pow(2,-1/{h}.0)*s.v{h}+(1-pow(2,-1/{h}.0))*n.rain" for h in (3, 10, 30, 90))
    + " FROM s JOIN n ON n.cell=s.cell AND n.i=s.i+1) SELECT cell, date, round(v3,4) AS wet3, round(v10,4) AS wet10, round(v30,4) AS wet30, round(v90,4) AS wet90 FROM s",
    RAIN,
)
def feature_ewm(spark: SparkSession, sf: str) -> DataFrame:
    """Wetness with four half-lives, in days."""
    d = daily_rain(spark, sf)
    for h in (3, 10, 30, 90):
        d = O.ewm(d, "cell", "rain", float(h)).withColumnRenamed("ewm", f"wet{h}")
    return d.select("cell", "date", *[F.round(f"wet{h}", 4).alias(f"wet{h}") for h in (3, 10, 30, 90)])


@query(
    """SELECT cell, date, round(CASE WHEN count(*) OVER a=7 THEN sum(rain) OVER a END,3) AS next7, round(CASE WHEN count(*) OVER b=3 THEN sum(rain) OVER b END,3) AS last3 FROM rain
 WINDOW a AS (PARTITION BY cell ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), b AS (PARTITION BY cell ORDER BY date ROWS BETWEEN 5 FOLLOWING AND 7 FOLLOWING)""",
    RAIN,
)
def future_window(spark: SparkSession, sf: str) -> DataFrame:
    w, s = O.by_day("cell"), F.sum("rain")
    return daily_rain(spark, sf).select("cell", "date", F.round(O.full(s, "rain", w.rowsBetween(1, 7), 7), 3).alias("next7"), F.round(O.full(s, "rain", w.rowsBetween(5, 7), 3), 3).alias("last3"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date) AS i, count(*) OVER (PARTITION BY cell) AS k FROM rain)
 SELECT cell, date, CAST(least(coalesce(i-max(CASE WHEN rain>=90 THEN i END) OVER (PARTITION BY cell ORDER BY date),k),365) AS BIGINT) AS days FROM n""",
    RAIN,
)
def days_since_flag(spark: SparkSession, sf: str) -> DataFrame:
    return daily_rain(spark, sf).select("cell", "date", O.days_since(F.col("rain") >= 90, "cell").cast("long").alias("days"))


@query(
    """WITH f AS (SELECT DISTINCT date FROM flow), g AS (SELECT date, year(date)=1998 AS val, year(date)=2000 AS test FROM f),
 h AS (SELECT *, max(CAST(val OR test AS INT)) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)=1 AS near FROM g)
 SELECT date, CASE WHEN test THEN 'test' WHEN val THEN 'val' WHEN near THEN 'gap' ELSE 'train' END AS part FROM h""",
    FLOW,
)
def blocked_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-year validation and test blocks with 30-day gaps; the calendar is one row a day, so one window is small."""
    d = daily_flow(spark, sf).select("date").distinct()
    val, test = F.year("date") == 1998, F.year("date") == 2000
    near = F.max((val | test).cast("int")).over(W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-30, 30)) == 1
    return d.select("date", F.when(test, "test").when(val, "val").when(near, "gap").otherwise("train").alias("part"))


@query(
    """WITH y AS (SELECT DISTINCT CAST(year(date) AS INT) AS year FROM flow), f AS (SELECT CAST(unnest(generate_series(1998,2001,2)) AS INT) AS first)
 SELECT first, CAST(count(*) FILTER (year<first) AS INT) AS train_years, CAST(max(year) FILTER (year<first) AS INT) AS train_to, array_to_string(list(year ORDER BY year) FILTER (year>=first AND year<first+2),',') AS test_years FROM f, y GROUP BY first""",
    FLOW,
)
def rolling_origin(spark: SparkSession, sf: str) -> DataFrame:
    years = daily_flow(spark, sf).groupBy(F.year("date").alias("year")).count().select("year", F.explode(F.sequence(F.lit(1998), F.lit(2001), F.lit(2))).alias("first"))
    y, f = F.col("year"), F.col("first")
    test = F.array_sort(F.collect_set(F.when((y >= f) & (y < f + 2), y)))
    return years.groupBy("first").agg(F.count_if(y < f).cast("int").alias("train_years"), F.max(F.when(y < f, y)).alias("train_to"), F.concat_ws(",", test.cast("array<string>")).alias("test_years"))


@query(
    """SELECT cell, date, round(CASE WHEN count(*) OVER w=30 THEN list_sum(list_transform(list(rain) OVER w, lambda x, i: x*i)) END,3) AS ramp FROM rain WINDOW w AS (PARTITION BY cell ORDER BY date ROWS 29 PRECEDING)""",
    RAIN,
)
def sliding_window_array(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's window of 30 days as an array, folded with its positions."""
    w = O.by_day("cell").rowsBetween(-29, 0)
    d = daily_rain(spark, sf).withColumn("x", F.collect_list("rain").over(w))
    ramp = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return d.select("cell", "date", F.round(F.when(F.size("x") == 30, ramp), 3).alias("ramp"))


@query(
    """WITH m AS (SELECT segment, CAST(date_trunc('month',date) AS DATE) AS month, sum(flow) AS v FROM flow GROUP BY 1,2)
 SELECT segment, month, round(CASE WHEN count(v) OVER w>=2 THEN quantile_cont(v,0.5) OVER w END,4) AS med3 FROM m WINDOW w AS (PARTITION BY segment ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    FLOW,
)
def season_median3(spark: SparkSession, sf: str) -> DataFrame:
    m = daily_flow(spark, sf).groupBy("segment", F.trunc("date", "MM").alias("month")).agg(F.sum("flow").alias("v"))
    w = W.partitionBy("segment").orderBy("month").rowsBetween(-1, 1)
    return m.select("segment", "month", F.round(F.when(F.count("v").over(w) >= 2, F.percentile("v", 0.5).over(w)), 4).alias("med3"))


@query(
    """WITH d AS (SELECT cell, date, CASE WHEN day(date)%5=0 THEN rain END AS x FROM rain),
 f AS (SELECT cell, date, last_value(x IGNORE NULLS) OVER (PARTITION BY cell ORDER BY date) AS a, first_value(x IGNORE NULLS) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM d)
 SELECT cell, date, round(coalesce(a,b),3) AS filled FROM f""",
    RAIN,
)
def ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    w = O.by_day("cell")
    d = daily_rain(spark, sf).withColumn("x", F.when(F.dayofmonth("date") % 5 == 0, F.col("rain")))
    ahead = F.last("x", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    back = F.first("x", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return d.select("cell", "date", F.round(F.coalesce(ahead, back), 3).alias("filled"))


@query(
    "SELECT aoi, day, scene, cloud FROM (SELECT *, row_number() OVER (PARTITION BY aoi, day ORDER BY CASE WHEN orbit='view' THEN 0 ELSE 1 END, cloud, ts, scene) AS k FROM sc) WHERE k=1",
    SCENES,
)
def scene_one_per_day(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("aoi", "day").orderBy((F.col("orbit") != "view").cast("int"), "cloud", "ts", "scene")
    return scenes(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("aoi", "day", "scene", "cloud")


@query(
    """WITH b AS (SELECT *, ntile(8) OVER (PARTITION BY aoi ORDER BY ts, scene) AS bin FROM sc)
 SELECT aoi, CAST(bin AS INT) AS bin, scene, cloud FROM (SELECT *, row_number() OVER (PARTITION BY aoi, bin ORDER BY cloud, ts, scene) AS k FROM b) WHERE k=1""",
    SCENES,
)
def scene_ntile_thin(spark: SparkSession, sf: str) -> DataFrame:
    b = scenes(spark, sf).withColumn("bin", F.ntile(8).over(W.partitionBy("aoi").orderBy("ts", "scene")))
    w = W.partitionBy("aoi", "bin").orderBy("cloud", "ts", "scene")
    return b.withColumn("k", F.row_number().over(w)).where("k = 1").select("aoi", "bin", "scene", "cloud")


@query(
    """WITH t AS (SELECT *, CASE WHEN cloud<=10 THEN 1 WHEN cloud<=30 THEN 2 WHEN cloud<=70 THEN 3 END AS tier, orbit='purchase' AS peak FROM sc WHERE cloud<=70),
 n AS (SELECT aoi, tier, count(*) AS n, count(*) FILTER (peak) AS p FROM t GROUP BY 1,2),
 c AS (SELECT *, coalesce(sum(n) OVER w,0) AS n0, coalesce(sum(p) OVER w,0) AS p0 FROM n WINDOW w AS (PARTITION BY aoi ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT t.aoi, t.scene, t.tier FROM t JOIN c ON c.aoi=t.aoi AND c.tier=t.tier WHERE n0<3 OR p0<1""",
    SCENES,
)
def scene_tiered_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers are added until three scenes, one of them in the peak, are there."""
    c = F.col("cloud")
    t = scenes(spark, sf).where(c <= 70).withColumn("tier", F.when(c <= 10, 1).when(c <= 30, 2).otherwise(3))
    n = t.groupBy("aoi", "tier").agg(F.count("*").alias("n"), F.count_if(F.col("orbit") == "purchase").alias("p"))
    w = W.partitionBy("aoi").orderBy("tier").rowsBetween(W.unboundedPreceding, -1)
    open_ = n.withColumn("n0", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("p0", F.coalesce(F.sum("p").over(w), F.lit(0))).where("n0 < 3 or p0 < 1")
    return t.join(open_.select("aoi", "tier"), ["aoi", "tier"]).select("aoi", "scene", "tier")


@query(
    """SELECT aoi, scene, prev FROM (SELECT a.aoi, a.scene, b.scene AS prev, row_number() OVER (PARTITION BY a.scene ORDER BY b.ts DESC, b.scene) AS k FROM sc a JOIN sc b ON a.aoi=b.aoi AND b.cloud<=35
 AND date_diff('day',b.day,a.day) BETWEEN 4 AND 20 WHERE a.cloud<=35) WHERE k=1""",
    SCENES,
)
def latest_previous_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The newest qualifying scene 4 to 20 days before.

    Every scene is dealt to the five-day buckets it can be the answer for, so the range join is an equi-join.
    """
    s = scenes(spark, sf).where("cloud <= 35").withColumn("n", F.unix_date("day"))
    a = s.select("aoi", "scene", "n", F.floor(F.col("n") / 5).alias("bucket"))
    b = s.select("aoi", F.col("scene").alias("prev"), F.col("ts").alias("prev_ts"), F.col("n").alias("m"))
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("m") + 4) / 5), F.floor((F.col("m") + 20) / 5))))
    hit = a.join(b, ["aoi", "bucket"]).where((F.col("n") - F.col("m")).between(4, 20))
    best = hit.groupBy("aoi", "scene").agg(F.max_by("prev", F.struct("prev_ts", -F.col("prev"))).alias("prev"))
    return best


@query(
    """WITH p AS (SELECT *, lag(scene) OVER w AS prev, date_diff('day', lag(day) OVER w, day) AS gap FROM sc WINDOW w AS (PARTITION BY aoi, orbit ORDER BY ts, scene)),
 l AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY ts DESC, scene DESC) AS k FROM p WHERE gap BETWEEN 1 AND 60) SELECT aoi, orbit, scene, prev, gap FROM l WHERE k=1""",
    SCENES,
)
def same_orbit_pair(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("aoi", "orbit").orderBy("ts", "scene")
    p = scenes(spark, sf).withColumn("prev", F.lag("scene").over(w)).withColumn("gap", F.datediff("day", F.lag("day").over(w)).cast("long")).where("gap between 1 and 60")
    newest = W.partitionBy("aoi").orderBy(F.desc("ts"), F.desc("scene"))
    return p.withColumn("k", F.row_number().over(newest)).where("k = 1").select("aoi", "orbit", "scene", "prev", "gap")


@query(
    """SELECT seg, year, season, id, total FROM (SELECT o_orderpriority AS seg, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN month(o_orderdate) IN (4,5,6) THEN 'pre' ELSE 'post' END AS season, o_orderkey AS id, round(o_totalprice,2) AS total,
 row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate), CASE WHEN month(o_orderdate) IN (4,5,6) THEN 'pre' ELSE 'post' END ORDER BY CASE month(o_orderdate) WHEN 5 THEN 0 WHEN 11 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS k
 FROM orders WHERE month(o_orderdate) IN (4,5,6,10,11,12)) WHERE k=1"""
)
def best_scene_per_season(spark: SparkSession, sf: str) -> DataFrame:
    m = F.month("o_orderdate")
    o = table(spark, sf, "orders").where(m.isin(4, 5, 6, 10, 11, 12))
    o = o.select(F.col("o_orderpriority").alias("seg"), F.year("o_orderdate").alias("year"), F.when(m < 7, "pre").otherwise("post").alias("season"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("total"), (~m.isin(5, 11)).cast("int").alias("off"), "o_totalprice")
    w = W.partitionBy("seg", "year", "season").orderBy("off", F.desc("o_totalprice"), "id")
    return o.withColumn("k", F.row_number().over(w)).where("k = 1").select("seg", "year", "season", "id", "total")


@query(
    """SELECT orbit, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT strftime(day,'%Y-%m-%d'))),1,8),', ') AS days FROM sc WHERE cloud>70 GROUP BY orbit""",
    SCENES,
)
def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    days = F.array_join(F.slice(F.array_sort(F.collect_set(F.date_format("day", "yyyy-MM-dd"))), 1, 8), ", ")
    return scenes(spark, sf).where("cloud > 70").groupBy("orbit").agg(F.count("*").alias("n"), days.alias("days"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def missing_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp '2000-01-01'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate)=1996), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate)=1999)
 SELECT 'only 1996' AS side, id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'only 1999', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)"""
)
def set_difference_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("id")) for y in (1996, 1999))
    return a.subtract(b).select(F.lit("only 1996").alias("side"), "id").unionByName(b.subtract(a).select(F.lit("only 1999").alias("side"), "id"))


@query(
    """SELECT scene, day, cloud FROM sc WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND cloud<=60 AND orbit='view' ORDER BY ts DESC, scene LIMIT 60""",
    SCENES,
)
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that reach the scan, newest first, at most 60: the search's own limit."""
    s = scenes(spark, sf).where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21' and cloud <= 60 and orbit = 'view'")
    return s.orderBy(F.desc("ts"), "scene").limit(60).select("scene", "day", "cloud")


@query(
    """WITH p AS (SELECT segment, date, flow AS obs, lag(flow,1) OVER (PARTITION BY segment ORDER BY date) AS sim FROM flow), d AS (SELECT * FROM p WHERE sim IS NOT NULL),
 m AS (SELECT segment, avg(obs) AS mo, avg(sim) AS ms, stddev_pop(obs) AS so, stddev_pop(sim) AS ss, corr(obs,sim) AS rr, avg(ln(obs+0.01)) AS lo FROM d GROUP BY 1)
 SELECT d.segment, count(*) AS days, round(1-sum((obs-sim)*(obs-sim))/nullif(sum((obs-mo)*(obs-mo)),0),5) AS nse,
 round(1-sum(pow(ln(obs+0.01)-ln(sim+0.01),2))/nullif(sum(pow(ln(obs+0.01)-lo,2)),0),5) AS log_nse,
 round(1-sqrt(pow(max(rr)-1,2)+pow(max(ss)/nullif(max(so),0)-1,2)+pow(max(ms)/nullif(max(mo),0)-1,2)),5) AS kge, round(100*sum(sim-obs)/nullif(sum(obs),0),4) AS pbias FROM d JOIN m ON m.segment=d.segment GROUP BY d.segment""",
    FLOW,
)
def nse_kge_pbias(spark: SparkSession, sf: str) -> DataFrame:
    """A57 in one pass over the days, with the means from a window of the same partitioning."""
    d = daily_flow(spark, sf).select("segment", "date", F.col("flow").alias("obs"), F.lag("flow").over(seg()).alias("sim")).where("sim is not null")
    w = W.partitionBy("segment")
    lo, ls = F.log(F.col("obs") + 0.01), F.log(F.col("sim") + 0.01)
    d = d.withColumn("mo", F.avg("obs").over(w)).withColumn("lo", lo).withColumn("ls", ls).withColumn("ml", F.avg("lo").over(w))
    sq = lambda c: F.sum(F.pow(c, F.lit(2)))
    ratio = lambda a, b: F.pow(F.try_divide(a, b) - 1, 2)
    kge = 1 - F.sqrt(F.pow(F.corr("obs", "sim") - 1, 2) + ratio(F.stddev_pop("sim"), F.stddev_pop("obs")) + ratio(F.avg("sim"), F.avg("obs")))
    return d.groupBy("segment").agg(
        F.count("*").alias("days"),
        F.round(1 - F.try_divide(sq(F.col("obs") - F.col("sim")), sq(F.col("obs") - F.col("mo"))), 5).alias("nse"),
        F.round(1 - F.try_divide(sq(F.col("lo") - F.col("ls")), sq(F.col("lo") - F.col("ml"))), 5).alias("log_nse"),
        F.round(kge, 5).alias("kge"),
        F.round(100 * F.try_divide(F.sum(F.col("sim") - F.col("obs")), F.sum("obs")), 4).alias("pbias"),
    )


BAND = """b AS (SELECT segment, date, flow AS obs, flow7*0.5 AS lo, flow7*1.5 AS hi, flow7 AS mid FROM (SELECT *, CASE WHEN count(*) OVER w=7 THEN avg(flow) OVER w END AS flow7 FROM flow
 WINDOW w AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE flow7 IS NOT NULL)"""


def band(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast from the week before, with a band of half to one and a half times."""
    d = daily_flow(spark, sf).withColumn("mid", O.full(F.avg("flow"), "flow", seg().rowsBetween(-7, -1), 7)).where("mid is not null")
    return d.select("segment", "date", F.col("flow").alias("obs"), (F.col("mid") * 0.5).alias("lo"), (F.col("mid") * 1.5).alias("hi"), "mid")


@query(f"WITH {BAND} SELECT segment, round(avg(greatest(0.9*(obs-hi),(0.9-1)*(obs-hi))),5) AS pinball90, round(avg(greatest(0.1*(obs-lo),(0.1-1)*(obs-lo))),5) AS pinball10, round(avg(CAST(obs BETWEEN lo AND hi AS INT)),5) AS coverage FROM b GROUP BY segment", FLOW)
def pinball_coverage(spark: SparkSession, sf: str) -> DataFrame:
    pin = lambda q, c: F.round(F.avg(F.greatest(q * (F.col("obs") - F.col(c)), (q - 1) * (F.col("obs") - F.col(c)))), 5)
    inside = F.col("obs").between(F.col("lo"), F.col("hi")).cast("int")
    return band(spark, sf).groupBy("segment").agg(pin(0.9, "hi").alias("pinball90"), pin(0.1, "lo").alias("pinball10"), F.round(F.avg(inside), 5).alias("coverage"))


MARGIN = f"""{BAND}, s AS (SELECT segment, month(date) BETWEEN 6 AND 9 AS monsoon, greatest(ln(1+lo)-ln(1+obs), ln(1+obs)-ln(1+hi)) AS score FROM b WHERE year(date)<=1998),
 k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY segment, monsoon) AS n FROM s WINDOW w AS (PARTITION BY segment, monsoon ORDER BY score)),
 mg AS (SELECT segment, monsoon, max(n) AS n, max(CASE WHEN i=CAST(ceil(least(1.0,ceil((n+1)*0.8)/n)*(n-1)-1e-9) AS BIGINT)+1 THEN score END) AS margin FROM k GROUP BY 1,2)"""


def margins(b: DataFrame) -> DataFrame:
    """The conformal margin, the order statistic at or above the corrected quantile."""
    score = F.greatest(F.log1p("lo") - F.log1p("obs"), F.log1p("obs") - F.log1p("hi"))
    s = b.where(F.year("date") <= 1998).select("segment", F.month("date").between(6, 9).alias("monsoon"), score.alias("score"))
    w = W.partitionBy("segment", "monsoon")
    s = s.withColumn("i", F.row_number().over(w.orderBy("score"))).withColumn("n", F.count("*").over(w))
    place = F.ceil(F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * 0.8) / F.col("n")) * (F.col("n") - 1) - 1e-9) + 1
    return s.groupBy("segment", "monsoon").agg(F.max("n").alias("n"), F.max(F.when(F.col("i") == place, F.col("score"))).alias("margin"))


@query(f"WITH {MARGIN} SELECT segment, monsoon, n, round(margin,6) AS margin FROM mg", FLOW)
def conformal_margin(spark: SparkSession, sf: str) -> DataFrame:
    return margins(band(spark, sf)).select("segment", "monsoon", "n", r("margin", 6))


@query(
    f"""WITH {MARGIN}, t AS (SELECT b.*, greatest(0, exp(ln(1+lo)-margin)-1) AS lo2, exp(ln(1+hi)+margin)-1 AS hi2 FROM b JOIN mg ON mg.segment=b.segment AND mg.monsoon=(month(date) BETWEEN 6 AND 9) WHERE year(date)>1998)
 SELECT segment, count(*) AS days, round(avg(CAST(obs BETWEEN lo AND hi AS INT)),5) AS before, round(avg(CAST(obs BETWEEN lo2 AND hi2 AS INT)),5) AS after, round(median(hi2-lo2),4) AS width FROM t GROUP BY segment""",
    FLOW,
)
def conformal_band(spark: SparkSession, sf: str) -> DataFrame:
    b = band(spark, sf)
    t = b.where(F.year("date") > 1998).withColumn("monsoon", F.month("date").between(6, 9)).join(margins(b).drop("n"), ["segment", "monsoon"])
    lo, hi = F.greatest(F.lit(0.0), F.expm1(F.log1p("lo") - F.col("margin"))), F.expm1(F.log1p("hi") + F.col("margin"))
    t = t.withColumn("lo2", lo).withColumn("hi2", hi)
    share = lambda a, b: F.round(F.avg(F.col("obs").between(F.col(a), F.col(b)).cast("int")), 5)
    return t.groupBy("segment").agg(F.count("*").alias("days"), share("lo", "hi").alias("before"), share("lo2", "hi2").alias("after"), F.round(F.median(F.col("hi2") - F.col("lo2")), 4).alias("width"))


@query(
    """WITH d AS (SELECT segment, dayofyear(date) AS doy, flow FROM flow), ofs AS (SELECT CAST(unnest(generate_series(-7,7)) AS INT) AS off)
 SELECT segment, CAST((doy+off+365)%365 AS INT) AS doy, round(median(flow),4) AS typical FROM d CROSS JOIN ofs GROUP BY 1,2""",
    FLOW,
)
def doy_climatology(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_flow(spark, sf).select("segment", F.dayofyear("date").alias("at"), "flow", F.explode(F.sequence(F.lit(-7), F.lit(7))).alias("off"))
    return d.groupBy("segment", F.pmod(F.col("at") + F.col("off"), F.lit(365)).alias("doy")).agg(F.round(F.median("flow"), 4).alias("typical"))


@query(
    """WITH f AS (SELECT cell, date, rain*1.0 AS lead1, rain*0.9 AS lead2, rain*0.8 AS lead3 FROM rain), u AS (SELECT cell, date-1 AS origin, lead1 AS v FROM f UNION ALL SELECT cell, date-2, lead2 FROM f UNION ALL SELECT cell, date-3, lead3 FROM f)
 SELECT cell, CAST(origin AS DATE) AS origin, round(sum(v),4) AS future FROM u GROUP BY 1,2 HAVING count(*)=3""",
    RAIN,
)
def lead_diagonal_join(spark: SparkSession, sf: str) -> DataFrame:
    """What a forecast made on a day said of the next three days, gathered from the days it speaks of."""
    d = daily_rain(spark, sf)
    leads = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("rain") * f).alias("v")) for k, f in ((1, 1.0), (2, 0.9), (3, 0.8))])).alias("x")
    u = d.select("cell", "date", leads).select("cell", F.date_sub("date", F.col("x.k")).alias("origin"), "x.v")
    return u.groupBy("cell", "origin").agg(F.round(F.sum("v"), 4).alias("future"), F.count("*").alias("n")).where("n = 3").drop("n")


@query(
    """SELECT segment, date, round(least(a,b,c),6) AS low, round(a+b+c-least(a,b,c)-greatest(a,b,c),6) AS mid, round(greatest(a,b,c),6) AS high FROM (SELECT segment, date, flow AS a, lag(flow,1,0.0) OVER w AS b, lag(flow,2,0.0) OVER w AS c FROM flow WINDOW w AS (PARTITION BY segment ORDER BY date))""",
    FLOW,
)
def sorted_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Three values of a row in order, so that bands never cross."""
    d = daily_flow(spark, sf).select("segment", "date", F.array_sort(F.array("flow", F.lag("flow", 1, 0.0).over(seg()), F.lag("flow", 2, 0.0).over(seg()))).alias("q"))
    return d.select("segment", "date", *[F.round(F.element_at("q", i), 6).alias(n) for i, n in ((1, "low"), (2, "mid"), (3, "high"))])


@query("SELECT segment, date, round(lag(flow,7) OVER w,6) AS persistence, round(lag(flow,7) OVER w*pow(0.97,7),6) AS recession FROM flow WINDOW w AS (PARTITION BY segment ORDER BY date)", FLOW)
def persistence_recession(spark: SparkSession, sf: str) -> DataFrame:
    q = F.lag("flow", 7).over(seg())
    return daily_flow(spark, sf).select("segment", "date", F.round(q, 6).alias("persistence"), F.round(q * 0.97**7, 6).alias("recession"))


@query(
    """SELECT DISTINCT date, round(sin(2*pi()*dayofyear(date)/365.25),6) AS s, round(cos(2*pi()*dayofyear(date)/365.25),6) AS c, CAST(CASE WHEN month(date)<=2 THEN 0 WHEN month(date)<=5 THEN 1 WHEN month(date)<=9 THEN 2 ELSE 3 END AS INT) AS season FROM flow""",
    FLOW,
)
def day_of_year_features(spark: SparkSession, sf: str) -> DataFrame:
    a, m = 2 * F.pi() * F.dayofyear("date") / 365.25, F.month("date")
    d = daily_flow(spark, sf).select("date").distinct()
    return d.select("date", F.round(F.sin(a), 6).alias("s"), F.round(F.cos(a), 6).alias("c"), F.when(m <= 2, 0).when(m <= 5, 1).when(m <= 9, 2).otherwise(3).alias("season"))


@query(
    """WITH p AS (SELECT segment, year(date) AS year, sum(flow) AS v FROM flow GROUP BY 1,2) SELECT a.segment, CAST(g AS INT) AS gap, count(*) AS pairs, round(median(abs(b.v-a.v)),4) AS med, round(quantile_cont(abs(b.v-a.v),0.9),4) AS p90, round(max(abs(b.v-a.v)),4) AS most
 FROM p a JOIN p b ON a.segment=b.segment, (SELECT unnest([1,2,3]) AS g) WHERE b.year=a.year+g GROUP BY 1,2""",
    FLOW,
)
def gap_pairs_noise(spark: SparkSession, sf: str) -> DataFrame:
    p = daily_flow(spark, sf).groupBy("segment", F.year("date").alias("year")).agg(F.sum("flow").alias("v"))
    a = p.select("segment", "year", F.col("v").alias("v0"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("gap"))
    j = a.select("segment", (F.col("year") + F.col("gap")).alias("year"), "v0", "gap").join(p, ["segment", "year"])
    d = F.abs(F.col("v") - F.col("v0"))
    return j.groupBy("segment", "gap").agg(F.count("*").alias("pairs"), F.round(F.median(d), 4).alias("med"), F.round(F.percentile(d, 0.9), 4).alias("p90"), F.round(F.max(d), 4).alias("most"))
