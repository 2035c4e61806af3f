"""Queries over daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import science as S
from tidemark.operators import series as O
from tidemark.plans.registry import DAY, FLOW, RAIN, SEASON, query
from tidemark.sources.roles import daily_flow, daily_rain, table


def r(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


LOW7 = """low AS (SELECT *, CASE WHEN count(flow) OVER w=7 THEN avg(flow) OVER w END AS low FROM flow
 WINDOW w AS (PARTITION BY segment ORDER BY date ROWS 6 PRECEDING))"""
ANNUAL = f"""{LOW7}, ann AS (SELECT segment, CAST(year(date) AS INT) AS year, count(*) AS days, avg(flow) AS mean_flow, sum(flow)*{DAY} AS volume,
 max(flow) AS peak, min(low) AS low7, count(*) = CASE WHEN year(date)%4=0 THEN 366 ELSE 365 END AS complete FROM low GROUP BY segment, year(date))"""


@query(f"WITH {ANNUAL} SELECT segment, year, days, round(mean_flow,4) AS mean_flow, round(volume,4) AS volume, round(peak,4) AS peak, round(low7,4) AS low7, complete FROM ann", FLOW)
def annual_table(spark: SparkSession, sf: str) -> DataFrame:
    return O.annual(daily_flow(spark, sf)).select("segment", "year", "days", r("mean_flow"), r("volume"), r("peak"), r("low7"), "complete")


@query(
    f"""WITH {LOW7}, y AS (SELECT *, CAST(year(date) - CAST(month(date)<6 AS INT) AS INT) AS year FROM low)
 SELECT segment, year, format('{{:d}}-{{:02d}}', year, (year+1)%100) AS label, count(*) AS days, round(avg(flow),4) AS mean_flow,
 round(sum(flow)*{DAY},4) AS volume, round(max(flow),4) AS peak, round(min(low),4) AS low7,
 count(*) = date_diff('day', make_date(year,6,1), make_date(year+1,6,1)) AS complete FROM y GROUP BY segment, year""",
    FLOW,
)
def water_year_table(spark: SparkSession, sf: str) -> DataFrame:
    t = O.annual(daily_flow(spark, sf), water=True)
    return t.select("segment", "year", C.water_year_label(F.col("year")).alias("label"), "days", r("mean_flow"), r("volume"), r("peak"), r("low7"), "complete")


SEAS = f"""seas AS (SELECT segment, CAST(year(date) AS INT) AS year, {SEASON.format(d='date')} AS season, count(*) AS days, avg(flow) AS mean_flow,
 sum(flow)*{DAY} AS volume FROM flow GROUP BY 1,2,3),
sc AS (SELECT *, days = CASE season WHEN 'winter' THEN 59 + CAST(year%4=0 AS INT) WHEN 'pre-monsoon' THEN 92 WHEN 'monsoon' THEN 122 ELSE 92 END AS complete FROM seas)"""


@query(f"WITH {SEAS} SELECT segment, year, season, days, round(mean_flow,4) AS mean_flow, round(volume,4) AS volume, complete FROM sc", FLOW)
def season_complete(spark: SparkSession, sf: str) -> DataFrame:
    return O.seasonal(daily_flow(spark, sf)).select("segment", "year", "season", "days", r("mean_flow"), r("volume"), "complete")


@query(
    f"""WITH {SEAS} SELECT segment, year, round(max(mean_flow) FILTER (season='winter'),4) AS winter, round(max(mean_flow) FILTER (season='pre-monsoon'),4) AS pre_monsoon,
 round(max(mean_flow) FILTER (season='monsoon'),4) AS monsoon, round(max(mean_flow) FILTER (season='post-monsoon'),4) AS post_monsoon FROM sc GROUP BY 1,2""",
    FLOW,
)
def pivot_seasons(spark: SparkSession, sf: str) -> DataFrame:
    p = O.seasonal(daily_flow(spark, sf)).groupBy("segment", "year").pivot("season", list(C.SEASONS)).agg(F.max("mean_flow"))
    return p.select("segment", "year", *[F.round(F.col(f"`{s}`"), 4).alias(s.replace("-", "_")) for s in C.SEASONS])


MONTHS = f"""mon AS (SELECT segment, CAST(date_trunc('month',date) AS DATE) AS month, count(*) AS days, avg(flow) AS mean_flow, sum(flow)*{DAY} AS volume FROM flow GROUP BY 1,2),
mc AS (SELECT *, days = day(last_day(month)) AS complete FROM mon)"""


@query(f"WITH {MONTHS} SELECT segment, month, days, round(mean_flow,4) AS mean_flow, round(volume,4) AS volume, complete FROM mc", FLOW)
def monthly_table(spark: SparkSession, sf: str) -> DataFrame:
    return O.monthly(daily_flow(spark, sf)).select("segment", "month", "days", r("mean_flow"), r("volume"), "complete")


@query(
    f"""WITH {MONTHS}, cl AS (SELECT segment, CAST(month(month) AS INT) AS moy, avg(mean_flow) AS m, median(mean_flow) AS md, quantile_cont(mean_flow,0.1) AS p1,
 quantile_cont(mean_flow,0.9) AS p9, avg(volume) AS v FROM mc WHERE complete AND year(month) BETWEEN 1996 AND 2000 GROUP BY 1,2)
 SELECT segment, moy, round(m,4) AS mean_flow, round(md,4) AS median_flow, round(p1,4) AS p10, round(p9,4) AS p90, round(v,4) AS volume,
 round(100*v/nullif(sum(v) OVER (PARTITION BY segment),0),4) AS share FROM cl""",
    FLOW,
)
def climatology(spark: SparkSession, sf: str) -> DataFrame:
    c = O.climatology(daily_flow(spark, sf), 1996, 2000)
    return c.select("segment", "moy", r("mean_flow"), r("median_flow"), r("p10"), r("p90"), r("volume"), r("share"))


@query(
    """SELECT segment, CAST(p AS INT) AS prob, round(quantile_cont(flow, (100-p)/100.0),4) AS flow
 FROM flow, (SELECT unnest([1,5,10,25,50,75,90,95,99]) AS p) GROUP BY segment, p""".replace("quantile_cont(flow, (100-p)/100.0)", "list_extract(quantile_cont(flow,[0.99,0.95,0.9,0.75,0.5,0.25,0.1,0.05,0.01]), list_position([1,5,10,25,50,75,90,95,99],p))"),
    FLOW,
)
def flow_duration(spark: SparkSession, sf: str) -> DataFrame:
    return O.duration_curve(daily_flow(spark, sf)).select("segment", "prob", r("flow"))


WEIBULL = """rk AS (SELECT *, 100.0*row_number() OVER (PARTITION BY segment ORDER BY v DESC)/(count(*) OVER (PARTITION BY segment)+1) AS p FROM vals),
ln AS (SELECT *, lead(p) OVER (PARTITION BY segment ORDER BY p) AS p2, lead(v) OVER (PARTITION BY segment ORDER BY p) AS v2 FROM rk),
dep AS (SELECT segment, count(*) AS n, max(CASE WHEN p=50 THEN v WHEN p<50 AND p2>50 THEN v+(v2-v)*(50-p)/(p2-p) END) AS dep50,
 max(CASE WHEN p=75 THEN v WHEN p<75 AND p2>75 THEN v+(v2-v)*(75-p)/(p2-p) END) AS dep75,
 max(CASE WHEN p=90 THEN v WHEN p<90 AND p2>90 THEN v+(v2-v)*(90-p)/(p2-p) END) AS dep90 FROM ln GROUP BY segment)"""


@query(f"WITH {ANNUAL}, vals AS (SELECT segment, mean_flow AS v FROM ann WHERE complete), {WEIBULL} SELECT segment, n, round(dep50,4) AS dep50, round(dep75,4) AS dep75, round(dep90,4) AS dep90 FROM dep", FLOW)
def dependable(spark: SparkSession, sf: str) -> DataFrame:
    a = O.annual(daily_flow(spark, sf)).where("complete")
    return O.dependable(a, ["segment"], "mean_flow").select("segment", "n", r("dep50"), r("dep75"), r("dep90"))


@query(
    """SELECT c_mktsegment AS segment, CAST(rank AS INT) AS rank, round(v,2) AS value, round(100.0*rank/(n+1),6) AS exceeded FROM (
 SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)"""
)
def weibull_rank(spark: SparkSession, sf: str) -> DataFrame:
    c, w = table(spark, sf, "customer"), W.partitionBy("c_mktsegment")
    rank = F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))
    c = c.select(F.col("c_mktsegment").alias("segment"), rank.alias("rank"), F.round("c_acctbal", 2).alias("value"), F.count("*").over(w).alias("n"))
    return c.select("segment", "rank", "value", F.round(100.0 * F.col("rank") / (F.col("n") + 1), 6).alias("exceeded"))


@query(f"WITH {ANNUAL} SELECT segment, year, round(volume,4) AS volume, round(1000*volume/371.5,4) AS depth_mm FROM ann WHERE complete", FLOW)
def volume_runoff(spark: SparkSession, sf: str) -> DataFrame:
    a = O.annual(daily_flow(spark, sf)).where("complete")
    return a.select("segment", "year", r("volume"), F.round(1000 * F.col("volume") / 371.5, 4).alias("depth_mm"))


@query(
    """WITH x AS (SELECT cell, CAST(year(date) AS INT) AS year, sum(rain) AS total, count(*) AS n FROM rain WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1,2)
 SELECT cell, year, round(total,3) AS total FROM x WHERE n=122""",
    RAIN,
)
def months_total(spark: SparkSession, sf: str) -> DataFrame:
    x = daily_rain(spark, sf).where(F.month("date").between(6, 9)).groupBy("cell", F.year("date").alias("year"))
    return x.agg(F.round(F.sum("rain"), 3).alias("total"), F.count("*").alias("n")).where("n = 122").drop("n")


@query(
    """SELECT segment, round(avg(flow),4) AS mean_flow, round(median(flow),4) AS median_flow, round(avg(flow) FILTER (month(date) BETWEEN 6 AND 9),4) AS monsoon_mean,
 round(100*sum(flow) FILTER (month(date) BETWEEN 6 AND 9)/nullif(sum(flow),0),4) AS monsoon_share, round(100.0*count(*) FILTER (flow<0.1)/count(*),4) AS dry_days_pct,
 round(max(flow),4) AS peak, arg_max(date, (flow, -epoch(date))) AS peak_date FROM flow GROUP BY segment""",
    FLOW,
)
def segment_profile_argmax(spark: SparkSession, sf: str) -> DataFrame:
    wet = F.month("date").between(6, 9)
    return daily_flow(spark, sf).groupBy("segment").agg(
        F.round(F.avg("flow"), 4).alias("mean_flow"),
        F.round(F.median("flow"), 4).alias("median_flow"),
        F.round(F.avg(F.when(wet, F.col("flow"))), 4).alias("monsoon_mean"),
        F.round(100 * F.try_divide(F.sum(F.when(wet, F.col("flow"))), F.sum("flow")), 4).alias("monsoon_share"),
        F.round(100.0 * F.count_if(F.col("flow") < 0.1) / F.count("*"), 4).alias("dry_days_pct"),
        F.round(F.max("flow"), 4).alias("peak"),
        F.max_by("date", F.struct("flow", -F.unix_date("date"))).alias("peak_date"),
    )


@query(
    f"""WITH {ANNUAL}, z AS (SELECT segment, year(date) AS year, count(*) FILTER (flow<0.01) AS zero FROM flow GROUP BY 1,2),
 b AS (SELECT segment, avg(volume) AS base FROM ann WHERE complete AND year BETWEEN 1996 AND 2000 GROUP BY 1)
 SELECT a.segment, a.year, round(a.volume,4) AS volume, z.zero AS zero_days, round(100*a.volume/nullif(b.base,0),4) AS pct_of_normal FROM ann a JOIN z ON z.segment=a.segment AND z.year=a.year
 JOIN b ON b.segment=a.segment WHERE a.complete AND a.volume < b.base""",
    FLOW,
)
def dry_years(spark: SparkSession, sf: str) -> DataFrame:
    flow = daily_flow(spark, sf)
    a = O.annual(flow).where("complete")
    zero = flow.groupBy("segment", F.year("date").alias("year")).agg(F.count_if(F.col("flow") < 0.01).alias("zero_days"))
    base = F.avg(F.when(F.col("year").between(1996, 2000), F.col("volume"))).over(W.partitionBy("segment"))
    d = a.withColumn("base", base).where("volume < base").join(zero, ["segment", "year"])
    return d.select("segment", "year", r("volume"), "zero_days", F.round(100 * F.try_divide("volume", "base"), 4).alias("pct_of_normal"))


@query(
    f"""WITH {ANNUAL} SELECT segment, CAST(year//10*10 AS INT) AS decade, CAST(min(year) AS VARCHAR)||'-'||CAST(max(year) AS VARCHAR) AS label, count(*) AS years,
 round(avg(mean_flow),4) AS mean_flow, round(sum(volume)/nullif(sum(days),0),6) AS volume_per_day FROM ann WHERE complete GROUP BY segment, year//10*10""",
    FLOW,
)
def decades(spark: SparkSession, sf: str) -> DataFrame:
    a = O.annual(daily_flow(spark, sf)).where("complete")
    a = a.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    return a.groupBy("segment", "decade").agg(
        F.concat_ws("-", F.min("year"), F.max("year")).alias("label"),
        F.count("*").alias("years"),
        F.round(F.avg("mean_flow"), 4).alias("mean_flow"),
        F.round(F.try_divide(F.sum("volume"), F.sum("days")), 6).alias("volume_per_day"),
    )


@query(
    f"""WITH {ANNUAL} SELECT segment, year, round(CASE WHEN count(CASE WHEN complete THEN mean_flow END) OVER w=3 THEN avg(CASE WHEN complete THEN mean_flow END) OVER w END,4) AS rolling
 FROM ann WINDOW w AS (PARTITION BY segment ORDER BY year ROWS 2 PRECEDING)""",
    FLOW,
)
def baseline_rolling(spark: SparkSession, sf: str) -> DataFrame:
    a = O.annual(daily_flow(spark, sf)).withColumn("m", F.when(F.col("complete"), F.col("mean_flow")))
    w = W.partitionBy("segment").orderBy("year").rowsBetween(-2, 0)
    return a.select("segment", "year", F.round(O.full(F.avg("m"), "m", w, 3), 4).alias("rolling"))


@query(
    """WITH f AS (SELECT CAST(year(date) AS INT) AS year, sum(flow) AS flow FROM flow GROUP BY 1), n AS (SELECT CAST(year(date) AS INT) AS year, sum(rain) AS rain FROM rain WHERE year(date) > 1996 GROUP BY 1),
 e AS (SELECT CAST(year(ts) AS INT) AS year, count(*) AS scenes FROM events GROUP BY 1)
 SELECT coalesce(f.year,n.year,e.year) AS year, round(f.flow,3) AS flow, round(n.rain,3) AS rain, e.scenes FROM f FULL JOIN n ON f.year=n.year FULL JOIN e ON coalesce(f.year,n.year)=e.year""",
    FLOW,
    RAIN,
)
def yearly_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    year = lambda d, c, v: d.groupBy(F.year(c).alias("year")).agg(v)
    f = year(daily_flow(spark, sf), "date", F.round(F.sum("flow"), 3).alias("flow"))
    n = year(daily_rain(spark, sf).where(F.year("date") > 1996), "date", F.round(F.sum("rain"), 3).alias("rain"))
    e = year(table(spark, sf, "events"), "ts", F.count("*").alias("scenes"))
    return f.join(n, "year", "full_outer").join(e, "year", "full_outer")


@query(
    """WITH m AS (SELECT cell, CAST(year(date) AS INT) AS year, month(date) AS mo, sum(rain) AS s, count(*)=day(last_day(min(date))) AS ok FROM rain WHERE month(date) BETWEEN 6 AND 10 GROUP BY 1,2,3)
 SELECT cell, year, count(*) FILTER (ok) AS months, round(CASE WHEN count(*) FILTER (ok)=5 THEN sum(s) FILTER (ok) END,3) AS jun_oct FROM m GROUP BY 1,2""",
    RAIN,
)
def min_count_rain(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rain(spark, sf).where(F.month("date").between(6, 10))
    m = d.groupBy("cell", F.year("date").alias("year"), F.month("date").alias("mo")).agg(F.sum("rain").alias("s"), (F.count("*") == F.dayofmonth(F.last_day(F.min("date")))).alias("ok"))
    m = m.groupBy("cell", "year").agg(F.count_if("ok").alias("months"), F.sum(F.when(F.col("ok"), F.col("s"))).alias("s"))
    return m.select("cell", "year", "months", F.round(F.when(F.col("months") == 5, F.col("s")), 3).alias("jun_oct"))


def erfc_sql(z: str) -> str:
    t = f"(1/(1+({z})/2))"
    inner = str(S.ERFC[-1])
    for c in reversed(S.ERFC[:-1]):
        inner = f"({inner}*{t}+({c}))"
    return f"({t}*exp(-({z})*({z})+{inner}))"


def trend_sql(least: int, ties: bool = True) -> str:
    """CTEs that turn vals(segment, x, y) into tr, written apart from the Spark form: pairs by index, not by join keys."""
    var = "(n*(n-1)*(2*n+5)-t)/18.0" if ties else "(n*(n-1)*(2*n+5))/18.0"
    p = "CASE WHEN {v}<=0 OR s=0 THEN 1.0 ELSE " + erfc_sql("(abs(s)-1)/sqrt({v})/sqrt(2.0)") + " END"
    return f"""pr AS (SELECT a.segment, median((b.y-a.y)/(b.x-a.x)) AS slope, sum(sign(b.y-a.y)) AS s FROM vals a JOIN vals b ON a.segment=b.segment AND b.x>a.x GROUP BY 1),
ti AS (SELECT segment, sum(c*(c-1)*(2*c+5)) AS t, sum(c*(c-1)/2) AS tp FROM (SELECT segment, y, count(*) AS c FROM vals GROUP BY 1,2) GROUP BY 1),
me AS (SELECT segment, count(*) AS n, avg(y) AS mean FROM vals GROUP BY 1),
rs AS (SELECT v.segment, v.x, v.y-pr.slope*v.x AS r FROM vals v JOIN pr ON pr.segment=v.segment),
rc AS (SELECT *, r-avg(r) OVER (PARTITION BY segment) AS e FROM rs),
rl AS (SELECT *, lag(e) OVER (PARTITION BY segment ORDER BY x) AS b FROM rc),
lg AS (SELECT segment, median(r) AS intercept, coalesce(sum(e*b)/nullif(sum(e*e),0),0) AS lag1 FROM rl GROUP BY 1),
al AS (SELECT me.segment, n, mean, slope, s, t, tp, intercept, lag1, {var} AS v,
 CASE WHEN lag1>1.96/sqrt(n) THEN greatest(1.0, 1+2*list_sum(list_transform(range(1,n), lambda k: (1-k/n)*pow(lag1,k)))) ELSE 1.0 END AS f
 FROM me JOIN pr ON pr.segment=me.segment JOIN ti ON ti.segment=me.segment JOIN lg ON lg.segment=me.segment),
tr AS (SELECT segment, n, mean, CASE WHEN n>={least} THEN slope END AS slope, CASE WHEN n>={least} THEN intercept END AS intercept,
 CASE WHEN n>={least} THEN CASE WHEN n*(n-1)/2>tp THEN s/sqrt(n*(n-1)/2.0*(n*(n-1)/2.0-tp)) ELSE 0.0 END END AS tau,
 CASE WHEN n>={least} THEN {p.format(v='v')} END AS p, CASE WHEN n>={least} THEN lag1 END AS lag1, CASE WHEN n>={least} THEN {p.format(v='(v*f)')} END AS p_persist FROM al)"""


def yearly(spark: SparkSession, sf: str, value: str) -> DataFrame:
    a = O.annual(daily_flow(spark, sf)).where("complete")
    return a.select("segment", F.col("year").alias("x"), F.round(value, 6).alias("y"))


YEARLY = f"{ANNUAL}, vals AS (SELECT segment, CAST(year AS DOUBLE) AS x, round(mean_flow,6) AS y FROM ann WHERE complete)"


@query(f"WITH {YEARLY}, {trend_sql(5)} SELECT segment, n, round(slope,6) AS slope, round(intercept,3) AS intercept FROM tr", FLOW)
def theil_sen(spark: SparkSession, sf: str) -> DataFrame:
    return O.trend(yearly(spark, sf, "mean_flow"), ["segment"], least=5).select("segment", "n", r("slope", 6), r("intercept", 3))


@query(f"WITH {YEARLY}, {trend_sql(5)} SELECT segment, n, round(tau,6) AS tau, round(p,5) AS p, round(lag1,6) AS lag1, round(p_persist,5) AS p_persist FROM tr", FLOW)
def trend_persistence(spark: SparkSession, sf: str) -> DataFrame:
    t = O.trend(yearly(spark, sf, "mean_flow"), ["segment"], least=5)
    return t.select("segment", "n", r("tau", 6), r("p", 5), r("lag1", 6), r("p_persist", 5))


MONTHLY_SERIES = """vals AS (SELECT c_mktsegment AS segment, CAST(mo AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM (SELECT c_mktsegment, (year(o_orderdate)-1995)*12+month(o_orderdate) AS mo, count(*) AS n
 FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2))"""


def monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return o.groupBy(F.col("c_mktsegment").alias("segment"), x.alias("x")).agg(F.count("*").alias("y"))


@query(f"WITH {MONTHLY_SERIES}, {trend_sql(10)} SELECT segment, n, round(slope,6) AS slope, round(tau,6) AS tau, round(p,5) AS p, round(lag1,6) AS lag1, round(p_persist,5) AS p_persist FROM tr")
def mann_kendall_ties(spark: SparkSession, sf: str) -> DataFrame:
    t = O.trend(monthly_counts(spark, sf), ["segment"])
    return t.select("segment", "n", r("slope", 6), r("tau", 6), r("p", 5), r("lag1", 6), r("p_persist", 5))


@query(
    f"""WITH {MONTHLY_SERIES}, {trend_sql(5, ties=False)} SELECT segment, n AS seasons, round(10*slope,1) AS slope_per_decade, round(p,3) AS p_value,
 CASE WHEN p<0.05 THEN CASE WHEN slope<0 THEN 'SIGNIFICANT DECLINE' ELSE 'SIGNIFICANT INCREASE' END ELSE 'NO SIGNIFICANT TREND' END AS flag FROM tr"""
)
def vegetation_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = O.trend(monthly_counts(spark, sf), ["segment"], ties=False, least=5)
    flag = F.when(F.col("p") < 0.05, F.when(F.col("slope") < 0, "SIGNIFICANT DECLINE").otherwise("SIGNIFICANT INCREASE")).otherwise("NO SIGNIFICANT TREND")
    return t.select("segment", F.col("n").alias("seasons"), F.round(10 * F.col("slope"), 1).alias("slope_per_decade"), F.round("p", 3).alias("p_value"), flag.alias("flag"))


@query(
    f"""WITH {MONTHLY_SERIES}, {trend_sql(10)} SELECT segment, CASE WHEN p_persist IS NULL THEN 'too few years' WHEN p_persist<0.01 THEN 'clear '||w WHEN p_persist<0.05 THEN 'likely '||w
 WHEN p_persist<0.1 THEN 'weak sign of a '||w ELSE 'no trend detected' END AS reading FROM (SELECT *, CASE WHEN slope>0 THEN 'rise' ELSE 'fall' END AS w FROM tr)"""
)
def trend_reading(spark: SparkSession, sf: str) -> DataFrame:
    t = O.trend(monthly_counts(spark, sf), ["segment"])
    return t.select("segment", O.reading(F.col("slope"), F.col("p_persist")).alias("reading"))


WEIGHTS = {"A": 0.1, "N": 0.3, "R": 0.6}
W_SQL = "CASE cell WHEN 'A' THEN 0.1 WHEN 'N' THEN 0.3 ELSE 0.6 END"
AMC = f"""am AS (SELECT cell, date, rain/10 AS rain, coalesce(CASE WHEN count(*) OVER w=5 THEN sum(rain/10) OVER w END,0) AS before FROM rain
 WINDOW w AS (PARTITION BY cell ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
cn AS (SELECT *, CASE WHEN before<35.6 THEN 4.2*70/(10-0.058*70) WHEN before>53.3 THEN 23*70/(10+0.13*70) ELSE 70.0 END AS cn FROM am),
ro AS (SELECT *, CASE WHEN rain>0.2*(25400/cn-254) THEN pow(rain-0.2*(25400/cn-254),2)/(rain+0.8*(25400/cn-254)) ELSE 0 END AS q FROM cn)"""


def runoff(rain: DataFrame, cn2: float = 70.0) -> DataFrame:
    """each day's runoff, its curve number chosen by the rain of the five days before."""
    d = rain.withColumn("rain", F.col("rain") / 10)
    w = O.by_day("cell").rowsBetween(-5, -1)
    d = d.withColumn("before", F.coalesce(O.full(F.sum("rain"), "rain", w, 5), F.lit(0.0)))
    base = F.lit(cn2)
    cn = F.when(F.col("before") < 35.6, S.curve_number(base, "dry")).when(F.col("before") > 53.3, S.curve_number(base, "wet")).otherwise(base)
    return d.withColumn("cn", cn).withColumn("q", S.direct_runoff(F.col("rain"), F.col("cn")))


@query(f"WITH {AMC} SELECT cell, date, round(rain,3) AS rain, round(before,3) AS before, round(cn,4) AS cn, round(q,4) AS q FROM ro", RAIN)
def scs_daily_amc(spark: SparkSession, sf: str) -> DataFrame:
    return runoff(daily_rain(spark, sf)).select("cell", "date", r("rain", 3), r("before", 3), r("cn"), r("q"))


@query(f"WITH {AMC} SELECT CAST(year(date) AS INT) AS year, round(sum(rain*{W_SQL}),3) AS rain, round(sum(q*{W_SQL}),3) AS runoff, round(100*sum(q*{W_SQL})/nullif(sum(rain*{W_SQL}),0),3) AS pct FROM ro GROUP BY 1", RAIN)
def rain_runoff_weighted(spark: SparkSession, sf: str) -> DataFrame:
    share = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("cell")]
    d = runoff(daily_rain(spark, sf)).select(F.year("date").alias("year"), (F.col("rain") * share).alias("rain"), (F.col("q") * share).alias("q"))
    d = d.groupBy("year").agg(F.sum("rain").alias("rain"), F.sum("q").alias("runoff"))
    return d.select("year", r("rain", 3), r("runoff", 3), F.round(100 * F.try_divide("runoff", "rain"), 3).alias("pct"))


@query(
    """WITH y AS (SELECT cell, year(date) AS year, date, rain/10 AS p FROM rain), c AS (SELECT unnest([60.0,70.0,80.0,90.0]) AS cn),
 q AS (SELECT cn, year, sum(CASE WHEN p>0.2*(25400/cn-254) THEN pow(p-0.2*(25400/cn-254),2)/(p+0.8*(25400/cn-254)) ELSE 0 END) AS q FROM y CROSS JOIN c GROUP BY 1,2),
 m AS (SELECT cn, avg(q) AS q FROM q WHERE year BETWEEN 1996 AND 2000 GROUP BY 1)
 SELECT CAST(cn AS DOUBLE) AS cn, round(4.2*cn/(10-0.058*cn),4) AS cn_dry, round(23*cn/(10+0.13*cn),4) AS cn_wet, round(q,3) AS runoff, round(q-(SELECT q FROM m WHERE cn=70),3) AS change FROM m""",
    RAIN,
)
def curve_number_sweep(spark: SparkSession, sf: str) -> DataFrame:
    d = daily_rain(spark, sf).select(F.year("date").alias("year"), (F.col("rain") / 10).alias("p"), F.explode(F.array(*map(F.lit, (60.0, 70.0, 80.0, 90.0)))).alias("cn"))
    q = d.groupBy("cn", "year").agg(F.sum(S.direct_runoff(F.col("p"), F.col("cn"))).alias("q")).where(F.col("year").between(1996, 2000))
    m = q.groupBy("cn").agg(F.avg("q").alias("q"))
    own = F.max(F.when(F.col("cn") == 70.0, F.col("q"))).over(W.partitionBy(F.lit(1)))
    cn = F.col("cn")
    return m.select("cn", F.round(S.curve_number(cn, "dry"), 4).alias("cn_dry"), F.round(S.curve_number(cn, "wet"), 4).alias("cn_wet"), F.round("q", 3).alias("runoff"), F.round(F.col("q") - own, 3).alias("change"))


BUD = "p*(1-sqrt((e/p)*tanh(1/(e/p))*(1-exp(-e/p))))"


@query(f"WITH y AS (SELECT cell, CAST(year(date) AS INT) AS year, sum(rain)/10 AS p, 1.2*sum(rain)/10+100 AS e FROM rain GROUP BY 1,2) SELECT cell, year, round({BUD},4) AS runoff FROM y WHERE p>0", RAIN)
def budyko(spark: SparkSession, sf: str) -> DataFrame:
    y = daily_rain(spark, sf).groupBy("cell", F.year("date").alias("year")).agg((F.sum("rain") / 10).alias("p")).where("p > 0")
    return y.select("cell", "year", F.round(S.budyko(F.col("p"), 1.2 * F.col("p") + 100), 4).alias("runoff"))


@query(
    f"""WITH {AMC}, y AS (SELECT year(date) AS year, sum(rain) AS p, sum(q) AS q FROM ro GROUP BY 1), m AS (SELECT avg(p) AS p, avg(q) AS q, avg(p)*1.3 AS e FROM y WHERE year BETWEEN 1996 AND 2000)
 SELECT 'budyko' AS method, round({BUD},4) AS runoff, round(100*({BUD})/p,4) AS pct FROM m UNION ALL SELECT 'curve number', round(q,4), round(100*q/p,4) FROM m UNION ALL SELECT 'half of rain', round(p/2,4), 50.0 FROM m""",
    RAIN,
)
def yield_union(spark: SparkSession, sf: str) -> DataFrame:
    y = runoff(daily_rain(spark, sf)).groupBy(F.year("date").alias("year")).agg(F.sum("rain").alias("p"), F.sum("q").alias("q"))
    m = y.where(F.col("year").between(1996, 2000)).agg(F.avg("p").alias("p"), F.avg("q").alias("q"))
    p = F.col("p")
    rows = [("budyko", S.budyko(p, 1.3 * p)), ("curve number", F.col("q")), ("half of rain", p / 2)]
    parts = [m.select(F.lit(n).alias("method"), F.round(v, 4).alias("runoff"), F.round(100 * v / p, 4).alias("pct")) for n, v in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {SEAS}, vals AS (SELECT segment, mean_flow AS v FROM sc WHERE complete AND season='monsoon'), {WEIBULL}
 SELECT segment, CAST(p AS INT) AS prob, round(CASE p WHEN 50 THEN dep50 ELSE dep75 END,4) AS model, g AS gauge, round((CASE p WHEN 50 THEN dep50 ELSE dep75 END)/g,4) AS ratio
 FROM dep, (VALUES (50,412.3),(75,318.46)) t(p,g)""".replace("g AS gauge", "CAST(g AS DOUBLE) AS gauge").replace(")/g,4)", ")/CAST(g AS DOUBLE),4)"),
    FLOW,
)
def gauge_check_ratio(spark: SparkSession, sf: str) -> DataFrame:
    s = O.seasonal(daily_flow(spark, sf)).where("complete and season = 'monsoon'")
    d = O.dependable(s, ["segment"], "mean_flow").unpivot("segment", ["dep50", "dep75"], "k", "model")
    g = F.when(F.col("k") == "dep50", 412.3).otherwise(318.46)
    prob = F.substring("k", 4, 2).cast("int")
    return d.select("segment", prob.alias("prob"), r("model"), g.alias("gauge"), F.round(F.col("model") / g, 4).alias("ratio"))


@query(
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS moy, o_orderpriority AS segment, count(*) AS n FROM orders GROUP BY 1,2,3)
 SELECT year, moy, coalesce(segment,'ALL') AS segment, sum(n)::BIGINT AS n FROM y GROUP BY ROLLUP(year, moy, segment) HAVING year IS NOT NULL AND moy IS NOT NULL"""
)
def whole_total_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("moy"), F.col("o_orderpriority").alias("segment"))
    t = o.rollup("year", "moy", "segment").agg(F.count("*").alias("n")).where("year is not null and moy is not null")
    return t.select("year", "moy", F.coalesce("segment", F.lit("ALL")).alias("segment"), "n")


@query(
    """WITH f AS (SELECT CAST(year(date) AS INT) AS year, segment, sum(flow) AS v FROM flow GROUP BY 1,2), n AS (SELECT year(date) AS year, sum(rain) AS rain FROM rain GROUP BY 1)
 SELECT segment, round(corr(v, rain),5) AS r FROM f JOIN n ON f.year=n.year GROUP BY segment""",
    FLOW,
    RAIN,
)
def rain_correlation(spark: SparkSession, sf: str) -> DataFrame:
    f = daily_flow(spark, sf).groupBy("segment", F.year("date").alias("year")).agg(F.sum("flow").alias("v"))
    n = daily_rain(spark, sf).groupBy(F.year("date").alias("year")).agg(F.sum("rain").alias("rain"))
    return f.join(n, "year").groupBy("segment").agg(F.round(F.corr("v", "rain"), 5).alias("r"))


@query(
    """WITH q AS (SELECT l_orderkey AS site, list(l_quantity ORDER BY l_linenumber) AS depths, list(l_tax*100+1 ORDER BY l_linenumber) AS times FROM lineitem GROUP BY 1),
 a AS (SELECT site, 4.0/(len(depths)+1)*list_sum(depths)/97.3 AS area, 10.0/list_avg(times) AS v, len(depths) AS n FROM q)
 SELECT site, round(area,3) AS area, round(v,3) AS surface, round(area*v*0.85,7) AS q, round(area*v*0.8,7) AS low, round(area*v*0.9,7) AS high, round(area*v*0.85*86.4,2) AS mld FROM a WHERE n>1"""
)
def float_discharge(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("site"))
    runs = li.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", (F.col("l_tax") * 100 + 1).alias("t")))).alias("x")).where(F.size("x") > 1)
    add = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, v: s + v)
    a = runs.select("site", F.col("x.l_quantity").alias("depths"), F.col("x.t").alias("times"))
    a = a.select("site", (4.0 / (F.size("depths") + 1) * add("depths") / 97.3).alias("area"), (10.0 / (add("times") / F.size("times"))).alias("v"))
    q = F.col("area") * F.col("v")
    return a.select("site", r("area", 3), F.round("v", 3).alias("surface"), F.round(q * 0.85, 7).alias("q"), F.round(q * 0.8, 7).alias("low"), F.round(q * 0.9, 7).alias("high"), F.round(q * 0.85 * 86.4, 2).alias("mld"))


@query(
    """WITH c AS (SELECT p_partkey AS id, 1.0+p_size/10.0 AS b, p_retailprice/1000.0 AS y FROM part), g AS (SELECT *, (b+1.5*y)*y AS a, (b+1.5*y)*y/(b+2*y*sqrt(1+1.5*1.5)) AS rr FROM c)
 SELECT id, round(pow(rr,2.0/3.0)*sqrt(0.0004)/0.035,5) AS velocity, round(a*pow(rr,2.0/3.0)*sqrt(0.0004)/0.035,4) AS q FROM g"""
)
def manning(spark: SparkSession, sf: str) -> DataFrame:
    b, y = 1.0 + F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0
    v, q = S.manning(b, y, 1.5, 0.0004, 0.035)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(v, 5).alias("velocity"), F.round(q, 4).alias("q"))


@query("SELECT segment, date, round(flow*1000,3) AS litres, round(flow*35.3147,4) AS cusec, round(flow*86.4,4) AS mld, round(flow*8.64,4) AS ham_day, round(flow*0.0864/28.3168,6) AS tmc FROM flow", FLOW)
def unit_conversions(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("flow")
    return daily_flow(spark, sf).select("segment", "date", F.round(q * 1000, 3).alias("litres"), F.round(q * 35.3147, 4).alias("cusec"), F.round(q * 86.4, 4).alias("mld"), F.round(q * 8.64, 4).alias("ham_day"), F.round(q * 0.0864 / 28.3168, 6).alias("tmc"))
