"""Forecasts of daily flow: features, quantile models, baselines, comparisons and the rain-forecast test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators import series as O
from tidemark.plans.registry import FLOW, RAIN, query
from tidemark.session import materialize
from tidemark.sources.roles import daily_flow, daily_rain

HORIZONS = (1, 3, 7)
VALIDATION, TEST, GAP = (2000,), (2001,), 90
LAGS, SUMS, HALF_LIVES = (0, 1, 2, 3, 7, 14, 30), (1, 3, 7, 14, 30, 60, 90), (3, 10, 30, 90)
BASE = [*(f"lag{k}" for k in LAGS), "max7", "min30", "trend3", *(f"sum{k}" for k in SUMS), "dry", "doy_sin", "doy_cos", "season"]
WET = [f"wet{h}" for h in HALF_LIVES]
FUTURE = ["future_sum", "future_last3"]
SETS = {"base": BASE, "base + wetness": BASE + WET, "best case": BASE + WET + FUTURE}


def basin_rain(spark: SparkSession, sf: str) -> DataFrame:
    """(date, rain): the cells' mean by day."""
    return daily_rain(spark, sf).groupBy("date").agg(F.avg("rain").alias("rain"))


def drivers(spark: SparkSession, sf: str) -> DataFrame:
    """(segment, date, flow, rain): days that flow and rain both have."""
    return daily_flow(spark, sf).join(basin_rain(spark, sf), "date")


def features(d: DataFrame) -> DataFrame:
    """What is known at the end of each day, by segment: lags and extremes of log flow, rain sums, wetness, season."""
    w = O.by_day()
    d = d.withColumn("lq", F.log1p("flow"))
    for h in HALF_LIVES:
        d = O.ewm(d, "segment", "rain", float(h)).withColumnRenamed("ewm", f"wet{h}")
    wide = lambda agg, c, k: O.full(agg, c, w.rowsBetween(1 - k, 0), k)
    angle, month = 2 * F.pi() * F.dayofyear("date") / 365.25, F.month("date")
    return d.select(
        "segment", "date", "flow", "rain", "lq", *WET, *[F.lag("lq", k).over(w).alias(f"lag{k}") for k in LAGS],
        wide(F.max("lq"), "lq", 7).alias("max7"), wide(F.min("lq"), "lq", 30).alias("min30"), (F.col("lq") - F.lag("lq", 3).over(w)).alias("trend3"),
        *[wide(F.sum("rain"), "rain", k).alias(f"sum{k}") for k in SUMS], O.days_since(F.col("rain") >= 90).cast("double").alias("dry"),
        F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos"), F.when(month <= 2, 0.0).when(month <= 5, 1.0).when(month <= 9, 2.0).otherwise(3.0).alias("season"),
    )


def supervised(spark: SparkSession, sf: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(segment, horizon, date, y, features..., part): the target is log flow ``horizon`` days on.

    Whole years are held out, and days within the gap of them train nothing; as in the reference, future rain is known only
    to the best case.
    """
    w = O.by_day()
    d = features(drivers(spark, sf))

    def at(h: int) -> Column:
        ahead = lambda a: O.full(F.sum("rain"), "rain", w.rowsBetween(a, h), h - a + 1)
        return F.struct(F.lit(h).alias("horizon"), F.lead("lq", h).over(w).alias("y"), ahead(1).alias("future_sum"), ahead(max(1, h - 2)).alias("future_last3"))

    d = d.withColumn("ahead", F.array(*map(at, horizons)))
    out = d.select("*", F.inline("ahead")).drop("ahead")
    year = F.year("date")
    held = lambda years: F.max(year.isin(*years).cast("int")).over(W.partitionBy("segment", "horizon").orderBy("date").rowsBetween(-GAP, GAP)) == 1
    part = F.when(year.isin(*TEST), "test").when(year.isin(*VALIDATION), F.when(held(TEST), "gap").otherwise("val"))
    return out.withColumn("part", part.when(held(TEST + VALIDATION), "gap").otherwise("train")).where("y is not null and lag30 is not null and sum90 is not null")


def skill(d: DataFrame, keys: list[str]) -> DataFrame:
    """Days, NSE, NSE of the monsoon, log-NSE of the dry months, KGE and PBIAS of ``d(keys..., date, obs, sim)``.

    The mean of a key's observations is one more aggregate, so that a second pass adds up squares around it.
    """
    wet = F.month("date").between(6, 9)
    d = d.withColumn("wet", wet).withColumn("lo", F.log(F.col("obs") + 0.01)).withColumn("ls", F.log(F.col("sim") + 0.01))
    only = lambda c, cond: F.when(cond, F.col(c))
    means = d.groupBy(*keys).agg(F.avg("obs").alias("mo"), F.avg(only("obs", F.col("wet"))).alias("mw"), F.avg(only("lo", ~F.col("wet"))).alias("ml"))
    d = d.join(means, keys)
    nse = lambda o, s, m, cond: 1 - F.try_divide(F.sum(F.when(cond, F.pow(F.col(o) - F.col(s), 2))), F.sum(F.when(cond, F.pow(F.col(o) - F.col(m), 2))))
    ratio = lambda a, b: F.pow(F.try_divide(a, b) - 1, 2)
    alike = F.try_divide(F.covar_pop("obs", "sim"), F.stddev_pop("obs") * F.stddev_pop("sim"))  # null, where corr raises, for constants
    kge = 1 - F.sqrt(F.pow(alike - 1, 2) + ratio(F.stddev_pop("sim"), F.stddev_pop("obs")) + ratio(F.avg("sim"), F.avg("obs")))
    return d.groupBy(*keys).agg(
        F.count("*").alias("days"), F.round(nse("obs", "sim", "mo", F.lit(True)), 5).alias("nse"), F.round(nse("obs", "sim", "mw", F.col("wet")), 5).alias("nse_monsoon"),
        F.round(nse("lo", "ls", "ml", ~F.col("wet")), 5).alias("log_nse_dry"), F.round(kge, 5).alias("kge"), F.round(100 * F.try_divide(F.sum(F.col("sim") - F.col("obs")), F.sum("obs")), 4).alias("pbias"),
    )


def _nse(o: str, s: str, m: str, cond: str) -> str:
    return f"1-sum(pow({o}-{s},2)) FILTER ({cond})/nullif(sum(pow({o}-{m},2)) FILTER ({cond}),0)"


SKILL = f"""a AS (SELECT *, month(date) BETWEEN 6 AND 9 AS wet, ln(obs+0.01) AS lo, ln(sim+0.01) AS ls FROM sims),
 mm AS (SELECT segment, horizon, model, avg(obs) AS mo, avg(obs) FILTER (wet) AS mw, avg(lo) FILTER (NOT wet) AS ml FROM a GROUP BY 1,2,3)
 SELECT segment, horizon, model, count(*) AS days, round({_nse("obs", "sim", "mo", "true")},5) AS nse, round({_nse("obs", "sim", "mw", "wet")},5) AS nse_monsoon, round({_nse("lo", "ls", "ml", "NOT wet")},5) AS log_nse_dry,
 round(1-sqrt(pow(CASE WHEN stddev_pop(obs)>0 AND stddev_pop(sim)>0 THEN corr(obs,sim) END-1,2)+pow(stddev_pop(sim)/nullif(stddev_pop(obs),0)-1,2)+pow(avg(sim)/nullif(avg(obs),0)-1,2)),5) AS kge, round(100*sum(sim-obs)/nullif(sum(obs),0),4) AS pbias
 FROM a JOIN mm USING (segment, horizon, model) GROUP BY segment, horizon, model"""
SUPERVISED = """hz AS (SELECT CAST(unnest([1,3,7]) AS INT) AS horizon), fl AS (SELECT segment, date, flow, ln(1+flow) AS lq FROM flow JOIN (SELECT DISTINCT date AS rd FROM rain) ON rd=date),
 n AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY date) AS i, max(CAST(year(date)=2001 AS INT)) OVER w AS by_test, max(CAST(year(date) IN (2000,2001) AS INT)) OVER w AS by_held FROM fl
 WINDOW w AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 90 PRECEDING AND 90 FOLLOWING)),
 sv AS (SELECT a.segment, horizon, a.date, a.lq, b.lq AS y, CASE WHEN year(a.date)=2001 THEN 'test' WHEN year(a.date)=2000 THEN CASE WHEN a.by_test=1 THEN 'gap' ELSE 'val' END WHEN a.by_held=1 THEN 'gap' ELSE 'train' END AS part,
 sin(2*pi()*dayofyear(a.date)/365.25) AS sn, cos(2*pi()*dayofyear(a.date)/365.25) AS cs FROM n a, hz JOIN n b ON b.segment=a.segment AND b.i=a.i+horizon WHERE a.i>=90)"""
DOY = "CAST((round_even(atan2(sn,cs)/(2*pi())*365.25,0)+365)%365 AS INT)"


def baselines(rows: DataFrame) -> DataFrame:
    """M07's baselines in log flow for every row that is not training: the day's own, the dry-weather recession, and the median
    of training targets within seven days of the day of the year, over the year's end."""
    doy = F.pmod(F.bround(F.atan2("doy_sin", "doy_cos") / (2 * F.pi()) * 365.25), F.lit(365)).cast("int")
    near = F.explode(F.transform(F.sequence(F.lit(-7), F.lit(7)), lambda k: F.pmod(doy + k, F.lit(365)))).alias("doy")
    usual = rows.where("part = 'train'").select("segment", "horizon", "y", near).groupBy("segment", "horizon", "doy").agg(F.median("y").alias("usual"))
    new = rows.where("part <> 'train'").withColumn("doy", doy).join(usual, ["segment", "horizon", "doy"], "left")
    dry = F.log1p(F.expm1("lag0") * F.pow(F.lit(0.97), F.col("horizon")))
    sims = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("sim")) for n, c in (("persistence", F.col("lag0")), ("recession", dry), ("climatology", F.col("usual")))])
    return new.select("segment", "horizon", "date", "part", "y", F.inline(sims))


@query(
    f"""WITH {SUPERVISED}, d AS (SELECT *, {DOY} AS doy FROM sv), k AS (SELECT unnest(range(-7,8)) AS k),
 us AS (SELECT segment, horizon, CAST((doy+k+365)%365 AS INT) AS doy, median(y) AS usual FROM d, k WHERE part='train' GROUP BY 1,2,3),
 t AS (SELECT d.*, usual FROM d LEFT JOIN us USING (segment, horizon, doy) WHERE part='test'),
 m AS (SELECT segment, horizon, date, 'persistence' AS model, y, lq AS p FROM t UNION ALL SELECT segment, horizon, date, 'recession', y, ln(1+(exp(lq)-1)*pow(0.97,horizon)) FROM t UNION ALL SELECT segment, horizon, date, 'climatology', y, usual FROM t),
 sims AS (SELECT segment, horizon, model, date, exp(y)-1 AS obs, exp(p)-1 AS sim FROM m WHERE p IS NOT NULL), {SKILL}""",
    FLOW, RAIN,
)
def baseline_skill(spark: SparkSession, sf: str) -> DataFrame:
    """M07's baselines, scored on the test year by segment and horizon."""
    b = baselines(supervised(spark, sf)).where("part = 'test' and sim is not null")
    return skill(b.select("segment", "horizon", "model", "date", F.expm1("y").alias("obs"), F.expm1("sim").alias("sim")), ["segment", "horizon", "model"])


def predicted(rows: DataFrame, sets: list[str], settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """(segment, horizon, model, date, part, y, q): bands of the named feature sets."""
    rows, out = materialize(rows), []
    for name in sets:
        made = boosting.quantile_models(rows, ["segment", "horizon"], "date", SETS[name], settings=settings)
        out.append(made.select(F.lit(name).alias("model"), "segment", "horizon", "date", "part", "q"))
    bands = out[0]
    for more in out[1:]:
        bands = bands.unionByName(more)
    return bands.join(rows.select("segment", "horizon", "date", "part", "y"), ["segment", "horizon", "date", "part"])


def band_skill(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the middle quantile with the share of targets within the outer ones and their pinball losses."""
    loss = lambda p, i: F.avg(F.greatest(p * (F.col("y") - F.col("q")[i]), (p - 1) * (F.col("y") - F.col("q")[i])))
    inside = F.col("y").between(F.col("q")[0], F.col("q")[2]).cast("int")
    cover = bands.groupBy(*keys).agg(F.round(F.avg(inside), 5).alias("coverage"), F.round(loss(0.1, 0), 6).alias("pinball10"), F.round(loss(0.9, 2), 6).alias("pinball90"))
    sims = bands.select(*keys, "date", F.expm1("y").alias("obs"), F.expm1(F.col("q")[1]).alias("sim"))
    return skill(sims, keys).join(cover, keys)


@query()
def quantile_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The band of every day of the test year, by segment and horizon, from the base features."""
    rows = supervised(spark, sf).where("part in ('train', 'test')")
    p = predicted(rows, ["base"])
    flow = [F.round(F.expm1(F.col("q")[i]), 6).alias(n) for i, n in enumerate(("low", "mid", "high"))]
    return p.select("segment", "horizon", "date", F.round(F.expm1("y"), 6).alias("obs"), *flow)


@query()
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Skill of three feature sets on the test year by segment and horizon, for horizons of 1 and 7 days.

    The best case knows the rain to come: a ceiling, not a skill. Baselines are in baseline_skill.
    """
    rows = supervised(spark, sf, (1, 7)).where("part in ('train', 'test') and future_sum is not null")
    return band_skill(predicted(rows, list(SETS)), ["segment", "horizon", "model"])


@query()
def rain_forecast_test(spark: SparkSession, sf: str) -> DataFrame:
    """What a rain forecast is worth: models learn with the rain that fell and are tested with the rain that was forecast.

    The forecast for k days on is the day's rain less a twentieth for each day of lead; what was said at an origin is gathered
    from the days it speaks of. All three rows of a horizon are on the same days.
    """
    rows = supervised(spark, sf, (3,)).where("part in ('train', 'test') and future_sum is not null")
    lead = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("rain") * (1 - 0.05 * k)).alias("v")) for k in (1, 2, 3)])).alias("x")
    said = basin_rain(spark, sf).select("date", lead).select(F.date_sub("date", F.col("x.k")).alias("date"), "x.v")
    said = said.groupBy("date").agg(F.sum("v").alias("said"), F.count("*").alias("n")).where("n = 3").drop("n")
    test = rows.where("part = 'test'").join(said, "date")
    told = test.withColumn("future_sum", F.col("said")).withColumn("future_last3", F.col("said")).withColumn("part", F.lit("forecast")).drop("said")
    both = rows.where("part = 'train'").unionByName(test.drop("said")).unionByName(told)
    p = predicted(both, ["base + wetness", "best case"]).where("model = 'best case' or part = 'test'")
    name = F.when(F.col("model") != "best case", "no rain forecast").when(F.col("part") == "forecast", "rain forecast").otherwise("rain that fell")
    return band_skill(p.withColumn("model", name), ["segment", "horizon", "model"])
