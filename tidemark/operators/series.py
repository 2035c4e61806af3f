"""Daily series: completeness-checked periods, duration curves, dependable flows, trends, features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import science as S

DAY = 86400 / 1e6  # one m3/s for a day, in millions of m3


def full(agg: Column, value: str, window, rows: int) -> Column:
    """A window aggregate, null until the window holds ``rows`` values."""
    return F.when(F.count(value).over(window) == rows, agg.over(window))


def by_day(key: str = "segment"):
    return W.partitionBy(key).orderBy("date")


def annual(flow: DataFrame, water: bool = False) -> DataFrame:
    """Days, mean, volume, highest day, lowest 7-day mean, completeness by calendar or June-to-May year.

    The 7-day mean runs over rows, across years: a year's lowest may have begun in the year before.
    """
    low = full(F.avg("flow"), "flow", by_day().rowsBetween(-6, 0), 7)
    year = C.water_year(F.col("date")) if water else F.year("date")
    d = flow.where("flow is not null").withColumn("low", low).withColumn("year", year)
    out = d.groupBy("segment", "year").agg(
        F.count("*").alias("days"),
        F.avg("flow").alias("mean_flow"),
        (F.sum("flow") * DAY).alias("volume"),
        F.max("flow").alias("peak"),
        F.min("low").alias("low7"),
    )
    return out.withColumn("complete", F.col("days") == C.days_in_year(F.col("year"), water))


def seasonal(flow: DataFrame) -> DataFrame:
    """Days, mean and volume by calendar year and season, and whether all days are there."""
    d = flow.where("flow is not null").withColumn("season", C.season(F.col("date"))).withColumn("year", F.year("date"))
    out = d.groupBy("segment", "year", "season").agg(
        F.count("*").alias("days"), F.avg("flow").alias("mean_flow"), (F.sum("flow") * DAY).alias("volume")
    )
    return out.withColumn("complete", F.col("days") == C.days_in_season(F.col("year"), F.col("season")))


def monthly(flow: DataFrame) -> DataFrame:
    """The same by month."""
    d = flow.where("flow is not null").withColumn("month", F.trunc("date", "MM"))
    out = d.groupBy("segment", "month").agg(
        F.count("*").alias("days"), F.avg("flow").alias("mean_flow"), (F.sum("flow") * DAY).alias("volume")
    )
    return out.withColumn("complete", F.col("days") == F.dayofmonth(F.last_day("month")))


def climatology(flow: DataFrame, start: int, end: int) -> DataFrame:
    """Month-of-year statistics of complete months' means, and each month's share of the yearly volume."""
    m = monthly(flow).where(F.col("complete") & F.year("month").between(start, end))
    out = m.groupBy("segment", F.month("month").alias("moy")).agg(
        F.avg("mean_flow").alias("mean_flow"),
        F.median("mean_flow").alias("median_flow"),
        F.percentile("mean_flow", 0.1).alias("p10"),
        F.percentile("mean_flow", 0.9).alias("p90"),
        F.avg("volume").alias("volume"),
    )
    return out.withColumn("share", 100 * F.try_divide("volume", F.sum("volume").over(W.partitionBy("segment"))))


def duration_curve(flow: DataFrame, probs: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """The flow exceeded on p percent of days."""
    q = F.percentile("flow", F.array(*[F.lit((100 - p) / 100) for p in probs]))
    out = flow.groupBy("segment").agg(q.alias("q"))
    pairs = F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), F.col("q").alias("flow"))
    return out.select("segment", F.inline(pairs).alias("prob", "flow"))


def dependable(values: DataFrame, keys: list[str], value: str, probs: tuple[int, ...] = (50, 75, 90)) -> DataFrame:
    """Values exceeded in p percent of years by Weibull plotting positions, null outside their range."""
    w = W.partitionBy(*keys)
    down = w.orderBy(F.col(value).desc())
    pos = 100.0 * F.row_number().over(down) / (F.count("*").over(w) + 1)
    r = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), pos.alias("p"))
    r = r.withColumn("p2", F.lead("p").over(w.orderBy("p"))).withColumn("v2", F.lead("v").over(w.orderBy("p")))
    cols = []
    for p in probs:
        line = F.when(F.col("p") == p, F.col("v")).when((F.col("p") < p) & (F.col("p2") > p), F.col("v") + (F.col("v2") - F.col("v")) * (p - F.col("p")) / (F.col("p2") - F.col("p")))
        cols.append(F.max(line).alias(f"dep{p}"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), *cols)


def trend(series: DataFrame, keys: list[str], ties: bool = True, least: int = 10) -> DataFrame:
    """Theil-Sen slope and intercept, Mann-Kendall p, lag-1 autocorrelation and the p that allows for it.

    ``series(keys..., x, y)``; null statistics under ``least`` values. Pairs join on the keys, so they grow with the
    square of a series' years only. Without ``ties`` the variance takes no account of equal values.
    """
    s = series.where("y is not null").select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    a, b = s.alias("a"), s.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.join(b, [*same, F.col("a.x") < F.col("b.x")]).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        ((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"),
        F.signum(F.col("b.y") - F.col("a.y")).alias("sign"),
    )
    pairs = pairs.groupBy(*keys).agg(F.median("slope").alias("slope"), F.sum("sign").alias("s"))
    tied = s.groupBy(*keys, "y").count().groupBy(*keys).agg(F.sum(F.expr("count*(count-1)*(2*count+5)")).alias("t"), F.sum(F.expr("count*(count-1)/2")).alias("tp"))
    means = s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    d = s.join(pairs, keys).withColumn("r", F.expr("y - slope*x"))
    w = W.partitionBy(*keys)
    d = d.withColumn("e", F.col("r") - F.avg("r").over(w)).withColumn("before", F.lag("e").over(w.orderBy("x")))
    lags = d.groupBy(*keys).agg(
        F.median("r").alias("intercept"),
        F.coalesce(F.try_divide(F.sum(F.col("e") * F.col("before")), F.sum(F.col("e") * F.col("e"))), F.lit(0.0)).alias("lag1"),
    )
    out = means.join(pairs, keys, "left").join(tied, keys, "left").join(lags, keys, "left")
    var = F.expr("(n*(n-1)*(2*n+5) - t)/18.0") if ties else F.expr("(n*(n-1)*(2*n+5))/18.0")
    k_sum = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + (1 - k / F.col("n")) * F.pow("lag1", k))
    inflate = F.when(F.col("lag1") > 1.96 / F.sqrt("n"), F.greatest(F.lit(1.0), 1 + 2 * k_sum)).otherwise(1.0)
    out = out.withColumn("var", var).withColumn("inflate", inflate)
    p = lambda v: F.when((v <= 0) | (F.col("s") == 0), 1.0).otherwise(S.erfc((F.abs("s") - 1) / F.sqrt(v) / 2**0.5))
    tau = F.when(F.expr("n*(n-1)/2 > tp"), F.expr("s / sqrt(n*(n-1)/2.0 * (n*(n-1)/2.0 - tp))")).otherwise(0.0)
    enough = lambda c: F.when(F.col("n") >= least, c)
    return out.select(
        *keys,
        "n",
        "mean",
        enough(F.col("slope")).alias("slope"),
        enough(F.col("intercept")).alias("intercept"),
        enough(tau).alias("tau"),
        enough(p(F.col("var"))).alias("p"),
        enough(F.col("lag1")).alias("lag1"),
        enough(p(F.col("var") * F.col("inflate"))).alias("p_persist"),
        enough(1000 * F.try_divide("slope", "mean")).alias("pct_per_decade"),
    )


def reading(slope: Column, p: Column) -> Column:
    """A trend in words."""
    word = F.when(slope > 0, "rise").otherwise("fall")
    return (
        F.when(p.isNull(), "too few years")
        .when(p < 0.01, F.concat(F.lit("clear "), word))
        .when(p < 0.05, F.concat(F.lit("likely "), word))
        .when(p < 0.1, F.concat(F.lit("weak sign of a "), word))
        .otherwise("no trend detected")
    )


def ewm(series: DataFrame, key: str, value: str, half_life: float) -> DataFrame:
    """Exponentially weighted mean s_t = (1-a) s_(t-1) + a x_t from s_0 = x_0, over the whole history.

    Rows lie in blocks of 500 half-lives. Within a block the sum is a running one, scaled to the block's start; from
    the block before only its end counts, as all earlier rows together weigh 2^-500 there, beyond a double's digits.
    """
    a, block = 1 - 2 ** (-1 / half_life), math.ceil(500 * half_life)
    w = W.partitionBy(key).orderBy("date")
    d = series.withColumn("_n", F.row_number().over(w) - 1).withColumn("_block", F.floor(F.col("_n") / block))
    d = d.withColumn("_at", F.col("_n") - F.col("_block") * block)
    part = F.when(F.col("_n") == 0, F.col(value)).otherwise(a * F.col(value)) * F.pow(F.lit(2.0), F.col("_at") / half_life)
    inside = F.sum(part).over(W.partitionBy(key, "_block").orderBy("_at"))
    d = d.withColumn("_own", inside * F.pow(F.lit(2.0), -F.col("_at") / half_life))
    before = F.max_by("_own", "_n").over(W.partitionBy(key).orderBy("_block").rangeBetween(-1, -1))
    carried = F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(2.0), -(F.col("_at") + 1) / half_life)
    return d.withColumn("ewm", F.col("_own") + carried).drop("_n", "_block", "_at", "_own")


def days_since(flag: Column, key: str = "segment") -> Column:
    """Rows since the flag was last true, 365 at most; the series' length where it never was."""
    w = W.partitionBy(key).orderBy("date")
    n = F.row_number().over(w)
    size = F.count("*").over(W.partitionBy(key))
    return F.least(F.coalesce(n - F.last(F.when(flag, n), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), size), F.lit(365))
