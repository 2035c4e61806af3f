"""Values that are known in advance."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import science as S
from tidemark.functions import text as T
from tidemark.operators import pixels as P
from tidemark.operators import series as O


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def constant(spark, start, end, value=1.0):
    days = F.explode(F.sequence(F.lit(dt.date.fromisoformat(start)), F.lit(dt.date.fromisoformat(end))))
    return spark.range(1).select(F.lit("a").alias("segment"), days.alias("date")).withColumn("flow", F.lit(value))


def test_year_volumes_and_completeness(spark):
    got = {r.year: r for r in O.annual(constant(spark, "2000-01-01", "2002-06-30")).collect()}
    assert [got[y].days for y in (2000, 2001, 2002)] == [366, 365, 181]
    assert [got[y].complete for y in (2000, 2001, 2002)] == [True, True, False]
    assert got[2001].volume == pytest.approx(31.536)
    water = O.annual(constant(spark, "2000-06-01", "2004-05-31"), water=True).orderBy("year").collect()
    assert [r.days for r in water] == [365, 365, 365, 366] and all(r.complete for r in water)


def test_seven_day_low_and_peak(spark):
    flow = constant(spark, "2001-01-01", "2001-12-31", 9.0)
    flow = flow.withColumn("flow", F.when(F.col("date").between("2001-03-05", "2001-03-11"), 1.0).when(F.col("date") == "2001-08-01", 500.0).otherwise(9.0))
    r = O.annual(flow).first()
    assert r.low7 == 1.0 and r.peak == 500.0


def test_labels_and_seasons(spark):
    assert one(spark, C.water_year_label(F.lit(1999))) == "1999-00" and one(spark, C.water_year_label(F.lit(2024))) == "2024-25"
    assert one(spark, C.water_year(F.lit(dt.date(2024, 5, 31)))) == 2023
    assert one(spark, C.season(F.lit(dt.date(2024, 12, 1)))) == "post-monsoon"
    assert one(spark, C.days_in_season(F.lit(2024), F.lit("winter"))) == 60


def test_duration_and_dependable(spark):
    flow = spark.range(1, 101).select(F.lit("a").alias("segment"), F.col("id").cast("double").alias("flow"))
    q = {r.prob: r.flow for r in O.duration_curve(flow).collect()}
    assert q[50] == pytest.approx(50.5) and q[90] == pytest.approx(10.9)
    nine = spark.range(1, 10).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    r = O.dependable(nine, ["k"], "v", (50, 75, 90, 95)).first()
    assert (r.dep50, r.dep75, r.dep90, r.dep95) == (5.0, 2.5, 1.0, None)


def test_trend_of_a_line_a_flat_and_a_short_series(spark):
    rows = [("up", x, float(x)) for x in range(10)] + [("flat", x, 3.0) for x in range(12)] + [("short", x, float(x)) for x in range(9)]
    got = {r.k: r for r in O.trend(spark.createDataFrame(rows, "k string, x int, y double"), ["k"]).collect()}
    assert got["up"].tau == 1 and got["up"].slope == 1
    assert got["up"].p == pytest.approx(math.erfc(44 / math.sqrt(125) / math.sqrt(2)), rel=1e-6)
    assert got["flat"].slope == 0 and got["flat"].p == 1 and got["short"].p is None


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 2.5, 5.0])
def test_tail_probability(spark, z):
    assert one(spark, S.erfc(F.lit(z))) == pytest.approx(math.erfc(z), rel=2e-7)


def test_runoff(spark):
    cn = F.lit(75.63)
    assert round(one(spark, S.curve_number(cn, "dry")), 2) == 56.59 and round(one(spark, S.curve_number(cn, "wet")), 2) == 87.71
    cases = [(24.6, 75.63, 0.752), (28.4, 87.71, 7.962), (13.6, 56.59, 0.0)]
    for rain, number, want in cases:
        assert one(spark, S.direct_runoff(F.lit(rain), F.lit(number))) == pytest.approx(want, abs=2e-3)


def test_sensor_scaling(spark):
    got = [one(spark, S.reflectance(F.lit(d), F.lit(-1000))) for d in (0, 500, 1000, 3000)]
    assert got == [None, 0.0, 0.0, pytest.approx(0.2)]
    assert [one(spark, S.decibels(F.lit(x))) for x in (1.0, 0.01, 0.0, -1.0)] == [0.0, -20.0, None, None]


def test_parsing(spark):
    assert one(spark, T.distances(F.lit("0.5 km or 100m"))) == [500.0, 100.0]
    assert one(spark, T.years(F.lit("1975, 1984 to 2030 and 2016"), 2026)) == [1984, 2016]
    cases = {
        "Map the river from source to mouth": "river_course",
        "Are the low plots waterlogged?": "river_flood",
        "Build the scouting queue for this area": "scout",
        "good morning": "help",
    }
    assert {q: one(spark, T.action(F.lit(q), 2026)) for q in cases} == cases
    assert one(spark, T.numbers(F.lit("1, 2;3  4.5"))) == [1.0, 2.0, 3.0, 4.5] and one(spark, T.numbers(F.lit("1 x"))) is None
    assert one(spark, T.clean_message(F.lit("failed https://a.b/c/d.tif?sig=abc now"))) == "failed d.tif now"


def test_features_do_not_see_the_future(spark):
    flow = constant(spark, "2001-01-01", "2001-12-31").withColumn("flow", F.dayofyear("date").cast("double"))
    bent = flow.withColumn("flow", F.when(F.col("date") > "2001-07-01", F.col("flow") * 50).otherwise(F.col("flow")))
    for f in (flow, bent):
        f.ewm = O.ewm(f, "segment", "flow", 3.0).where("date <= '2001-07-01'").orderBy("date").collect()
    assert [r.ewm for r in flow.ewm] == [r.ewm for r in bent.ewm]


def test_patches_touch_at_corners(spark):
    mask = [(0, 0, 0), (1, 1, 1), (2, 2, 0), (3, 5, 5), (4, 5, 6), (5, 9, 9)]
    got = {r.px: r.patch for r in P.patches(spark.createDataFrame(mask, "px long, row int, col int")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_unmixing_recovers_shares(spark):
    ends = np.array([[0.2, 0.3, 0.7], [0.5, 0.5, 0.6], [0.4, 0.2, 0.1]])
    share = np.array([[0.2, 0.3, 0.5], [1, 0, 0], [0, 0.6, 0.4]])
    rows = [(i, *map(float, s @ ends)) for i, s in enumerate(share)]
    got = P.unmix(spark.createDataFrame(rows, "px long, a double, b double, c double"), "px", ["a", "b", "c"], ends).orderBy("px").collect()
    assert np.allclose([[r.f0, r.f1, r.f2] for r in got], share, atol=1e-6)


def test_outliers_are_isolated_first():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(200, 2)), [[9, 9], [-8, 7]]])
    score = P.isolation_scores(x)
    assert set(np.argsort(-score)[:2]) == {200, 201} and (score == P.isolation_scores(x)).all()
