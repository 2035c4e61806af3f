import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import warping as R

GRID = "id string, left double, top double, step double, columns int, rows int"


def image(rng, rows, columns):
    v = rng.integers(0, 9, (rows, columns)).astype(float)
    v[rng.random((rows, columns)) < 0.2] = np.nan
    return v


def table(spark, images):
    rows = [(k, i, j, None if math.isnan(x) else float(x), 0) for k, v in images.items() for (i, j), x in np.ndenumerate(v) if (i + j) % 7]
    return spark.createDataFrame(rows, "id string, row int, col int, v double, left int")  # a column named as one of a grid's; some pixels have no row


def test_nearest_bilinear_and_pooled(spark):
    rng = np.random.default_rng(3)
    images = {"a": image(rng, 6, 9), "b": image(rng, 5, 4)}
    for v in images.values():
        v[np.add.outer(np.arange(v.shape[0]), np.arange(v.shape[1])) % 7 == 0] = np.nan
    of = {"a": (100.0, 50.0, 10.0, 9, 6), "b": (-3.0, 7.0, 2.0, 4, 5)}
    to = {"a": (95.0, 58.0, 7.0, 15, 11), "b": (-3.0, 7.0, 1.0, 8, 10), "c": (0.0, 0.0, 1.0, 2, 1)}
    extra = [("d", None, 0.0, 1.0, 3, 3), ("e", 0.0, 0.0, 0.0, 3, 3), ("f", 0.0, 0.0, 1.0, 0, 3)]
    s = spark.createDataFrame([(k, *g) for k, g in of.items()], GRID)
    t = spark.createDataFrame([*((k, *g) for k, g in to.items()), *extra], GRID)
    p = table(spark, images)
    asked = R.places(t, s, ["id"])
    near = {(r.id, r.row, r.col): r.v for r in R.nearest(asked, p, ["id"], ["v"]).collect()}
    smooth = {(r.id, r.row, r.col): r.v for r in R.bilinear(asked, p, ["id"], ["v"]).collect()}
    assert len(near) == len(smooth) == 15 * 11 + 80 + 2
    for k, (left, top, step, columns, rows) in to.items():
        for i in range(rows):
            for j in range(columns):
                x, y = left + (j + 0.5) * step, top - (i + 0.5) * step
                if k == "c" or not (0 <= (x - of[k][0]) / of[k][2] < of[k][3] and 0 <= (of[k][1] - y) / of[k][2] < of[k][4]):
                    assert near[k, i, j] is None and smooth[k, i, j] is None
                    continue
                u, v = (x - of[k][0]) / of[k][2], (of[k][1] - y) / of[k][2]
                want = images[k][int(v), int(u)]
                assert near[k, i, j] == (None if math.isnan(want) else want)
                total = weight = 0.0
                for r in range(of[k][4]):
                    for c in range(of[k][3]):
                        w = max(0, 1 - abs(u - c - 0.5)) * max(0, 1 - abs(v - r - 0.5))
                        if w > 0 and not math.isnan(images[k][r, c]):
                            total, weight = total + w * images[k][r, c], weight + w
                assert smooth[k, i, j] is None if not weight else abs(smooth[k, i, j] - total / weight) < 1e-9
    coarse = {"a": (90.0, 50.0, 30.0, 4, 2), "b": (-3.0, 9.0, 4.0, 1, 2)}
    t = spark.createDataFrame([(k, *g) for k, g in coarse.items()], GRID)
    got = {(r.id, r.row, r.col): (r.mean, r.mode, r.n) for r in R.pooled(p, s, t, ["id"], "v").collect()}
    want = {}
    for k, v in images.items():
        for (i, j), x in np.ndenumerate(v):
            row = math.floor((coarse[k][1] - of[k][1] + (i + 0.5) * of[k][2]) / coarse[k][2])
            col = math.floor((of[k][0] + (j + 0.5) * of[k][2] - coarse[k][0]) / coarse[k][2])
            if not math.isnan(x) and 0 <= row < coarse[k][4] and 0 <= col < coarse[k][3]:
                want.setdefault((k, row, col), []).append(x)
    assert got.keys() == want.keys()
    for k, x in want.items():
        mode = min(set(x), key=lambda m: (-x.count(m), m))
        assert abs(got[k][0] - sum(x) / len(x)) < 1e-12 and got[k][1:] == (mode, len(x))
    assert R.nearest(R.places(t.limit(0), s, ["id"]), p, ["id"], ["v"]).count() == 0
    assert R.bilinear(R.places(t, s.limit(0), ["id"]), p.limit(0), ["id"], ["v"]).where("v is null").count() == 10


def test_web_mercator(spark):
    places = [(0.0, 0.0), (81.25, 28.75), (-179.0, 60.0), (10.0, -33.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = R.to_mercator(F.col("lon"), F.col("lat"))
    back = R.from_mercator(F.col("x"), F.col("y"))
    for (lon, lat), r in zip(places, df.select(x.alias("x"), y.alias("y")).select("x", "y", back[0].alias("lon"), back[1].alias("lat")).collect()):
        assert abs(r.x - lon / 180 * 20037508.342789244) < 1e-6 and abs(r.lon - lon) < 1e-9 and abs(r.lat - lat) < 1e-9
        assert abs(r.y - 6378137 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) < 1e-6
    assert spark.range(1).select(R.to_mercator(F.lit(0.0), F.lit(90.0))[1].alias("y")).first().y is None

    g = spark.createDataFrame([("a", 500000.0, 3100000.0, 30.0, 32, 20)], GRID)
    of = R.utm(44)
    to = R.suggested(g, ["id"], of, R.MERCATOR)
    r = to.first()
    stretch = 1 / math.cos(math.radians(28.02))  # Mercator enlarges by the secant of the latitude
    assert abs(r.step / (30 * stretch) - 1) < 0.005 and abs(r.columns - 32) <= 1 and abs(r.rows - 20) <= 1
    seen = R.places(to, g, ["id"], R.MERCATOR, of)
    inside = seen.where("u is not null").count()
    assert 0.95 * r.columns * r.rows < inside <= r.columns * r.rows
    worst = seen.select(F.max(F.abs(F.col("u") - F.col("col") - 0.5)).alias("u"), F.max(F.abs(F.col("v") - F.col("row") - 0.5)).alias("v")).first()
    assert worst.u < 1.5 and worst.v < 1.5  # near the zone's meridian, north is up in both
    same = R.places(g, g, ["id"], of, of).select(F.max(F.abs(F.col("u") - F.col("col") - 0.5)).alias("d"), F.count("u").alias("n")).first()
    assert same.d < 1e-6 and same.n == 640


def test_colours(spark):
    colours = ["#000000", "#ff8000", "#0a141e"]
    values = [-1.0, 0.0, 0.1, 0.25, 0.5, 0.77, 1.0, 9.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(R.colour(F.col("v"), 0.0, 1.0, colours).alias("c"))
    ramp = np.array([[0, 0, 0], [255, 128, 0], [10, 20, 30]], float)
    for v, r in zip(values, df.collect()):
        real = v is not None and math.isfinite(v)
        want = [int(np.interp(np.clip(v if real else 0.0, 0, 1), [0, 0.5, 1], ramp[:, k]).round()) for k in range(3)]
        assert list(r.c) == [*want, 255 if real else 0]
