import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy as G


def test_known_points_of_the_utm_grid(spark):
    rows = [(81.0, 0.0, 500000.0, 0.0), (84.0, 0.0, 833978.5569, 0.0), (78.0, 0.0, 166021.4431, 0.0), (81.0, 90.0, 500000.0, 9997964.943), (81.0, -90.0, 500000.0, -9997964.943)]
    df = spark.createDataFrame(rows, "lon double, lat double, x double, y double")
    e, n = G.to_utm(F.col("lon"), F.col("lat"), 44)
    for r in df.select("x", "y", e.alias("e"), n.alias("n")).collect():
        assert abs(r.e - r.x) < 1e-3 and abs(r.n - r.y) < 1e-3


def test_there_and_back(spark):
    df = spark.range(400).select((74 + F.col("id") * 14 / 400).alias("lon"), (F.pmod(F.col("id") * 37, F.lit(160)) - 80.0).alias("lat"))
    df = df.withColumns(dict(zip(("e", "n"), G.to_utm(F.col("lon"), F.col("lat"), 44))))
    df = df.withColumns(dict(zip(("lon2", "lat2"), G.from_utm(F.col("e"), F.col("n"), 44))))
    off = df.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))), F.max(F.abs(F.col("lat") - F.col("lat2")))).first()
    assert max(off) < 1e-9


def test_geodesics(spark):
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    rows = [
        (dms(144, 25, 29.5244), dms(-37, 57, 3.7203), dms(143, 55, 35.3839), dms(-37, 39, 10.1561), 54972.271),
        (0.0, 0.0, 0.0, 90.0, 10001965.729),
        (0.0, 0.0, 90.0, 0.0, 10018754.171),
        (5.0, 7.0, 5.0, 7.0, 0.0),
        (None, 7.0, 5.0, 7.0, None),
        (1.0, None, 5.0, 7.0, None),
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, m double")
    for r in df.select("m", G.geodesic_m(*map(F.col, "abcd")).alias("x")).collect():
        assert r.x is None if r.m is None else abs(r.x - r.m) < 2e-3


def test_the_surface_of_the_ellipsoid(spark):
    whole = spark.range(1).select((4 * F.pi() * G.authalic(F.lit(90.0))).alias("m2")).first().m2
    assert abs(whole / 1e12 - 510.065621724) < 1e-6
    east, north = G.to_utm(F.col("x"), F.col("y"), 44)  # in a small box the plane of UTM has nearly the same area
    box = spark.createDataFrame([(i, 81.0 + x, 28.0 + y) for i, (x, y) in enumerate([(0, 0), (0.02, 0), (0.02, 0.01), (0, 0.01)])], "i int, x double, y double")
    p = [(r.e, r.n) for r in box.select("i", east.alias("e"), north.alias("n")).orderBy("i").collect()]
    flat = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2 / G.SCALE**2
    true = spark.range(1).select((F.radians(F.lit(0.02)) * (G.authalic(F.lit(28.01)) - G.authalic(F.lit(28.0)))).alias("a")).first().a
    assert abs(flat / true - 1) < 1e-6


def clip_area(ring, left, bottom, right, top):
    """Sutherland-Hodgman and the shoelace formula."""
    for axis, bound, keep in ((0, left, 1), (0, right, -1), (1, bottom, 1), (1, top, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def test_what_a_polygon_shares_with_boxes(spark):
    ring = [(0.3, 0.2), (2.7, 0.4), (3.4, 2.6), (1.1, 1.9), (0.6, 3.3)]
    edges = [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    boxes = [(x / 2, y / 2, x / 2 + 0.5, y / 2 + 0.5) for x in range(8) for y in range(8)] + [(0.0, 0.0, 4.0, 4.0)]
    e = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(boxes, "l double, b double, r double, t double")
    part = G.under_edge(*map(F.col, ("x1", "y1", "x2", "y2", "l", "r", "b", "t")))
    got = {(r.l, r.b, r.r): r.a for r in b.crossJoin(e).groupBy("l", "b", "r").agg(F.abs(F.sum(part)).alias("a")).collect()}
    for box in boxes:
        assert abs(got[box[:3]] - clip_area(ring, *box)) < 1e-9


@pytest.mark.parametrize(("segment", "want"), [((-2, 0, 2, 0), (0.25, 0.75)), ((0, 0, 0.5, 0), (0, 1)), ((-2, 1.5, 2, 1.5), (None, None)), ((3, 0, 4, 0), (None, None)), ((0, 0, 0, 0), (None, None))])
def test_segments_in_circles(spark, segment, want):
    t1, t2 = G.inside_circle(*[F.lit(float(x)) for x in segment], F.lit(0.0), F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(t1.alias("a"), t2.alias("b")).first()
    assert (r.a, r.b) == want


def test_bounds_against_single_points(spark):
    corners = [(79.5, 27.9, 80.25, 28.4), (81.5, -3.0, 82.0, -2.5)]
    box = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "id int, a double, b double, c double, d double")
    names = ("left", "bottom", "right", "top")
    for to, scale in ((G.to_utm, 1), (G.from_utm, 10000)):
        got = G.bounds(box, ["id"], G.edge_points(*[F.col(c) * scale for c in "abcd"]), to, 44, names)
        assert [f.name for f in got.schema] == ["id", *names]
        edge = [
            (i, scale * x, scale * y)
            for i, (l, b, r, t) in enumerate(corners)
            for k in range(23)
            for x, y in ((l + k / 22 * (r - l), b), (l + k / 22 * (r - l), t), (l, b + k / 22 * (t - b)), (r, b + k / 22 * (t - b)))
        ]
        x, y = to(F.col("x"), F.col("y"), 44)
        points = spark.createDataFrame(edge, "id int, x double, y double").select("id", x.alias("x"), y.alias("y")).collect()
        for r in got.collect():
            own = [p for p in points if p.id == r.id]
            want = [min(p.x for p in own), min(p.y for p in own), max(p.x for p in own), max(p.y for p in own)]
            assert list(r)[1:] == pytest.approx(want, rel=1e-12, abs=1e-9)
    empty = G.bounds(box.limit(0), ["id"], G.edge_points(*map(F.col, "abcd")), G.to_utm, 44, names)
    assert empty.collect() == []
    nulls = spark.sql("select 1 id, double(null) a, 2d b, 81d c, 3d d")
    assert G.bounds(nulls, ["id"], G.edge_points(*map(F.col, "abcd")), G.to_utm, 44, names).first().right is not None
