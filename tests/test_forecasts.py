import numpy as np

from tidemark.operators import boosting
from tidemark.plans import forecast_queries as Q


def test_a_tree_splits_where_brute_force_does():
    rng = np.random.default_rng(1)
    x, slope = rng.integers(0, 12, (300, 4)), rng.normal(size=300)
    slope[x[:, 2] <= 4] += 2
    s = boosting.Settings(leaves=2, least_rows=20)
    best = (0.0, 0, 0)
    for f in range(4):
        for cut in range(11):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 20:
                gain = sum(slope[m].sum() ** 2 / (m.sum() + 1.0) for m in (left, ~left)) - slope.sum() ** 2 / 301
                best = max(best, (gain, f, cut))
    tree, values = boosting.grow(x, slope, slope, 0.5, s)
    assert (tree.feature[0], tree.cut[0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.allclose(values, np.where(left, np.median(slope[left]), np.median(slope[~left])) * s.rate)
    assert np.allclose(tree.predict(x), values)


def test_histograms_of_children_add_up_in_deep_trees():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(900, 5)), rng.normal(size=900)
    bins = boosting.to_bins(x, boosting.bin_edges(x, 20))
    s = boosting.Settings(leaves=15, least_rows=25)
    tree, values = boosting.grow(bins, y, y, 0.5, s)
    assert np.allclose(tree.predict(bins), values)
    sizes = np.unique(values, return_counts=True)[1]
    assert len(sizes) > 8 and sizes.min() >= 25


def test_quantiles_have_their_share_below_them():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (3000, 3))
    y = np.sin(2 * x[:, 0]) + (0.2 + (x[:, 1] > 0)) * rng.normal(size=3000)
    for q in (0.1, 0.5, 0.9):
        p = boosting.fit_predict(x[:2000], y[:2000], x[2000:], q, boosting.Settings(rounds=120))
        assert abs((y[2000:] <= p).mean() - q) < 0.06
        flat = np.quantile(y[:2000], q)
        loss = lambda p, q=q: np.maximum(q * (y[2000:] - p), (q - 1) * (y[2000:] - p)).mean()
        assert loss(p) < 0.85 * loss(flat)
    assert np.quantile(y, 0.37) == boosting.quantile(y, 0.37)
    assert np.isnan(boosting.fit_predict(x[:0], y[:0], x[:2], 0.5, boosting.Settings())).all()


def test_models_side_by_side_with_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, "test" if i % 4 == 0 else "train", float(x), float(3 * x + (s == "b"))) for s in "ab" for i, x in enumerate(rng.normal(size=400))]
    rows += [("a", 900, "test", None, 1.0), ("a", 901, "train", 1.0, None), ("a", 902, "test", 0.0, None), ("c", 1, "test", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "site string, day int, part string, x double, y double")
    got = {(r.site, r.day): r.q for r in boosting.quantile_models(df, ["site"], "day", ["x"], settings=boosting.Settings(rounds=60, least_rows=10)).collect()}
    test = [r for r in rows if r[2] == "test" and r[3] is not None]
    assert set(got) == {(r[0], r[1]) for r in test} and got[("c", 1)] == []
    assert all(q == sorted(q) for q in got.values())
    miss = [abs(got[(r[0], r[1])][1] - r[4]) for r in test if r[4] is not None and r[0] != "c"]
    assert np.median(miss) < 0.6


def test_parts_keep_their_distance(spark):
    d = Q.supervised(spark, "/root/testdata/sf0.001", (7,)).where("segment = '2-HIGH'").select("date", "part", "y", "lag0").toPandas()
    dates = {p: set(g["date"]) for p, g in d.groupby("part")}
    assert set(dates) >= {"train", "test", "val", "gap"}
    held = dates["test"] | dates["val"]
    assert min(abs((a - b).days) for a in dates["train"] for b in held) > Q.GAP
    later = dict(zip(d["date"], d["lag0"]))
    import datetime

    for r in d.itertuples():
        ahead = later.get(r.date + datetime.timedelta(days=7))
        assert ahead is None or abs(ahead - r.y) < 1e-12
