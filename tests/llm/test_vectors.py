import math
import random
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds

from tidemark.llm import catalogue, vectors

SF = "/root/testdata/sf0.01"


def brute_top(rows, k, scale=256):
    rows = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, v) for i, v in rows if i is not None]
    out = set()
    for q, a in rows:
        if q % 50 == 0:
            best = {}
            for i, b in rows:
                if i != q and len(a) == len(b):
                    s = min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
                    best[i] = max(best.get(i, s), s)
            for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((q, rank, i, s))
    return out


def test_top_k_of_the_table(spark):
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pydict()
    got = catalogue.QUERIES["op2_top_k"](spark, SF).collect()
    assert {tuple(r) for r in got} == brute_top(list(zip(table["vec_id"], table["embedding"])), 5)


def test_top_k_edge_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25]) for _ in range(6)], "x") for i in range(140)]
    rows += [(200, None, "x"), (250, [1.0, None, 1.0], "x"), (300, [1.0, float("nan"), 1.0], "x")]
    rows += [(350, [float("inf")] * 6, "x"), (400, [1e17] * 6, "x"), (450, [-3e17] * 6, "x"), (500, [], "x"), (501, [], "x")]
    rows += [(550, [1.0, 2.0], "x"), (551, [2.0, 1.0], "x"), (None, [1.0] * 6, "x"), rows[0], rows[3], (600, [1.7e308] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = vectors.top_k(df, F.col("vec_id") % 50 == 0, k=3, query_block=2, row_block=16).collect()
    want = brute_top([r[:2] for r in rows if r[0] != 600], 3)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vectors.top_k(df.limit(0), F.lit(True)).count() == 0


def test_no_vector_passes_the_driver(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for limit in ("10m", "-1"):
        made = vectors.top_k(df, F.col("vec_id") % 50 == 0, query_block=4, row_block=16)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert {tuple(r) for r in made.collect()} == brute_top(rows, 5)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "Join" not in plan


def test_top_k_of_repeated_ids_and_of_huge_components(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25]) for _ in range(6)]) for i in range(120)]
    rows += [(7, [x + 0.25 * j for x in v]) for j in range(40) for _, v in rows[50:51]]
    rows += [(i, [rng.choice([-2.0, 1.0]) for _ in range(6)]) for i in (60, 60, 61, 61, 61)]
    rows += [(i, [1.0, *(rng.choice([-1e200, 1e200, 0.0]) for _ in range(6))]) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.top_k(df, F.col("vec_id") % 50 == 0, k=3, query_block=2, row_block=16).collect()
    want = brute_top(rows, 3)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def brute_links(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        fine = label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        n = math.sqrt(sum(float(x) * float(x) for x in v)) if fine else 0
        unit.append((len(v), np.array(v, float) / n) if n else None)
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a and b and rows[i][2] == rows[j][2] and a[0] == b[0] and a[1] @ b[1] >= least:
                links[i].add(j)
                links[j].add(i)
    return links


def test_every_link_is_right_and_few_are_missed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        centre = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 12))):
            x = centre + rng.normal(size=64) * rng.choice([0.05, 0.12, 0.2])
            rows.append((len(rows), x.tolist(), int(c % 3)))
    hub = rng.normal(size=64)
    rows += [(1000 + i, (hub + rng.normal(size=64) * 0.08).tolist(), 1) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    want = brute_links(rows)
    found, all_ = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert len(got) == len(rows) and found <= all_ and found >= 0.97 * all_
    assert all(got[rows[i][0]].n_links <= len(want[i]) for i in range(len(rows)))
    assert len({r.component_id for r in got.values() if r.vec_id >= 1000}) == 1


def test_pairs_at_the_least_cosine_share_a_filter_at_any_size():
    rng = np.random.default_rng(4)
    for n in (1_000, 100_000, 1_000_000, 10_000_000):
        code = vectors.CapFilters(64, max(8, int(np.ceil((4.0 * n) ** 0.25))))
        u, w = rng.normal(size=(2, 300, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        a, b = (code.decode(x, 40)[1].reshape(300, 40) for x in (u, v))
        met = [bool(np.isin(x, y).any()) for x, y in zip(a, b)]
        print("filters", n, np.mean(met))
        assert np.mean(met) >= 0.99


def test_recall_on_the_table(spark):
    table = ds.dataset("/root/testdata/sf0.1/embeddings.parquet").to_table().to_pydict()
    rows = list(zip(table["vec_id"], table["embedding"], table["label"]))
    want = sum(map(len, brute_links(rows).values()))
    got = catalogue.QUERIES["op9_embedding_near_dedup"](spark, "/root/testdata/sf0.1").collect()
    found = sum(r.n_links for r in got)
    print("links", found, "of", want)
    assert len(got) == len(rows) and 0.95 * want <= found <= want


def test_edge_vectors_and_tiles(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(i, same, 1) for i in range(3, 9)] + [(20, [1.0, 0.5, -2.0], 1), (21, same, 2), (22, same, None), (23, None, 1)]
    rows += [(24, [0.0] * 3, 1), (25, [None, 1.0, 1.0], 1), (26, [float("nan")] * 3, 1), (27, [], 1), (28, [1.0, 1.0], 1), (3, same, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F_lit())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    want = [(3, 7, 3, True), (3, 7, 3, True), *[(i, 7, 3, False) for i in range(4, 9)], (20, 7, 3, False)]
    want += [(i, 0, i, True) for i in range(21, 29)]
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    points = [(1, i, 1 + i % 3, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(60, 3)) * 0.05 + 1)]
    points[7:9] = [(1, i, 2, v) for i, v in ((7, [1.0, 0.0, 0.0]), (8, [0.999, 0.0, (1 - 0.999**2) ** 0.5]))]
    frame = spark.createDataFrame(points, "label int, point long, m int, v array<double>")
    linked = np.array([[i != j and np.dot(p[3], q[3]) >= 0.99 for j, q in enumerate(points)] for i, p in enumerate(points)])
    want = {i: sum(points[j][2] for j in np.flatnonzero(linked[i])) for i in range(60) if linked[i].any()}
    for tile in (7, 1024):
        found, edges = {}, []
        for r in vectors.cosine_links(frame, 0.99, tile=tile).collect():
            if r.n is None:
                edges.append((r.a, r.b))
            else:
                found[r.a] = found.get(r.a, 0) + r.n
        assert found == want and all(linked_chain(linked)[a, b] for a, b in edges)
        joined = np.zeros_like(linked)
        for a, b in edges:
            joined[a, b] = joined[b, a] = True
        assert (linked_chain(joined) == linked_chain(linked)).all()


def linked_chain(linked):
    reach = linked | np.eye(len(linked), dtype=bool)
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    return reach


def test_magnitudes_beyond_the_range_of_squares(spark):
    v = np.array([1.0, 2.0, -0.5])
    rows = [(i, (v * x).tolist(), 1) for i, x in enumerate((1e200, 1e200, 1e-200, 1.0, 3e-310))]
    rows += [(9, (np.array([-2.0, 1.0, 0.0]) * 1e250).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert got == [*[(i, 4, 0) for i in range(5)], (9, 0, 9)]


def test_few_pairs_are_scored_where_vectors_have_structure():
    rng = np.random.default_rng(8)
    smooth = lambda n: np.floor(256 * np.cumsum(rng.normal(size=(n, 64)), axis=1) / 8)
    rows, queries = vectors.SegmentIndex(smooth(3000)), vectors.SegmentIndex(smooth(40))
    q, c, s = rows.search(queries, np.arange(-40, 0), np.arange(3000), 5)
    whole = queries.vectors @ rows.vectors.T
    assert (np.sort(whole, axis=1)[:, :-6:-1] == s.reshape(40, 5)).all()
    print("pairs left by level", rows.pairs)
    assert rows.pairs[-1] < 0.2 * rows.pairs[0]


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_fixtures_exist():
    assert Path(SF).is_dir()
