import math
import random

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tidemark.llm import catalogue, negatives

SF = "/root/testdata/sf0.1"


def brute(rows, every=100, positives=5, k=5, scale=256, least=80):
    own = {}
    for i, v, label in rows:
        fine = i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(float(x) * scale) for x in v)
        if fine:
            own[(i, label, tuple(map(float, v)))] = [math.floor(float(x) * scale) for x in v]
    out = []
    ids = {}
    for key in own:
        if key[0] % every == 0:
            ids[key[0]] = min(ids.get(key[0], (len(key[2]), *key[1:])), (len(key[2]), *key[1:]))
    for a, (size, label, v) in ids.items():
        mine = own[(a, label, v)]
        scored = [(min(max(sum(x * y for x, y in zip(mine, w)), -(2**63)), 2**63 - 1), i, other) for (i, other, u), w in own.items() if i != a and len(u) == size]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            hit = [s for s in scored if s[2] != label and least * p <= 100 * s[0] <= 100 * p][:k]
            out += [(a, i, rank, j, p, s) for rank, (s, j, _) in enumerate(hit, 1)]
    return sorted(out)


def test_the_table(spark):
    t = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pydict()
    moved = [(i, v, label if label is None or i % 7 else (label + 1) % 10) for i, v, label in zip(t["vec_id"], t["embedding"], t["label"])]
    got = sorted(tuple(r) for r in catalogue.QUERIES["op13_hard_negatives"](spark, SF).collect())
    assert got and got == brute(moved)


def test_edge_rows_and_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.choice([-1, 0, 0.5, 1, 2])) for _ in range(5)], rng.choice([1, 1, 1, 2, 3])) for i in range(300)]
    rows += [(310, None, 1), (320, [1.0, None, 1.0, 1.0, 1.0], 1), (330, [float("nan")] * 5, 2), (340, [float("inf")] * 5, 2), (350, [1.0] * 5, None)]
    rows += [(None, [1.0] * 5, 1), (360, [], 1), (361, [], 1), (362, [], 2), (370, [1.0, 2.0], 1), (371, [2.0, 1.0], 1), (372, [2.0, 0.9], 2)]
    rows += [(380, [0.0] * 5, 1), (390, [1e17] * 5, 1), (391, [1e17] * 5, 1), (392, [0.9e17] * 5, 2), (400, [1.7e308] * 5, 1), rows[3], rows[3], rows[20]]
    rows += [(20, [2.0, 2.0, 2.0, 2.0, 0.0], 3), (7, [1.0, 1.0, 2.0, 2.0, 2.0], 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    want = brute(rows, every=10)
    for turn, block in ((1, 3), (4, 256)):
        monkeypatch.setattr(negatives._meet, "__defaults__", (block, 16 * 5 * 8, turn))
        got = sorted(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect())
        assert got == want
    assert {r[0] for r in want} >= {390, 370, 0} and negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0


def test_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(4000, 3)) ** 3)
    lists, ids = negatives.SortedLists(rows), rng.permutation(4000)
    scored = []
    for anchor in np.floor(256 * rng.normal(size=(40, 3))):
        allowed = rng.random(4000) < 0.7
        whole = (rows @ anchor).astype(np.int64)
        top = int(whole[allowed].max())
        windows = [negatives.Window(top // 2, top, 5), negatives.Window(negatives.LOW, negatives.HIGH, 3), negatives.Window(top // 3, top // 3 + 5, 4)]
        scored.append(lists.search(anchor, ids, allowed, windows))
        for w in windows:
            best = sorted((-int(s), int(i)) for s, i, ok in zip(whole, ids, allowed) if ok and w.low <= s <= w.high)[: w.k]
            assert best == [(-int(s), int(i)) for s, i in zip(w.scores, w.ids)]
    print("scored of 4000", np.mean(scored))
    assert np.mean(scored) < 2000
    ties = negatives.SortedLists(np.zeros((50, 3)))
    w = negatives.Window(negatives.LOW, negatives.HIGH, 4)
    ties.search(np.array([1.0, -1.0, 0.0]), np.arange(50)[::-1], np.ones(50, bool), [w])
    assert w.ids.tolist() == [0, 1, 2, 3]
