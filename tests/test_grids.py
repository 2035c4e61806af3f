import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import grids

LAYOUT = grids.Layout(south=20.0, west=70.0, step=0.25, rows=5, columns=4)


def test_binary_grids(spark, tmp_path):
    rng = np.random.default_rng(1)
    cube = rng.uniform(0, 50, (3, 5, 4)).astype("<f4")
    cube[1, 2, 3], cube[2, 0, 0], cube[2, 4, 1] = -999, np.nan, 0
    (tmp_path / "a.grd").write_bytes(cube.tobytes())
    (tmp_path / "b.grd").write_bytes((cube[:2] + 1).astype("<f4").tobytes())
    got = {(r.path[-5:], r.day, r.row, r.col): r.value for r in grids.binary_grids(spark, str(tmp_path), LAYOUT).collect()}
    assert len(got) == 5 * 20 and got[("a.grd", 1, 2, 3)] is None and got[("a.grd", 2, 0, 0)] is None and got[("a.grd", 2, 4, 1)] == 0
    assert got[("b.grd", 0, 3, 2)] == float(np.float32(cube[0, 3, 2] + 1))
    part = grids.binary_grids(spark, str(tmp_path / "a.grd"), LAYOUT, rows=(1, 2), columns=(3, 3)).collect()
    assert sorted((r.day, r.row, r.col) for r in part) == [(d, r, 3) for d in range(3) for r in (1, 2)]
    (tmp_path / "a.grd").write_bytes(cube.tobytes()[:-4])
    with pytest.raises(Exception, match="not whole days"):
        grids.binary_grids(spark, str(tmp_path), LAYOUT).collect()


def test_nearest_and_block_means(spark):
    points = [(1, 70.1, 20.6), (2, 70.9, 21.1), (3, 69.8, 20.0), (4, 70.0, 20.0), (5, None, 20.0)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    r, c = LAYOUT.nearest(F.col("lon"), F.col("lat"))
    got = {x.id: (x.row, x.col) for x in df.select("id", r.alias("row"), c.alias("col")).collect()}
    assert got == {1: (2, 0), 2: (4, None), 3: (0, None), 4: (0, 0), 5: (0, None)}
    values = {(i, j): float(i * 10 + j) if (i + j) % 3 else -999.0 for i in range(5) for j in range(4)}
    cells = spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, value double")
    asked = spark.createDataFrame([(1, 2, 1), (2, 0, 0), (3, 9, 9), (3, 9, 9)], "id int, row int, col int")
    for x in grids.block_mean(cells, asked, ["id"]).collect():
        row, col = {1: (2, 1), 2: (0, 0), 3: (9, 9)}[x.id]
        near = [values[i, j] for i in range(row - 1, row + 2) for j in range(col - 1, col + 2) if values.get((i, j), -1) >= 0]
        own = values.get((row, col), -1)
        assert x.at == (own if own >= 0 else None) and x.cells == len(near) * (1 if x.id < 3 else 2)
        assert x.around is None if not near else abs(x.around - sum(near) / len(near)) < 1e-12


def test_windows_tiles_and_blocks(spark):
    def window(*v):
        return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(grids.window(*map(F.lit, map(float, v))))]).first())

    assert window(0, 100, 95, 0, 10, 0, 100, 10, 10) == (0, 9, 0, 10)
    assert window(12, 87, 200, 3, 10, 0, 100, 10, 10) == (2, 10, 2, 9)
    assert window(200, 100, 300, 0, 10, 0, 100, 10, 10) == (None,) * 4
    assert window(11, 100, 19, 0, 10, 0, 100, 10, 10) == (None,) * 4
    boxes = [(-0.5, 1.9, 0.1, 2.1), (79.9, 28.1, 80.0, 28.2), (3.0, -3.0, 3.1, -2.9)]
    for w, s, e, n in boxes:
        got = spark.range(1).select(grids.tiles(*map(F.lit, (w, s, e, n))).alias("t")).first().t
        want = [(x, y) for x in range(math.floor(w / 2) * 2, math.floor(e / 2) * 2 + 1, 2) for y in range(math.floor(s / 2) * 2, math.floor(n / 2) * 2 + 1, 2)]
        assert [tuple(t) for t in got] == want
    parts = spark.range(1).select(grids.blocks(F.lit(9000), F.lit(4001)).alias("b")).first().b
    assert len(parts) == 6 and sum(p.width * p.height for p in parts) == 9000 * 4001 and max(p.width for p in parts) == 4000


def test_mosaics(spark):
    rows = [(1, 1, None), (1, 2, 5), (1, 3, 9), (2, 1, None), (3, 2, 0), (3, 1, -4)]
    df = spark.createDataFrame(rows, "px int, item int, v int")
    assert sorted(map(tuple, grids.mosaic_first(df, ["px"], F.col("item"), "v").collect())) == [(1, 5), (3, -4)]
    assert sorted(map(tuple, grids.mosaic_largest(df, ["px"], "v").collect())) == [(1, 9), (2, 0), (3, 0)]
