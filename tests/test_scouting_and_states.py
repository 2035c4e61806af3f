import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import scouting
from tidemark.operators.pixels import isolation_scores
from tidemark.streaming import runs, stateful


def test_queue_by_forest_and_by_rules(spark):
    rng = np.random.default_rng(5)
    rows = []
    for area, n in (("large", 30), ("small", 8), ("tiny", 3)):
        for i in range(n):
            v, m = rng.normal(0.5, 0.05), rng.normal(0.2, 0.05)
            if i == 0:
                v, m = 0.0, -0.3
            rows.append((area, i, float(v), float(m), i % 7 != 3, i % 5 != 4))
        rows += [(area, n, None, 0.2, True, True), (area, n + 1, 0.4, 0.2, None, True)]
    df = spark.createDataFrame(rows, "area string, cell long, ndvi double, ndmi double, field boolean, seen boolean")
    got = {(r.area, r.cell): r for r in scouting.queue(df, "area", "cell", ["ndvi", "ndmi"], ["ndvi", "ndmi"], F.col("field"), F.col("seen")).collect()}
    assert len(got) == len(rows)
    for area in ("large", "small", "tiny"):
        own = pd.DataFrame([r for r in rows if r[0] == area], columns=["area", "cell", "ndvi", "ndmi", "field", "seen"])
        cand = own[own.field.fillna(False).astype(bool) & own.seen.astype(bool) & own.ndvi.notna()]
        z = {}
        for f in ("ndvi", "ndmi"):
            mad = 1.4826 * np.median(np.abs(cand[f] - cand[f].median()))
            z[f] = (cand[f] - cand[f].median()) / mad if len(cand) >= 5 and mad > 1e-9 else cand[f] * np.nan
        score = isolation_scores(np.column_stack([z["ndvi"], z["ndmi"]])) if len(cand) >= 12 else None
        for k, (i, cell) in enumerate(zip(cand.index, cand.cell)):
            stress = min(z["ndvi"][i], z["ndmi"][i])
            out = score is not None and score[k] > 0.5
            if score is not None:
                want = "HIGH" if out and stress <= -1.5 else "WATCH" if out or stress <= -1.5 else "LOW"
            else:
                want = "HIGH" if stress <= -2.5 else "WATCH" if stress <= -1.5 else "LOW"
            r = got[(area, cell)]
            assert (r.priority, r.outlier) == (want, out), (area, cell)
            assert np.isnan(stress) and r.stress_z is None or abs(r.stress_z - stress) < 1e-9
        for r in own[~own.index.isin(cand.index)].itertuples():
            assert got[(area, r.cell)].priority == ("INSUFFICIENT DATA" if r.field is True or r.field == True else "NOT CROPLAND")  # noqa: E712
    assert got[("large", 0)].priority == got[("small", 0)].priority == "HIGH" and "n" in got[("large", 0)].reason
    assert scouting.queue(df.limit(0), "area", "cell", ["ndvi"], ["ndvi"], F.col("field"), F.col("seen")).count() == 0


def files(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return runs.read(spark, str(tmp_path / "in"), files_per_batch=1)


def day(n, hour=0.0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def test_labels_over_batches_and_late_scenes(spark, tmp_path):
    first = [(1, 1, day(0), 0.5), (1, 2, day(1), 0.51), (2, 9, day(0), 0.3)]
    second = [(1, 4, day(3), 0.4), (1, 3, day(2), 0.6), (1, 0, day(-1), 0.9)]
    made = runs.settle(stateful.change_labels(files(spark, tmp_path, [first, second], "aoi long, scene long, ts timestamp, value double")), mode="append")
    got = {(r.aoi, r.scene): (r.step and round(r.step, 6), r.label) for r in made.collect()}
    assert got == {(1, 1): (None, "NO DATA"), (1, 2): (0.01, "STABLE"), (2, 9): (None, "NO DATA"), (1, 3): (0.09, "GREENING"), (1, 4): (-0.2, "DECLINE"), (1, 0): (None, "LATE")}
    assert stateful.label(-0.3, [0.01, -0.01, 0.02, 0.0, 0.01]) == "UNUSUAL DECLINE" and stateful.label(-0.3, [0.0] * 9) == "DECLINE"


def test_answers_expire_and_incomplete_ones_are_not_kept(spark, tmp_path):
    first = [(1, 1, day(0), False), (1, 2, day(0, 1), True), (1, 3, day(0, 6.9), True)]
    second = [(1, 4, day(0, 7), True), (1, 5, day(0, 12.5), False), (2, 6, day(9), True)]
    third = [(1, 7, day(9, 1), False), (2, 8, day(9, 5), False)]
    made = runs.settle(stateful.cached(files(spark, tmp_path, [first, second, third], "key long, id long, ts timestamp, complete boolean"), late="1 hour"), mode="append")
    got = {r.id: r.answer for r in made.collect()}
    assert got == {1: "computed", 2: "computed", 3: "cached", 4: "computed", 5: "cached", 6: "computed", 7: "computed", 8: "cached"}


def test_set_aside_rows_can_be_taken_up_again(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1, 5.0)], [(2, None), (3, 7.0)]], "id long, v double")
    good, aside = stateful.set_aside(stream, F.when(F.col("v").isNull(), "no value"))
    assert sorted(r.id for r in good.collect()) == [1, 3] and [(r.id, r.reason) for r in aside.collect()] == [(2, "no value")]
    again = aside.drop("reason").withColumn("v", F.coalesce("v", F.lit(0.0)))
    assert again.unionByName(good).count() == 3
